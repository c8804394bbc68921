import random
import re

import duckdb
import numpy as np

from factloom.llm import prefixjoin, queries
from factloom.llm.minhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def brute(docs, width=3, percent=90):
    """doc_id to set size and the least id of its component, by comparing all pairs of sets."""
    sets = {}
    for i, t in docs:
        w = [] if t is None else [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_and_twin(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op11_ngram_jaccard(spark, SF)
    assert found(got) == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(prefixjoin.ORACLE).fetchall())


def near(words, changes, r):
    out = list(words)
    for k in r.sample(range(len(out)), changes):
        out[k] = f"v{r.randrange(10**6)}"
    return " ".join(out)


def hard_rows(prose, odd_texts):
    r = random.Random(5)
    rows = list(enumerate(odd_texts))
    w = prose(300, 9).split()
    for k in range(14):  # a chain: each is near the next, the ends are not near each other
        rows.append((100 + k, " ".join(w[k * 6 : 200 + k * 6])))
    base = prose(400, 11).split()
    for k in range(90):  # around the border of being alike, to what they come from and to each other
        rows.append((200 + k, near(base, r.choice([1, 3, 6, 8, 12, 14, 16]), r)))
    passage = prose(180, 10)
    for k in range(60):  # one passage in all, with ends of their own
        rows.append((400 + k, passage + " " + prose(4 + k % 30, 500 + k)))
    for k in range(30):  # equal sets in another order of words, and exact copies
        rows.append((500 + k, prose(60, 600 + k % 7).upper() if k % 2 else prose(60, 600 + k % 7)))
    return rows


def test_chains_borders_and_odd_rows(make_docs, prose, odd_texts):
    rows = hard_rows(prose, odd_texts)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(want) - 60
    assert found(prefixjoin.similar_documents(make_docs(rows))) == want


def test_blocks_and_the_last_round(make_docs, prose, odd_texts):
    rows = hard_rows(prose, odd_texts)
    want = brute(rows)
    signed, groups = prefixjoin.similar_classes(make_docs(rows), large=4, block=8)
    labels = {r.node: r.component for r in groups.collect()}
    by = {}
    for r in signed.collect():
        if r["class"] is not None:
            by.setdefault(labels.get(r["class"], r["class"]), set()).add(r.doc_id)
    assert sorted(map(sorted, by.values())) == sorted(sorted(i for i, x in want.items() if x[1] == c and x[0]) for c in {x[1] for x in want.values() if x[0]})


def test_groups_of_one_prefix(make_docs, prose, monkeypatch):
    """Sets of one prefix and size that differ beyond the prefix are one group and are verified each."""
    monkeypatch.setattr(prefixjoin, "shingle_counts", lambda profiled: np.zeros(prefixjoin.CELLS, np.uint32))  # the order is that of the hashes
    base = prose(300, 21).split()
    first = set(shingle_hashes(" ".join(base), 3)[: prefixjoin.prefix_length(298, 90)].tolist())
    rows, last = [(0, " ".join(base))], max(first)
    for k in range(2, 297):
        text = " ".join([*base[:k], f"z{k}", *base[k + 1 :]])
        if first <= (own := set(shingle_hashes(text, 3).tolist())) and min(own - set(shingle_hashes(" ".join(base), 3).tolist())) > last:
            rows.append((k, text))
    assert len(rows) > 20
    rows += [(1000 + i, t) for i, t in enumerate(prose(50, 700 + k) for k in range(5))]
    docs = make_docs(rows)
    classes = prefixjoin.prefixes(docs.select("text"), np.zeros(prefixjoin.CELLS, np.uint32), 3, 90)
    assert classes.groupBy("group").count().agg({"count": "max"}).first()[0] > 20
    assert found(prefixjoin.similar_documents(docs)) == brute(rows)


def test_filters_lose_nothing():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 400)
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        keep = a[np.array([r.random() > 0.06 for _ in a])]
        b = np.unique(np.append(keep, np.array([r.getrandbits(64) for _ in range(r.randrange(0, 12))], np.uint64)))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert set(a[: prefixjoin.prefix_length(len(a), 90)].tolist()) & set(b[: prefixjoin.prefix_length(len(b), 90)].tolist())
            assert len(a) + len(b) - both - both <= prefixjoin.most_apart(len(a), len(b), 90)
            x, y = (np.frombuffer(prefixjoin.parity_bits(s, 8), np.uint8) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= 10 * (len(a) + len(b)) // 190
            assert prefixjoin.halved(prefixjoin.parity_bits(a, 10)) == prefixjoin.parity_bits(a, 9)


def test_repeated_rows_and_no_rows(make_docs, prose):
    t = prose(50, 3)
    docs = make_docs([(1, t), (1, t), (2, t), (None, t), (5, None), (None, prose(40, 4)), (None, prose(40, 4) + " x")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in prefixjoin.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 48, 1), (1, 48, 1), (2, 48, 1), (None, 48, 1), (5, 0, 5), (None, 38, None), (None, 39, None)], key=str)
    assert prefixjoin.similar_documents(docs.limit(0)).count() == 0


def test_sizes_too_far_apart_share_no_bucket(spark, make_docs, prose, monkeypatch):
    opened = []
    written = prefixjoin.staged

    def counting(df, name):
        out = written(df, name)
        if name == "open":
            opened.append(out.count())
        return out

    monkeypatch.setattr(prefixjoin, "staged", counting)
    rows = [(k, "alpha beta gamma " + prose(int(12 * 1.4**k), 900 + k)) for k in range(12)]
    docs = make_docs(rows)
    monkeypatch.setattr(prefixjoin, "prefix_length", lambda n, percent: n)  # the shared shingle is in all prefixes
    assert found(prefixjoin.similar_documents(docs)) == brute(rows)
    assert opened == [0]
    r = random.Random(4)
    sizes = {k: r.choice([r.randrange(1, 60), r.randrange(1, 20_000)]) for k in range(400)}
    members = prefixjoin.staged(spark.createDataFrame([(k % 9, k, n, 0, 1) for k, n in sizes.items()], "bucket long, group long, n long, place int, classes long"), "buckets")
    parts = {(x.group, x.bucket) for x in prefixjoin.chained_buckets(members, 90).collect()}
    of = {}
    for g, b in parts:
        of.setdefault(g, set()).add(b)
    near = [(a, b) for a in sizes for b in sizes if a < b and a % 9 == b % 9 and 100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b])]
    assert len(near) > 50 and all(of[a] & of[b] for a, b in near)
    assert len({b for _, b in parts}) > 18
