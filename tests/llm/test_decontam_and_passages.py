import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import decontam, passages, queries

SF = "/root/testdata/sf0.001"


def held(docs, items, least=0.75):
    """Pairs by shingle share alone."""
    own = {i: decontam.shingles(decontam.tokens(t)) for i, t in items}
    index = defaultdict(set)
    for i, s in own.items():
        for x in s:
            index[x].add(i)
    out = set()
    for d, t in docs:
        c = Counter(i for x in decontam.shingles(decontam.tokens(t)) for i in index.get(x, ()))
        out |= {(d, i) for i, n in c.items() if n >= least * len(own[i])}
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op8_benchmark_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == held(docs, items) != set()


def test_search_equals_full_scoring(prose):
    items = [(k, prose(20 + 13 * (k % 9), k, 60)) for k in range(150)]
    index = decontam.ItemIndex(items, block=8)
    for seed in range(30):
        pairs = index.lookup(decontam._pairs(decontam._hashes(prose(60, 900 + seed, 60).split())))
        query = sorted({int(t) for t in pairs if t < len(index.terms)})
        full = Counter()
        for t in query:
            for k, x in index.postings[t]:
                full[k] += x
        for threshold in (0.05, 0.1, 0.3):
            want = {k for k, x in full.items() if x >= threshold - 1e-9}
            assert {k for k, _ in index.search(query, threshold)} == want


def test_odd_rows(spark, make_docs, prose, odd_texts):
    items = [(1, prose(30, 50) + ". " + prose(8, 51) + "."), (2, None), (3, ""), (4, "two words"), (5, prose(400, 52))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = [*enumerate(odd_texts), (20, prose(300, 53) + " " + items[0][1].upper() + prose(300, 54)), (21, items[4][1]), (22, prose(30, 50)), (None, items[0][1]), (20, items[0][1])]
    docs = make_docs(rows)
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, tests, part_bytes=500).collect()), key=str)
    assert got == sorted([(4, 4), (20, 1), (20, 1), (21, 5), (None, 1)], key=str)
    clean = decontam.clean_documents(docs, tests, part_bytes=500)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len(got)
    assert decontam.contaminated(docs, tests.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), tests).count() == 0


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_verbatim_passages_are_found(spark):
    first, want = {}, defaultdict(set)
    docs = {r.doc_id: passages._words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()}
    for d, w in docs.items():
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), d) != d:
                want[d].update(range(k, k + 50))
    rows = queries.op9_repeated_passages(spark, SF).collect()
    got = covered(rows)
    assert set(want) <= set(got)
    for d, places in want.items():
        assert len(places - got[d]) <= 10
    for r in rows:  # every row is what it says
        a, b = (set(passages._shingles(docs[i][s:e]).tolist()) for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.match_id, r.match_start, r.match_end)))
        assert r.match_id < r.doc_id
        assert r.end_word - r.start_word >= 50
        assert len(a & b) >= 0.75 * len(a | b)


def test_hot_near_and_odd_passages(make_docs, prose, odd_texts):
    p = prose(80, 60)
    near = p.split()
    near[40] = "changed"
    rows = [*enumerate(odd_texts[:8])]
    rows += [(100 + k, prose(100, 300 + k) + " " + (p if k % 3 else " ".join(near)) + " " + prose(60, 400 + k)) for k in range(40)]
    docs = make_docs(rows)
    got = covered(passages.repeated_passages(docs).collect())
    assert all(len(got[100 + k] & set(range(100, 180))) >= 70 for k in range(1, 40))
    assert not any(k in got for k in range(8))
    twice = passages.repeated_passages(make_docs([(1, p), (1, p), (2, p), (None, p)])).collect()
    assert sorted(((r.doc_id, r.match_id) for r in twice), key=str) == sorted([(1, None), (2, None)], key=str)
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_compact_windows():
    import numpy as np

    values = np.array([5, 3, 9, 3, 7, 0, 4, 8], np.uint64)
    nodes = np.array([0, 1, 3, 4, 6])
    low, high = passages.compact_windows(values, nodes)
    assert list(zip(low.tolist(), high.tolist())) == [(0, 1), (0, 5), (2, 5), (4, 5), (6, 8)]


def test_passages_that_the_first_document_of_a_key_lacks(make_docs, prose):
    def keys(text):
        return set(passages.joint_windows([passages._shingles(passages._words(text))], 46, range(1))[1].tolist())

    def rows(seed):  # the first document holds 30 of the 50 words, among others
        p = prose(50, seed)
        short = " ".join(p.split()[10:40])
        texts = [prose(80, seed + 1) + " " + short + " " + prose(80, seed + 2), prose(70, seed + 3) + " " + p + " " + prose(90, seed + 4), prose(60, seed + 5) + " " + p]
        return texts if keys(p) <= keys(texts[0]) else None

    texts = [next(x for seed in range(base, base + 10_000, 10) if (x := rows(seed))) for base in (10_000, 20_000)]
    own = [texts[1][0] + " " + texts[1][1], texts[1][2]]  # the fragment and then the full copy in one document
    got = {(r.doc_id, r.match_id) for r in passages.repeated_passages(make_docs([*enumerate(texts[0]), *enumerate(own, 10)]), bands=1).collect()}
    assert got == {(2, 1), (11, 10)}
    many = [(k, prose(80, 40_000 + 2 * k) + " " + " ".join(texts[0][2].split()[70:100]) + " " + prose(80, 40_001 + 2 * k)) for k in range(40)]
    got = {(r.doc_id, r.match_id) for r in passages.repeated_passages(make_docs([*many, (50, texts[0][1]), (51, texts[0][2])]), bands=1, large=4, block=8).collect()}
    assert got == {(51, 50)}


def test_swapped_passages_give_a_row_each():
    a, b, c = ([b"%d" % k for k in range(x, x + 60)] for x in (0, 100, 200))
    got = sorted(x[:4] for x in passages.measure(c + a + b, b + a, 50, 75))
    assert got == [(60, 120, 60, 120), (120, 180, 0, 60)]


def test_recall_of_passages_near_the_border(make_docs, prose):
    for changed, least in (((30, 31, 32, 33, 70), 0.75), ((30, 70), 0.8)):
        rows = []
        for k in range(400):
            p = prose(100, 1000 + k, 10**6).split()
            q = [f"x{k}_{i}" if i in changed else w for i, w in enumerate(p)]
            a, b = set(passages._shingles(passages._words(" ".join(p))).tolist()), set(passages._shingles(passages._words(" ".join(q))).tolist())
            assert least <= len(a & b) / len(a | b) < least + 0.02
            rows += [(2 * k, " ".join(p) + " " + prose(60, 5000 + k, 10**6)), (2 * k + 1, prose(60, 9000 + k, 10**6) + " " + " ".join(q))]
        got = {(r.doc_id, r.match_id) for r in passages.repeated_passages(make_docs(rows)).collect()}
        assert got == {(2 * k + 1, 2 * k) for k in range(400)}


def _variants(prose, clusters=20, members=6):
    """Clusters of copies of a passage of 80 words, each with a change of its own and in a text of its own; the passage itself is in none."""
    rows = []
    for c in range(clusters):
        p = prose(80, 50_000 + c, 10**6).split()
        for m in range(members):
            q = [f"y{c}_{m}" if i == 7 + 13 * m else w for i, w in enumerate(p)]
            rows.append((c * members + m, prose(50 + m, 60_000 + c * members + m, 10**6) + " " + " ".join(q) + " " + prose(40, 70_000 + c * members + m, 10**6)))
    return rows


def test_variants_without_their_original_all_link(make_docs, prose):
    rows = _variants(prose)
    words = [passages._words(t) for _, t in rows]
    expect = {i for i in range(len(rows)) if any(passages.measure(words[i], words[j], 50, 75) for j in range(i - i % 6, i))}
    found = passages.repeated_passages(make_docs(rows)).collect()
    assert len(expect) > 90
    assert {r.doc_id for r in found} == expect
    assert all(passages.measure(words[r.doc_id], words[r.match_id], 50, 75) for r in found)


def test_the_result_does_not_depend_on_files(spark, make_docs, prose, tmp_path):
    docs = make_docs(_variants(prose, clusters=6))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.repartition(7).write.parquet(str(tmp_path / "seven"))
    one, seven = (sorted(map(tuple, passages.repeated_passages(spark.read.parquet(str(tmp_path / n))).collect())) for n in ("one", "seven"))
    assert one == seven and one


def test_changes_at_a_passage_s_edges(make_docs, prose):
    rows = []
    for k in range(100):
        p = prose(50, 80_000 + k, 10**6).split()
        q = [f"z{k}" if i == (1, 0, 48, 49)[k % 4] else w for i, w in enumerate(p)]
        rows += [(2 * k, prose(30, 81_000 + k, 10**6) + " " + " ".join(p) + " " + prose(60, 82_000 + k, 10**6)), (2 * k + 1, prose(60, 83_000 + k, 10**6) + " " + " ".join(q) + " " + prose(20, 84_000 + k, 10**6))]
    got = {(r.doc_id, r.match_id) for r in passages.repeated_passages(make_docs(rows)).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(100)}


def test_few_open_windows_of_a_large_key_do_not_multiply_its_members(spark):
    windows = spark.range(5003).selectExpr("7L key", "id uid", "0 low", "id < 3 open", "3L n_open", "5000L n_members")
    dealt = passages._dealt(windows, 512, 512, 64)
    rows = {r.open: r for r in dealt.groupBy("open").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.countDistinct("uid").alias("uids")).collect()}
    assert (rows[False].n, rows[False].uids) == (5000, 5000)  # each was sent to all ten blocks before
    assert (rows[True].n, rows[True].uids, rows[True].tasks) == (30, 3, 10)
    pairs = dealt.where("open").alias("a").join(dealt.where("not open").alias("b"), "task").groupBy(F.col("a.uid"), F.col("b.uid")).count()
    assert (pairs.count(), pairs.where("count != 1").count()) == (15000, 0)


def _of_runs(seed, n):
    """Words in runs, as texts of junk have them."""
    r = random.Random(seed)
    return [w for _ in range(n) for w in [r.choice(("the", "a", "of", f"x{seed}_{r.randrange(10**6)}"))] * r.randrange(10, 40)]


def test_a_run_of_one_word_gives_few_windows():
    words = ["the"] * 600 + [f"x{k}" for k in range(100)] + ["of"] * 600
    key = passages.joint_windows([passages._shingles([w.encode() for w in words])], 46, range(1))[1]
    assert len(key) < 50 and max(Counter(key.tolist()).values()) <= 6  # 555 before: one for each start in a run


def test_passages_of_runs_are_found_at_every_shift(make_docs):
    for seed in range(6):
        copies = []
        for k, (before, after) in enumerate(((3, 7), (25, 1), (40, 40), (0, 30))):  # runs of other lengths at the passage's ends
            inner = _of_runs(seed, 6)
            copies.append((10 * seed + k, " ".join(_of_runs(1000 + 10 * seed + k, 3) + ["the"] * before + ["edge"] * 12 + inner + ["the"] * after + _of_runs(2000 + 10 * seed + k, 3))))
        got = covered(passages.repeated_passages(make_docs(copies)).collect())
        for k, t in copies[1:]:
            w = t.split()
            start = w.index("edge")
            assert len(set(range(start, start + 12 + len(_of_runs(seed, 6)))) - got[k]) <= 10


def test_hashes_of_words_in_bytes():
    r = random.Random(5)
    for _ in range(200):
        data = bytes(r.choice(b"ab \n\t\x0b\x0c\r\x1c\x85\xa0xyz") for _ in range(r.randrange(300))) + b"z" * r.choice((0, 0, 7, 8, 9, 64, 65, 200))
        h, at = passages._hashes(data)
        words = data.split()
        assert [data[a : a + len(w)] for a, w in zip(at.tolist(), words)] == words and len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words))
        assert all(passages._hashes(w)[0].tolist() == [x] for w, x in zip(words, h.tolist()))


def test_common_anchors_equal_brute_force(spark, make_docs, prose):
    shared = [prose(60, 600 + k, 10**6) for k in range(30)]
    rows = [(k, prose(40, 700 + k, 10**6) + " " + shared[k % 30] + " " + "the " * (k % 50) + prose(30, 800 + k, 10**6)) for k in range(90)]
    rows += [(100 + k, rows[k][1]) for k in range(20)]  # copies are no second class
    scanned = passages._scanned(make_docs(rows).selectExpr("doc_id uid", "text").repartition(3), 46).persist()
    got = scanned.where("hashes is not null").groupBy("bucket").applyInArrow(passages._common, "class long, places binary").union(scanned.where("uid is null and hashes is null").select("class", "places"))
    places = defaultdict(set)
    for r in got.collect():
        places[r["class"]].update(np.frombuffer(bytes(r.places), np.int32).tolist())
    of_class = {r.uid: r["class"] for r in scanned.where("uid is not null").collect()}
    holders, at = defaultdict(set), defaultdict(set)
    for k, t in rows:
        s = passages._shingles(passages._words(t))
        for p in set(passages._least(passages._order(s, passages._SEEDS[0]), passages.ANCHOR).tolist()):
            holders[int(s[p])].add(of_class[k])
            at[of_class[k]].add((p, int(s[p])))
    assert places == {c: found for c, ps in at.items() if (found := {p for p, x in ps if len(holders[x]) > 1})}
