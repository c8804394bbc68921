import duckdb

from factloom.llm import components, minhash, queries

SF = "/root/testdata/sf0.001"


def brute(docs):
    """doc_id to the least id of its component, by comparing all pairs of sets."""
    sets = {}
    for i, t in docs:
        w = [] if t is None else [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        n = min(5, len(w))
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
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(found, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute(docs)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op5_minhash_near_duplicates(spark, SF), docs)


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.op5_minhash_near_duplicates(spark, SF).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(minhash.ORACLE).fetchall())


def test_chains_hot_groups_and_odd_rows(make_docs, prose, odd_texts):
    rows = list(enumerate(odd_texts))
    w = prose(200, 9).split()
    for k in range(12):  # each is near the next, the ends are not near each other
        rows.append((100 + k, " ".join(w[k * 12 : 140 + k * 12])))
    passage = prose(90, 10)
    for k in range(80):  # one passage in all, at the border of being alike
        rows.append((200 + k, passage + " " + prose(10 + k % 25, 500 + k)))
    docs = make_docs(rows)
    check(minhash.near_duplicates(docs), rows)
    want = brute(rows)
    signed, groups = minhash.near_duplicate_classes(docs, large=8, block=16)  # hot buckets by blocks
    labels = {r["class"]: r.component for r in groups.withColumnRenamed("node", "class").collect()}
    by = {}
    for r in signed.collect():
        if r["class"] is not None:
            by.setdefault(labels.get(r["class"], r["class"]), set()).add(r.doc_id)
    assert sorted(map(sorted, by.values())) == sorted(sorted(i for i, x in want.items() if x[1] == c and x[0]) for c in {x[1] for x in want.values() if x[0]})
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_rows_and_no_rows(make_docs, prose):
    t = prose(50, 3)
    docs = make_docs([(1, t), (1, t), (2, t), (None, t), (5, None)])
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (5, 5, True)], key=str)
    assert [r.doc_id for r in minhash.without_near_duplicates(docs).orderBy("doc_id").collect()] == [1, 5]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_near_copies_without_an_id(make_docs, prose):
    w = prose(200, 70).split()
    near = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in (20, 90, 160)]
    other = prose(100, 71)
    with_id = make_docs([(None, near[0]), (1, near[1])])
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(with_id).collect()), key=str) == [(1, 1, True), (None, 1, False)]
    docs = make_docs([*((None, t) for t in near), (None, near[0].upper()), (None, other), (None, other), (None, ""), (7, prose(80, 72))])
    got = minhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    kept = [r.text for r in minhash.without_near_duplicates(docs).collect()]
    assert len(kept) == 4 and sum(t.lower() in near for t in kept) == 1
    assert sorted(t for t in kept if t.lower() not in near) == sorted(["", other, prose(80, 72)])


def test_rows_of_one_id_in_two_components(make_docs, prose):
    a, b = prose(60, 73), prose(60, 74)
    docs = make_docs([(0, a), (1, a), (1, b), (2, b)])
    assert sorted((r.doc_id, r.text) for r in minhash.without_near_duplicates(docs).collect()) == [(0, a), (1, b)]
