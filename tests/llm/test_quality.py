import re


from factloom.llm import quality, queries

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = {}
    for k in range(len(ws) - 7):
        windows.setdefault(tuple(ws[k : k + 8]), []).append(k)
    repeated = {j for places in windows.values() if len(places) > 1 for k in places for j in range(k, k + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = len(ws)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed)


def test_base_counts_match_brute_force(spark):
    rows = queries.op10_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_good_documents_stay_and_junk_goes(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op10_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_odd_rows(make_docs, odd_texts):
    docs = make_docs([(k if k else None, t) for k, t in enumerate(odd_texts)])
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for k, t in enumerate(odd_texts):
        assert (got[k or None].n_words, got[k or None].n_repeat_words) == (base(t)[0], base(t)[4])
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_distance():
    import numpy as np

    assert quality.js_distances(np.array([[1, 1], [2, 0]]), np.array([1, 1]))[0] == 0
    assert abs(quality.js_distances(np.array([[5, 0]]), np.array([0, 3]))[0] - 1) < 1e-12
