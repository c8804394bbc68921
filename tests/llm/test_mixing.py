import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = con.execute(mixing.ORACLE)
    columns = [c[0] for c in twin.description]
    assert sorted(map(tuple, queries.op2_mix_sources(spark, SF).select(columns).collect())) == sorted(twin.fetchall())


def test_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, None: 7, "d": 0}
    src = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.source_targets(src).collect()}
    assert all(got[k] <= 3 * v + 1e-9 for k, v in sizes.items())
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert got["a"] == 30  # weight 5 of a small source: capped


def test_cut_and_epochs(make_docs, prose):
    rows = [(k, prose(10 + k % 7, k), "abc"[k % 3] if k % 10 else None) for k in range(60)] + [(100, None, "a"), (101, " ", None), (None, "x y z", "b"), (3, prose(13, 3), "a")]
    docs = make_docs(rows)
    got = mixing.mix_sources(docs, range_rows=4).select("doc_id", "source", "_mix.*").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(taken == int(target + 0.5) for taken, target in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs, range_rows=4).select("doc_id", "source", "_mix.*").collect()), key=str)
    mixed = mixing.mixed_documents(docs, range_rows=4)
    assert mixed.columns == docs.columns
    assert {(r._size, r._mix, r.row, r.cut) for r in mixed.collect()} == {(5, 4, "r", "c")}
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c ", 2), ("a b", 1), ("x", 1)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b", "a", "x"]
