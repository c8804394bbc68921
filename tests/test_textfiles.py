"""Text files as a source and a sink, routing and naming, listings in order, and the stream of new documents."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import listing
from factloom.sources import documents
from factloom.sources.textfiles import TextFiles, split_name
from factloom.streaming import arrivals


@pytest.fixture(scope="module")
def load(spark):
    spark.dataSource.register(TextFiles)
    return lambda path, **options: spark.read.format("text_documents").options(**options).load(str(path))


def test_reading(load, tmp_path):
    files = {"a.TXT": "café\r\nx\ry".encode("latin-1"), "_b.md": "café\n".encode(), "empty.txt": b"", ".hidden.txt": b"no", "none": b"\xef\xbb\xbfz", "dot.": b"q", "long.text": b"word " * 400_000}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    for folder in ("sub", ".git"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "c.md").write_bytes(b"sub")
    got = {r.filename: (r.title, r.text, r.encoding, r.extension, r.length) for r in load(tmp_path, groupBytes=10).collect()}
    assert got.pop("long.text")[4] == 2_000_000
    assert got == {
        "a.TXT": ("a", "café\nx\ny", "latin-1", "txt", 8), "_b.md": ("_b", "café\n", "utf-8", "md", 5), "empty.txt": ("empty", "", "utf-8", "txt", 0), "none": ("none", "﻿z", "utf-8", "", 2), "dot.": ("dot.", "q", "utf-8", "", 1), "c.md": ("c", "sub", "utf-8", "md", 3),
    }
    assert {r.filename for r in load(tmp_path, extensions=".MD, text", recursive="false").collect()} == {"_b.md", "long.text"}
    assert load(tmp_path / "_b.md").first().text == "café\n"
    assert load(tmp_path, groupBytes=10).rdd.getNumPartitions() == 4
    assert load(tmp_path).rdd.getNumPartitions() == 1


def test_no_files(load, tmp_path):
    assert load(tmp_path).count() == 0
    with pytest.raises(Exception, match="does not exist|not found|No such"):
        load(tmp_path / "missing").count()


def test_writing(spark, load, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("n"), "id", F.lit(".txt")).alias("filename"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("é"), "id")).alias("text"), F.lit(1).alias("other"))
    target = tmp_path / "out"
    for part in (rows.where("id < 60").repartition(3), rows.where("id >= 60").repartition(2), rows.limit(0)):
        part.write.format("text_documents").mode("append").save(str(target))
    got = {r.filename: r.text for r in load(target).collect()}
    assert got == {f"n{k}.txt": f"é{k}" if k % 2 == 0 else "" for k in range(100)}
    assert sum(name.startswith(".") for name in os.listdir(target)) == 0
    before = sorted(os.listdir(target))
    for bad in ("''", "'a/b'", "'twice'", "'..'", "cast(null as string)"):
        with pytest.raises(Exception, match="name of its own"):
            rows.select(F.expr(bad).alias("filename"), "text").coalesce(1).write.format("text_documents").mode("append").save(str(target))
    with pytest.raises(Exception, match="need a filename"):
        rows.select("filename").write.format("text_documents").mode("append").save(str(target))
    with pytest.raises(Exception, match="only added"):
        rows.write.format("text_documents").mode("overwrite").save(str(target))
    assert sorted(os.listdir(target)) == before


def test_bytes_are_written_as_they_are(spark, load, tmp_path):
    spark.createDataFrame([("x.txt", bytearray(b"\xe9\r\n"), "left out")], "filename string, content binary, text string").write.format("text_documents").mode("append").save(str(tmp_path / "o"))
    assert load(tmp_path / "o").select("text", "encoding").first() == ("é\n", "latin-1")


def test_names(spark):
    names = ["a.b.TXT", ".hidden", "dot.", "plain", "x.Md", "..a", "é.text"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", documents.stem(F.col("n")), documents.suffix(F.col("n"))).collect()
    assert [tuple(r)[1:] for r in rows] == [split_name(n) for n in names] == [("a.b", "txt"), (".hidden", ""), ("dot.", ""), ("plain", ""), ("x", "md"), (".", "a"), ("é", "text")]


def test_title_case_is_that_of_python(spark):
    texts = ["q1 financials", "term-sheet", "3d MODEL v2", "don't", "été à L'ÎLE", "ǆ x", "", "日本a b", "ΣΑΣ", "  two  spaces"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.title_case(F.col("t"))).collect()]
    assert got == [t.title() for t in texts]


def test_routes(spark):
    cases = [("text/plain", "x.bin", "text"), ("TEXT/PLAIN", "x.bin", None), ("text/csv", "x.csv", None), (None, "x.TEXT", "text"), ("application/pdf", "x.md", "text"), ("application/pdf", "x", "pdf"), ("application/pdf", None, "pdf"), (None, "x.DOCX", "docx"), (None, None, None)]
    df = spark.createDataFrame(cases, "m string, f string, want string")
    assert [r[0] for r in df.select(documents.route(F.col("m"), F.col("f"))).collect()] == [c[2] for c in cases]
    with pytest.raises(Exception, match="no handler for text/csv x.csv"):
        df.where("m = 'text/csv'").select(documents.route(F.col("m"), F.col("f"), strict=True)).collect()


def test_titles_of_files(spark):
    cases = [("pdf", "Untitled", "f"), ("pdf", "\tNONE\n", "f"), ("docx", " Untitled ", "Untitled"), ("docx", " ", "f"), ("docx", None, "f"), ("pdf", " Deck ", "Deck")]
    df = spark.createDataFrame(cases, "k string, t string, want string")
    assert [r[0] for r in df.select(documents.resolve_title(F.col("k"), F.col("t"), F.lit("f.pdf"))).collect()] == [c[2] for c in cases]


def test_metadata_of_a_hidden_file_is_missing(spark):
    files = spark.createDataFrame([(".a.txt",), ("b_c.txt",)], "filename string")
    given = spark.createDataFrame([(".a.txt", "x", None), ("b_c.txt", "", None)], "filename string, given_title string, given_type string")
    docs, missing = documents.discover(files, given)
    assert [tuple(r) for r in docs.collect()] == [("b_c.txt", "B C", "OTHER")]
    assert [r.filename for r in missing.collect()] == [".a.txt"]


def test_document_listings_are_newest_first(spark):
    rows = spark.createDataFrame([(1, 5, "A", "NEW", "beta", 10), (2, 5, "B", "NEW", "alpha", 30), (3, 6, "A", "OLD", "Alps", 20)], "id int, startup_id int, document_type string, status string, title string, created_at int")
    ids = lambda **f: [r.id for r in listing.documents(rows, **f).collect()]
    assert (ids(), ids(startup_id=5), ids(document_type="A"), ids(status="NEW"), ids(document_type="A", status="NEW")) == ([2, 3, 1], [2, 1], [3, 1], [2, 1], [1])
    assert ids(search="AL") == [3, 2]


def test_stream_of_new_documents(spark, tmp_path):
    rows = spark.sql("SELECT cast(id % 3 AS string) AS body, timestamp_seconds(1000 + id) AS at FROM range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = arrivals.new_by_hash(stream, "body", "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2"]
