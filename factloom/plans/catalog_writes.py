"""Registered queries that delete, accept and look up: recursion, observed writes, key filters and table functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import bloom, maintenance, registry
from factloom.plans.catalog import Tables, _docs, query
from factloom.sources.shared import shared_path
from factloom.sources.textfiles import TextFiles


@query("""
SELECT 'doc_' || doc_id::VARCHAR AS title, CASE WHEN doc_id % 3 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS extension, length(t)::BIGINT AS length, md5(t) AS text_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') || 'é' ELSE coalesce(text, '') || 'é' END AS t FROM documents)""")
def s1_text_files(t: Tables) -> DataFrame:
    """All documents as files and back: every third in Latin-1, every second with lines ended as on Windows; files with a leading dot stay out."""
    docs, spark, k = _docs(t), t("documents").sparkSession, F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("é"))
    text = F.when(k % 2 == 0, F.regexp_replace(text, "\n", "\r\n")).otherwise(text)
    plain = F.concat(F.regexp_replace(F.expr("substr(_t, 1, char_length(_t) - 1)"), r"[^\x00-\x7F]", "?"), F.lit("é"))
    files = docs.withColumn("_t", text).select(
        F.concat(F.lit("doc_"), k.cast("string"), F.when(k % 2 == 0, ".MD").otherwise(".txt")).alias("filename"), F.when(k % 3 == 0, F.encode(plain, "ISO-8859-1")).otherwise(F.encode("_t", "UTF-8")).alias("content"), k.alias("_k")
    )
    hidden = files.where("_k % 7 = 0").withColumn("filename", F.concat(F.lit("."), "filename"))
    spark.dataSource.register(TextFiles)
    path = shared_path(spark, "texts")
    files.union(hidden).drop("_k").write.format(TextFiles.name()).mode("append").save(path)
    back = spark.read.format(TextFiles.name()).load(path)
    return back.select("title", "encoding", "extension", "length", F.md5("text").alias("text_md5"))


@query("""
WITH RECURSIVE gone(name, id) AS (SELECT 'company', s_suppkey::BIGINT FROM supplier WHERE s_suppkey % 10 = 0
 UNION SELECT r.name, r.id::BIGINT FROM gone g JOIN {references} r ON r.parent_name = g.name AND r.parent_id = g.id) SELECT name, id FROM gone""")
def t5_cascade_levels(t: Tables) -> DataFrame:
    """Companies, what hangs on them, investments in their rounds, and the investments that follow those, to any depth."""
    gone = t("supplier").where("s_suppkey % 10 = 0").select(F.lit("company").alias("name"), F.col("s_suppkey").cast("long").alias("id"))
    return maintenance.cascade_closure(gone, t("references").withColumn("id", F.col("id").cast("long")))


@query("""
SELECT id, CASE WHEN bad = '' THEN 'accepted' ELSE 'rejected' END AS outcome, bad AS violations FROM (
 SELECT id, array_to_string(list_filter([CASE WHEN id % 7 = 0 AND 40 * length(title) > 255 THEN 'title' END, CASE WHEN id % 5 = 0 THEN 'filename' END, CASE WHEN id % 11 = 0 AND 8 * length(mime_type) > 100 THEN 'mime_type' END, CASE WHEN id % 13 = 0 THEN 'file_size' END], lambda x: x IS NOT NULL), '|') AS bad FROM {files})""")
def t6_accept_and_reject(t: Tables) -> DataFrame:
    """Rows held against the limits of a document; both sides come from what one pass has written."""
    k = F.col("id")
    rows = t("files").select("id", F.when(k % 7 == 0, F.repeat("title", F.lit(40))).otherwise(F.col("title")).alias("title"), F.when(k % 5 == 0, "").otherwise(F.col("filename")).alias("filename"), F.when(k % 11 == 0, F.repeat("mime_type", F.lit(8))).otherwise(F.col("mime_type")).alias("mime_type"), F.when(k % 13 == 0, -1).otherwise(F.col("file_size")).alias("file_size"))
    good, bad, _ = maintenance.accept_and_reject(rows, maintenance.limits(rows.columns, maintenance.DOCUMENT_LENGTHS), "files")
    return good.select("id", F.lit("accepted").alias("outcome"), F.lit("").alias("violations")).union(bad.select("id", F.lit("rejected"), F.array_join("violations", "|")))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) OR text IS NULL")
def r12_unknown_hashes(t: Tables) -> DataFrame:
    hashed = _docs(t).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return bloom.unknown_rows(hashed, hashed.where("doc_id % 3 = 0").select("hash"), "hash").select("doc_id")


_SHOWN = re.compile(r"(?<![A-Za-z0-9_])[A-Z][a-z]+ly(?![A-Za-z0-9_])|[0-9]+%")


def _adverbs_and_shares(text: str):
    for m in _SHOWN.finditer(text):
        yield ("share" if m[0].endswith("%") else "adverb"), m.start(), m.end()


@query("""
SELECT doc_id, 'shares' AS extractor, 'share' AS field_name, (strpos(text, 'EBITDA margin ') + 13)::INTEGER AS start_offset, (strpos(text, 'EBITDA margin ') + 14 + length((doc_id % 40)::VARCHAR))::INTEGER AS end_offset, (doc_id % 40)::VARCHAR || '%' AS text FROM {memos} WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'shares', 'adverb', (strpos(text, 'Currently ') - 1)::INTEGER, (strpos(text, 'Currently ') + 8)::INTEGER, 'Currently' FROM {memos} WHERE doc_id % 2 = 0 AND doc_id % 3 <> 2""")
def u1_custom_extractor(t: Tables) -> DataFrame:
    """A caller's extractor: its struct decides which documents it supports, its function shows where."""
    known = registry.Extractors()
    known.add("shares", lambda df: F.regexp_count("text", F.lit("[0-9]+%")), F.col("doc_id") % 2 == 0)
    known.add_evidence("shares", _adverbs_and_shares)
    own = known.apply(t("memos")).where("extras.shares > 0")
    return known.evidence(own)
