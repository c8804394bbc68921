"""Chunks, sections, keywords and titles of documents."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.keywords import class_scores
from factloom.functions.rules import CLASSES, STOP_WORDS
from factloom.functions.spans import strip


def chunk_text(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, idx, text, start_offset, end_offset): windows of size characters, each beginning overlap before the last one's end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in 0..size-1")
    step, n = size - overlap, F.char_length("text")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    more = 1 - (-overlap // step)  # pieces of one step that a chunk touches
    cut = docs.where(n > 0).select("doc_id", count.alias("n"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("pieces"))
    part = lambda i: F.left(F.array_join(F.slice("pieces", i + 1, F.lit(more)), ""), F.lit(size))
    each = cut.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), part)).alias("idx", "text"))
    return each.withColumns({"start_offset": F.col("idx") * step, "end_offset": F.col("idx") * step + F.char_length("text")})


def chunk_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with metadata: map of document_id, title and chunk_index."""
    titled = chunks.join(docs.select("doc_id", "title"), "doc_id", "left")
    return titled.withColumn("metadata", F.create_map(F.lit("document_id"), F.col("doc_id").cast("string"), F.lit("title"), F.col("title"), F.lit("chunk_index"), F.col("idx").cast("string"))).drop("title")


def sections(text: Column) -> Column:
    """Headings in first-seen order: lines that begin with '#', or end in ':' (without it)."""
    lines = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), strip)
    heads = F.transform(F.filter(lines, lambda x: x.startswith("#") | x.endswith(":")), lambda x: F.when(x.startswith("#"), x).otherwise(F.substring(x, F.lit(1), F.char_length(x) - 1)))
    return F.array_distinct(heads)


def keywords(docs: DataFrame, k: int = 20) -> DataFrame:
    """(doc_id, rank, word, n): the k most frequent words of each document, ties by word; counted within the row, so nothing is shuffled."""
    word, stop = re.compile(r"\b[A-Za-z]{2,}[A-Za-z0-9+\-]*\b"), frozenset(STOP_WORDS)
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def top(texts: pa.Array) -> pa.Array:
        counts = ({w: n for w, n in Counter(word.findall((t or "").lower())).items() if w not in stop} for t in texts.to_pylist())
        return pa.array([[{"word": w, "n": n} for w, n in nsmallest(k, c.items(), key=lambda x: (-x[1], x[0]))] for c in counts], kind)

    best = F.arrow_udf(top, "array<struct<word: string, n: long>>")(F.col("text"))
    return docs.select("doc_id", F.posexplode(best).alias("place", "best")).select("doc_id", (F.col("place") + 1).alias("rank"), "best.word", "best.n")


def document_title(title: Column, text: Column) -> Column:
    first = F.get(F.filter(F.transform(F.split(text, r"\R|[\x1c-\x1e]"), strip), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.nullif(strip(title), F.lit("")), first, F.lit("Untitled"))


def type_from_title(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(t.contains("pitch"), "Pitch Deck")
        .when(t.contains("term sheet"), "Term Sheet")
        .when(t.contains("shareholder") | t.contains("sha"), "Shareholders Agreement")
        .when(t.contains("financial"), "Financial Statement")
        .when(t.contains("cap table"), "Cap Table")
    )


def _ranked(scores: Column) -> Column:
    """The classes that have keywords, the most first."""
    each = F.transform(scores, lambda n, k: F.struct((-n).alias("low"), k.alias("place"), F.get(F.array(*(F.lit(name) for name, _ in CLASSES)), k).alias("name")))
    return F.array_sort(F.filter(each, lambda x: x["low"] < 0))


def _class_of(ranked: Column) -> Column:
    top, rest = F.get(ranked, F.lit(0)), F.transform(F.slice(ranked, 2, len(CLASSES)), lambda x: x["name"])
    sure = F.when(top.isNull(), 0.0).otherwise(F.least(F.lit(1.0), -top["low"] / F.lit(5.0)))
    return F.struct(top["name"].alias("document_type"), rest.alias("secondary"), sure.alias("confidence"))


def classify(text: Column) -> Column:
    """struct<document_type, secondary, confidence> by the number of keywords that occur anywhere in the text."""
    return _class_of(_ranked(class_scores(text)))


def classified(docs: DataFrame) -> DataFrame:
    """docs with class: classify(text), in steps that scan and rank each text once."""
    ranked = docs.select(F.struct("*").alias("row"), class_scores(F.col("text")).alias("scores")).select("row", _ranked(F.col("scores")).alias("ranked"))
    return ranked.select("row.*", _class_of(F.col("ranked")).alias("class"))
