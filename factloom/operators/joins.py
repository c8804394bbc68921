"""Joins: bundles, parents, hashes, names, and ranges of offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.spans import squeeze


def bundle(parents: DataFrame, **children: DataFrame) -> DataFrame:
    """Parents (id, ...) with an array column of each child table (id, item), aggregated before the join."""
    for name, child in children.items():
        parents = parents.join(child.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias(name)), "id", "left")
    return parents


def parent_exists(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Children with a parent, and the rest."""
    keys = parents.select(key).distinct()
    return children.join(keys, key, "left_semi"), children.join(keys, key, "left_anti")


def tag_by_hash(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming with outcome: reused (hash is known), created (first of its hash), or duplicate."""
    first = incoming.groupBy("hash").agg(F.min("id").alias("_first"))
    have = known.select("hash").distinct().withColumn("_known", F.lit(True))
    out = incoming.join(first, "hash").join(have, "hash", "left")
    return out.withColumn("outcome", F.when(F.col("_known"), "reused").when(F.col("id") == F.col("_first"), "created").otherwise("duplicate")).drop("_first", "_known")


def reconcile_names(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, outcome): incoming names matched by case and white space; duplicate keys are errors."""
    key = F.lower(squeeze(F.col("name")))
    have = existing.select(key.alias("_k")).distinct().withColumn("_old", F.lit(True))
    n = incoming.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    out = incoming.withColumn("_k", key).join(n, "_k").join(have, "_k", "left")
    return out.select("id", "name", F.when(F.col("_n") > 1, "error").when(F.col("_old"), "reused").otherwise("created").alias("outcome"))


def overlapping(chunks: DataFrame, segments: DataFrame, width: int = 8192) -> DataFrame:
    """(doc_id, idx, seg_idx): chunks and segments that share a character; touching is not sharing, an empty segment
    shares what lies around it.

    An interval join by offset bins: both sides go to every bin of ``width``
    characters that they reach into, so one long document spreads over tasks
    and its work is linear in its length; a pair counts in the bin where the
    later of the two begins.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        to = lambda c: F.floor(c / width)
        bins = F.sequence(to(F.col("start_offset")), to(F.greatest("start_offset", F.col("end_offset") - 1)))
        return df.select("doc_id", F.col("idx").alias(name), F.col("start_offset").alias(f"{name}_from"), F.col("end_offset").alias(f"{name}_to"), F.explode(bins).alias("bin"))

    met = binned(chunks, "idx").join(binned(segments, "seg_idx"), ["doc_id", "bin"])
    shared = (F.col("idx_from") < F.col("seg_idx_to")) & (F.col("idx_to") > F.col("seg_idx_from"))
    return met.where(shared & (F.floor(F.greatest("idx_from", "seg_idx_from") / width) == F.col("bin"))).select("doc_id", "idx", "seg_idx")


def chunks_of_range(ranges: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """ranges (.., start_offset, end_offset, n_chars) with chunks: the indexes of the fixed chunks that share a character with the range, empty for an empty range."""
    step, n = size - overlap, F.col("n_chars")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
    low = F.greatest(F.lit(0), F.floor((F.col("start_offset") - size) / step) + 1)
    high = F.least(last, F.floor((F.least("end_offset", n) - 1) / step))
    some = (F.col("end_offset") > F.col("start_offset")) & (n > 0) & (F.col("start_offset") < n) & (low <= high)
    return ranges.withColumn("chunks", F.when(some, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>")))


def union_of_profiles(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (doc_id, seq, ..) of several documents as one sequence per company: documents (doc_id, company_id, doc_pos) in order, then seq."""
    joined = rows.join(documents, "doc_id")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy("doc_pos", "seq")))


def containing_chunk(spans: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """spans (.., start_offset, end_offset, n_chunks) with chunk_idx, the first fixed chunk that holds the span, null if none.

    Chunk i is [i*step, i*step+size), so the first candidate follows from the
    span's end and no join is needed; the last chunk's true end is shorter.
    """
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("end_offset") - size) / step)).cast("int")
    return spans.withColumn("chunk_idx", F.when((first * step <= F.col("start_offset")) & (first < F.col("n_chunks")), first))


def open_rounds(rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the one open round of each startup, startups with several)."""
    g = rounds.where(F.col("status") == "OPEN").groupBy("startup_id").agg(F.count("*").alias("n"), F.min("round_id").alias("round_id"))
    return g.where("n = 1").drop("n"), g.where("n > 1").select("startup_id", "n")


def page_of(rows: DataFrame, key: str, newest: str, id_: str, page: int, size: int) -> DataFrame:
    """A page of each key's rows, newest first, with totals and neighbours."""
    w = Window.partitionBy(key).orderBy(F.desc(newest), F.desc(id_))
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    out = rows.withColumn("rn", F.row_number().over(w)).where((F.col("rn") > (page - 1) * size) & (F.col("rn") <= page * size)).join(total, key)
    pages = F.ceil(F.col("total") / size)
    return out.withColumns({"total_pages": pages, "has_previous": F.lit(page > 1), "has_next": pages > page})
