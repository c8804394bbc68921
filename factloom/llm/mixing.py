"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a random but repeatable key, a hash of its id.  Within a
source the keys cut the documents into ranges of about equal numbers; a range
is sorted by key in one task, and the ranges' totals, summed in key order,
give each document the number of words before it in its whole source.  The
source's budget then ends at an exact word: documents before it are taken,
the one it falls in is cut, and a budget beyond the source's size takes the
source once or more as a whole before that.  No task holds a whole source:
ranges and rows in a range both grow with the square root of the source.

Defined cases: a null or blank text has size 0 and is never taken; a null
source is a source of its own, ordered last; a source of size 0 has target 0;
an empty table gives no rows; repeated rows count each (equal ids are ordered
by size; rows equal in both are alike in the result but for which of them is
cut); a null id is ordered by the key of the empty string; the other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3) -> DataFrame:
    """Add weight and target to rows (source, source_size), one per source.

    A common level times the weight, cut at cap times the size, so that the
    targets add up to share of all sizes: the level is found in one pass over
    the sources by the ratio at which they reach their cap.  These windows see
    one narrow row per source, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    found = F.min(fits).over(every)["level"]
    target = F.when(found.isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), found * F.col("weight")))
    return ranked.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    seed: str = "mix",
    range_rows: int = 1000,
) -> DataFrame:
    """All rows of docs with a column _mix: struct(size, source_size, target, taken), in place of one of that name.

    size names a column of sizes; without it the words of text are counted.
    """
    placed = _placed(docs, doc_id, source, text, size, weights, share, cap, seed, range_rows)
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "_mix"), F.col("mix").alias("_mix"))


def _placed(docs: DataFrame, doc_id: str, source: str, text: str, size: str | None, weights: tuple[int, ...], share: float, cap: int, seed: str, range_rows: int) -> DataFrame:
    """(row, mix): each row of docs as a struct, so that none of its names meets one of these."""
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731 - never null, so that windows and joins share one exchange
    rows = docs.select(F.struct("*").alias("row"), group(source).alias("group"), F.col(source).alias("source"), (F.col(size).cast("long") if size else word_count(F.col(text))).alias("size"), random_key(F.col(doc_id), seed).alias("key"))
    narrow = staged(rows.select("source", "group", "size", "key"), "mix-sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, cap)
    ranges = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(range_rows)), F.sqrt(F.col("n_docs").cast("double"))))
    targets = staged(targets.select(group("source").alias("group"), "source_size", "target", ranges.alias("ranges")), "mix-targets")

    def ranged(df: DataFrame) -> DataFrame:
        return df.join(targets.select("group", "ranges"), "group").withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")))

    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged(narrow).groupBy("group", "range").agg(F.sum("size").alias("total"))
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total").join(targets.drop("ranges"), "group")
    within = Window.partitionBy("group", "range").orderBy("key", F.col("row")[doc_id], "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged(rows).withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["group", "range"])
    budget = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - full * F.col("source_size") - F.col("before") - F.col("within")
    taken = (full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")
    return placed.select("row", F.struct("size", "source_size", "target", taken.alias("taken")).alias("mix"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end; all of it if it has no more words."""
    blank = r"[\x20\x09-\x0D]+"
    limit = n + F.when(text.rlike("^" + blank), 2).otherwise(1)
    parts = F.split(text, blank, limit)
    head = F.regexp_replace(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(F.element_at(parts, -1))), blank + "$", "")
    return F.when(F.size(parts) < limit, text).otherwise(head)


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    n_chars: str = "n_chars",
    size: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    seed: str = "mix",
    range_rows: int = 1000,
) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken, the last one cut where the budget ends."""
    mixed = _placed(docs, doc_id, source, text, size, weights, share, cap, seed, range_rows)
    size_, taken = F.col("mix.size"), F.col("mix.taken")
    copies = mixed.where(taken > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(taken / size_).cast("int"))))
    left = F.least(size_, taken - (F.col("copy") - 1) * size_).cast("int")
    whole, cut = F.col("row")[text], left < size_
    copies = copies.select("row", cut.alias("cut"), F.when(cut, first_words(whole, left)).otherwise(whole).alias("text"))
    new = {text: F.col("text"), n_chars: F.when(F.col("cut"), F.char_length("text").cast("long")).otherwise(F.col("row")[n_chars]) if n_chars in docs.columns else None}
    return copies.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 15))::BIGINT AS k
  FROM documents),
ranked AS (
  SELECT source, source_size, weight, 3 * source_size AS most, (3 * source_size)::DOUBLE / weight AS ratio
  FROM (SELECT source, sum(size)::BIGINT AS source_size,
               [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
        FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         least(most::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), 'inf'::DOUBLE) * weight) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN targets USING (source))
SELECT doc_id, size, source_size, target,
       ((budget // source_size) * size + greatest(0, least(size, budget % source_size - before)))::BIGINT AS taken
FROM placed
"""
