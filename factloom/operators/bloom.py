"""A Bloom filter of known keys, made by aggregation, that keeps new rows out of the join with a large stored set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 5
#: Bits for each key, and of a filter at most: 8 MB, whatever the stored set. Beyond that the filter only lets more pass.
BITS_A_KEY, MOST_BITS = 12, 1 << 26


def _places(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


def key_filter(known: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(one row with the filter as array<long>, its number of bits, a power of two)."""
    bits = 1 << 10
    n = known.count()
    while bits < min(BITS_A_KEY * n, MOST_BITS):
        bits *= 2
    place = F.explode(F.array(*_places(F.col(key), bits))).alias("place")
    words = known.where(F.col(key).isNotNull()).select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = known.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("filter")), bits


def maybe_known(key: Column, held: Column, bits: int) -> Column:
    """False only for keys that are surely not in the filter."""
    out = F.lit(True)
    for place in _places(key, bits):
        word = F.get(held, F.shiftright(place, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def split_by_key(incoming: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the filter lets pass, rows that are surely new): both by a filter on the scan, before any exchange; null keys are new."""
    one, bits = key_filter(known, key)
    held = F.coalesce(maybe_known(F.col(key), one.scalar(), bits), F.lit(False)) & F.col(key).isNotNull()
    return incoming.where(held), incoming.where(~held)


def unknown_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of incoming whose key is not in known; only those that the filter lets pass meet the stored set."""
    maybe, new = split_by_key(incoming, known, key)
    return maybe.join(known.select(key), key, "left_anti").unionByName(new)
