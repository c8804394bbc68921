"""Every occurrence of a phrase, with the line that holds it and what stands around it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import joins

_KIND = pa.struct([("start_offset", pa.int32()), ("end_offset", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("context", pa.string())])


def occurrence_spans(text: Column, phrase: str, window: int = 40) -> Column:
    """array<struct> of all occurrences of a phrase, left to right and apart from each other, in time linear in the text.

    Each has the bounds of the lines that it touches and, as context, these
    lines up to window characters to either side.  A null text gives null, an
    empty one an empty array.
    """
    if not phrase:
        raise ValueError("an empty phrase occurs everywhere")

    def of_one(t: str) -> list[dict]:
        starts, at = [], t.find(phrase)
        while at >= 0:
            starts.append(at)
            at = t.find(phrase, at + len(phrase))
        if not starts:
            return []
        s = np.array(starts)
        e = s + len(phrase)
        breaks = np.cumsum(np.fromiter(map(len, t.split("\n")), np.int64) + 1) - 1  # the end of every line
        first, last = np.searchsorted(breaks, s), np.searchsorted(breaks, e)
        begin, stop = np.where(first > 0, breaks[first - 1] + 1, 0), breaks[last]
        lo, hi = np.maximum(begin, s - window), np.minimum(stop, e + window)
        return [dict(start_offset=a, end_offset=b, line_start=c, line_end=d, context=t[x:y]) for a, b, c, d, x, y in zip(*(v.tolist() for v in (s, e, begin, stop, lo, hi)))]

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of_one(t) for t in texts.to_pylist()], pa.list_(_KIND))

    return F.arrow_udf(found, "array<struct<start_offset: int, end_offset: int, line_start: int, line_end: int, context: string>>")(text)


def occurrences(docs: DataFrame, phrase: str, window: int = 40, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, start_offset, end_offset, line_start, line_end, context, chunk_idx) of every occurrence in docs (doc_id, text).

    The chunk is the first of fixed size that holds the whole occurrence; it
    follows from the offsets, so nothing is shuffled.
    """
    n = F.char_length("text")
    n_chunks = F.when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1)
    each = docs.where(F.contains("text", F.lit(phrase))).select("doc_id", n_chunks.alias("n_chunks"), F.inline(occurrence_spans(F.col("text"), phrase, window)))
    return joins.containing_chunk(each, size, overlap).drop("n_chunks")
