"""Matches of a pattern with their offsets, in code points, as built-in column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of all matches, in order; the marker character counts as a space in the text.

    The pattern has no groups that matter: each match is set between markers
    and the text is split there, so that lengths give offsets.
    """
    parts = F.split(F.regexp_replace(F.translate(text, MARK, " "), pattern, f"{MARK}$0{MARK}"), MARK)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("is_match"), F.array().cast("array<struct<text: string, start: int, end: int>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        after = acc["at"] + F.char_length(part)
        one = F.array(F.struct(part.alias("text"), acc["at"].alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), (~acc["is_match"]).alias("is_match"), F.when(acc["is_match"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, zero, step, lambda acc: acc["found"])


def line_spans(text: Column) -> Column:
    """array<struct<start_offset, end_offset>> of the lines of a text, without their ends, in time linear in the text."""
    kind = pa.list_(pa.struct([("start_offset", pa.int32()), ("end_offset", pa.int32())]))

    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            if (text := t.as_py()) is None:
                out.append(pa.nulls(0, kind.value_type))
                continue
            sizes = np.fromiter(map(len, text.split("\n")), np.int32)
            ends = np.cumsum(sizes + 1, dtype=np.int32) - 1
            out.append(pa.StructArray.from_arrays([pa.array(ends - sizes), pa.array(ends)], names=["start_offset", "end_offset"]))
        lengths = np.fromiter(map(len, out), np.int32, len(out))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.concat_arrays(out) if out else pa.nulls(0, kind.value_type))

    return F.arrow_udf(spans, "array<struct<start_offset: int, end_offset: int>>")(text)


def line_bounds(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last offset (excluded) of the line or lines that a span touches."""
    head = F.substring(text, F.lit(1), start)
    begin = start - F.char_length(F.substring_index(head, "\n", -1))
    return begin, end + F.char_length(F.substring_index(F.substring(text, end + 1, F.char_length(text)), "\n", 1))


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def line_context(text: Column, start: Column, end: Column) -> Column:
    return between(text, *line_bounds(text, start, end))


def clipped_context(text: Column, start: Column, end: Column, window: int = 40) -> Column:
    """The line of a span, at most window characters to either side."""
    begin, stop = line_bounds(text, start, end)
    return between(text, F.greatest(begin, start - window), F.least(stop, end + window))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    return F.lower(F.upper(text))
