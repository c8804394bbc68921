"""Periodic runs of words: suffix classes united by falling common prefixes, neighbours of a class as seeds.

A run is a stretch of words of smallest period q, of at least ``least`` words
and ``times`` periods, that no neighbouring word extends.  Suffixes of a text
are sorted by prefix doubling; their neighbours in that order, taken by
falling length L of common prefix, unite classes of suffixes (Kruskal).  A
class is an ordered set of places; when two are united, a place of one and a
place of the other that become neighbours at a distance d have a common prefix
of exactly L.  With L at least (times - 1) * d they start d + L words of
smallest period d that no word extends to the right; if the words before
them differ, the left end is free, too, and this is a run.

Every run is found: its start and the place one period on have a common
prefix of length - period, and no place between them is in their class, as
that would give a smaller period.

A run's seeds repeat at least ``gram`` words (16 for 24 words and 3 periods),
so only words in such a repeat take part in the sort, the others stand for
ends that equal nothing; a text without a repeat costs one sort of hashes.

Defined cases: a null, empty or blank text has no words and no runs; a text of
one word repeated is one run of period 1; equal rows and rows of one id are
worked each by itself; an empty table gives no rows; other columns are
ignored, whatever their names.  One text's places are worked in one task, in
memory of some hundred bytes a word that repeats.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

_P = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(4096)], np.uint64)


def repeated(words: list[bytes], width: int) -> np.ndarray:
    """A mask of the words inside a stretch of so many words that occurs again."""
    n = len(words) - width + 1
    inside = np.zeros(len(words) + 1, np.int64)
    if n < 2:
        return inside[:-1] > 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    g = np.zeros(n, np.uint64)
    for k in range(width):
        g += h[k : k + n] * _P[k]
    s = np.sort(g)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g)
        inside[at] += 1
        inside[at + width] -= 1
    return np.cumsum(inside)[:-1] > 0


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of x in order, and the common prefix of each with the next."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.ones(n, bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    open_ = order[~(new & np.append(new[1:], True))]  # places that share their class
    while len(open_):
        beyond = open_ + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((second, rank[open_]))
        open_, first, second = open_[by], rank[open_][by], second[by]
        at = np.arange(len(open_))
        old = np.ones(len(open_), bool)
        old[1:] = first[1:] != first[:-1]
        new = old.copy()
        new[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        levels.append(rank.astype(np.int32))
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b = sa[:-1], sa[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        same = (x < n) & (y < n)
        same &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        common += same * (1 << k)
    return sa, common


def neighbours(sa: np.ndarray, common: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(place, next place, common prefix) of places that become neighbours in a class while near enough for a run."""
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    of: dict[int, int] = {}  # rank to the class's name, as a forest
    held: dict[int, list[int]] = {}
    place = sa.tolist()

    def top(k: int) -> int:
        root = k
        while (up := of.get(root, root)) != root:
            root = up
        while k != root:
            of[k], k = root, of.get(k, k)
        return root

    for k, length in zip(edges.tolist(), common[edges].tolist()):
        a, b = top(k), top(k + 1)
        large, small = held.pop(a, None) or [place[a]], held.pop(b, None) or [place[b]]
        if len(large) < len(small):
            large, small = small, large
        near = length // (times - 1)
        last = len(small) - 1
        for t, p in enumerate(small):
            at = bisect_left(large, p)
            if at < len(large) and (q := large[at]) - p <= near and (t == last or small[t + 1] > q):
                yield p, q, length
            if at and p - (q := large[at - 1]) <= near and (t == 0 or small[t - 1] < q):
                yield q, p, length
        if len(small) < 8:
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()  # two ascending stretches, so a merge
        of[b] = a
        held[a] = large


def runs_of(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if len(words) < least:
        return []
    gram = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    at = np.flatnonzero(repeated(words, gram))
    if not len(at):
        return []
    gap = np.append(False, np.diff(at) > 1)
    to = np.arange(len(at)) + np.cumsum(gap)  # each gap is one separator that equals nothing
    x = np.arange(to[-1] + 1, dtype=np.int64) + len(at)
    kept = np.empty(len(at), object)
    kept[:] = [words[k] for k in at.tolist()]
    x[to] = pd.factorize(kept)[0]
    origin = np.full(len(x), -1, np.int64)
    origin[to] = at
    found = []
    for p, q, common in neighbours(*suffix_order(x), gram, times):
        period = q - p
        if common >= max(least - period, (times - 1) * period) and (p == 0 or x[p - 1] != x[q - 1]):
            found.append((int(origin[p]), period + common, period))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period), strongest, collapsed.

    ``strongest`` is the run of the greatest length in periods, the first and
    shortest of equals; ``collapsed`` has the words left when each run keeps
    its first period.  ``rewrite(id, words)`` may change a text's words before.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_row = lambda r: dict(zip(("start", "length", "period"), r))
        for whole in batches:
            for b in slices(whole, 1):
                runs, best, left = [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    words = (t.as_py() or b"").split()
                    if rewrite is not None:
                        words = rewrite(d, words)
                    found = runs_of(words, least, times)
                    runs.append([as_row(r) for r in found])
                    best.append(as_row(min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))) if found else None)
                    left.append(b" ".join(collapsed(words, found)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(left, pa.binary())], names=["doc_id", "runs", "strongest", "collapsed"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    shape = "struct<start: long, length: long, period: long>"
    out = own.mapInArrow(find, f"doc_id {kind}, runs array<{shape}>, strongest {shape}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
