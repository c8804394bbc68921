"""Exact substring removal by longest previous factors.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier (smaller id, or earlier in the same document): that is, in a window
whose longest previous factor reaches ``length``.  Previous factors are read
off suffix order: a suffix has an earlier match of that length exactly if,
among the suffixes beside it with that much in common, a previous or next one
has a smaller position.

Sorting all suffixes of a corpus is avoided in two exact steps.  Every window
has an anchor, its least-hashed 16 bytes, so equal windows have equal anchors,
and windows of one anchor in a row form a run.  (1) Runs of one anchor are
compared by hash: a run that equals an earlier one goes as a whole, first in
each batch, then over the corpus; an anchor with one run is unique.  (2) Only
runs that share an anchor but differ, the edges of repeats, are fetched as
bytes, and their suffixes are sorted by rank doubling, bucket by bucket.
Anchors with more edge runs than fit a task are exploded to windows and
grouped by a 128-bit hash instead.

Defined cases: a null or empty text has no bytes; matches do not cross
documents; rows alike in id and text are one document and get its result;
rows of one id and different texts are told apart, and ordered, by the hash of
the text; a null id comes first; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import staged

GRAM = 16
_SLICE = 1 << 20
_U = np.uint64
_MASK = _U(_SLICE - 1)
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, _U, endpoint=False)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


_BASE = 0x9E3779B97F4A7C15
_POW = _POW_INV = None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


class _Hasher:
    """Hashes of any stretch of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        global _POW, _POW_INV
        if _POW is None or len(_POW) < len(data):
            n = max(_SLICE, len(data))
            _POW, _POW_INV = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLE[data] * _POW[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        at = _POW_INV[start] if isinstance(start, np.ndarray) else _POW_INV[: start.stop]
        return _mix((self.sums[end] - self.sums[start]) * at)


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, windows, anchor's hash, the run's hash."""
    out: list[tuple[np.ndarray, ...]] = []
    batch: list[tuple[int, int, bytes]] = []  # text number, offset in it, bytes
    size = 0

    def flush() -> None:
        nonlocal batch, size
        data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
        lens = np.array([len(p) for _, _, p in batch])
        starts = np.cumsum(lens) - lens
        if len(data) >= length:
            h = _Hasher(data)
            n = len(data) - GRAM + 1
            grams = h.of(slice(0, n), slice(GRAM, n + GRAM))
            least, width = (grams & ~_MASK) | np.arange(n, dtype=_U), 1
            window = length - GRAM + 1
            while width < window:
                step = min(width, window - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            anchor = (least & _MASK).astype(np.int64)  # of each window start
            valid = np.zeros(len(anchor) + 1, bool)
            for s, k in zip(starts, lens):
                if k >= length:
                    valid[s : s + k - length + 1] = True
            valid[len(anchor)] = False
            cut = np.ones(len(anchor), bool)
            cut[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-2]
            first = np.flatnonzero(cut & valid[:-1])
            if len(first):
                ends = np.flatnonzero(valid[:-1] & ~np.append(valid[1:-1] & ~cut[1:], False))  # last window of each run
                number = ends - first + 1
                of = np.searchsorted(starts, first, "right") - 1
                a = anchor[first]
                run = _mix(h.of(first, ends + length) + (a - first).astype(_U) * _U(_BASE) + number.astype(_U))
                ids = np.array([b[0] for b in batch])[of]
                base = np.array([b[1] for b in batch])[of] - starts[of]
                out.append((ids, first + base, number, grams[a].view(np.int64), run.view(np.int64)))
        batch, size = [], 0

    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        at = 0
        while True:  # pieces of a long text overlap by all but one byte of a window
            piece = t[at : at + _SLICE]
            if size + len(piece) > _SLICE:
                flush()
            batch.append((k, at, piece))
            size += len(piece)
            if at + _SLICE >= len(t):
                break
            at += _SLICE - length + 1
    if batch:
        flush()
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchors(docs: DataFrame, kind: str, length: int) -> DataFrame:
    """(doc_id, version, at, n, anchor, run, known): a run of each document; known: an equal one stands earlier in the batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.sort_indices(b, sort_keys=[("doc_id", "ascending"), ("version", "ascending")], null_placement="at_start"))
            of, at, n, anchor, run = runs_of([(t or "").encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()], length)
            order = np.lexsort((at, of, run, anchor))
            known = np.zeros(len(of), bool)
            known[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
            # known runs need no comparison: those in a row become one, under a key of its own
            tied = np.zeros(len(of), bool)
            tied[1:] = known[1:] & known[:-1] & (of[1:] == of[:-1]) & (at[1:] == at[:-1] + n[:-1])
            head = np.flatnonzero(~tied)
            last = np.append(head[1:], len(of)) - 1 if len(head) else head
            of, n, at, anchor, run, known = of[head], at[last] + n[last] - at[head], at[head], anchor[head], run[head], known[head]
            for k in range(0, max(1, len(of)), 100_000):
                s = slice(k, k + 100_000)
                rows = pa.array(of[s])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(at[s], pa.int64()), pa.array(n[s].astype(np.int32)), pa.array(np.where(known[s], run[s] ^ at[s], anchor[s])), pa.array(run[s]), pa.array(known[s])],
                    names=["doc_id", "version", "at", "n", "anchor", "run", "known"],
                )

    return docs.mapInArrow(scan, f"doc_id {kind}, version long, at long, n int, anchor long, run long, known boolean")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in the order of their first ``length`` bytes, ties by place, and which share them with the one before."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | padded[k : k + n]
    width = 8

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        rank = np.empty(len(key), _U)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]).astype(_U)
        return rank

    def pair(rank: np.ndarray, shift: int) -> np.ndarray:
        later = np.concatenate([rank[shift:], np.zeros(min(shift, n), _U)])[:n]
        return (rank << _U(32)) | later

    rank = ranked(key)
    while 2 * width <= length:
        rank = ranked(pair(rank, width))
        width *= 2
    whole = pair(rank, length - width)[starts]
    order = np.lexsort((starts, whole))
    same = np.zeros(len(order), bool)
    same[1:] = whole[order[1:]] == whole[order[:-1]]
    return order, same


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have a previous factor of ``length`` bytes: places rise with position, so the previous smaller
    one is the neighbour before, if both have that much in common; a next smaller one cannot be, as ties are in order of place."""
    order, same = suffix_order(data, starts, length)
    out = np.zeros(len(starts), bool)
    out[order] = same
    return out


def _edges(records: DataFrame, kind: str, length: int, bucket_bytes: int, hot_rows: int) -> DataFrame:
    """(doc_id, version, start, end): windows of edge runs that also occur earlier, as stretches of bytes."""
    counts = records.groupBy("anchor").agg(F.count("*").alias("m"))
    hot = staged(counts.where(F.col("m") > hot_rows).select("anchor"), "hot-anchors")
    total = records.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    usual = records.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    layout = f"doc_id {kind}, version long, start long, end long"

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("version", "ascending"), ("at", "ascending")], null_placement="at_start"))
        contents = t.column("content").to_pylist()
        lens = np.fromiter(map(len, contents), np.int64, len(contents))
        base, n, at = np.cumsum(lens) - lens, lens - length + 1, t.column("at").to_numpy()
        of = np.repeat(np.arange(len(n)), n)
        starts = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + base[of]
        gone = previous_factors(np.frombuffer(b"".join(contents), np.uint8), starts, length)
        return _stretches(t, of, starts - base[of] + at[of], gone, length)

    def _stretches(t, of, position, gone, length):
        of, position = of[gone], position[gone]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (position[1:] != position[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(of)) - 1 if len(first) else first
        rows = pa.array(of[first])
        return pa.table({"doc_id": t.column("doc_id").take(rows), "version": t.column("version").take(rows), "start": pa.array(position[first], pa.int64()), "end": pa.array(position[last] + length, pa.int64())})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = b.column(3)[k].as_py()
                n = len(data) - length + 1
                prints = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                row = pa.array([k] * n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(range(b.column(2)[k].as_py(), b.column(2)[k].as_py() + n), pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "version", "at", "print"])

    found = usual.select("bucket", "doc_id", "version", "at", "content").groupBy("bucket").applyInArrow(compare, layout)
    if hot.isEmpty():
        return found
    each = records.join(hot, "anchor", "left_semi").select("doc_id", "version", "at", "content").mapInArrow(windows, f"doc_id {kind}, version long, at long, print binary")
    first = each.groupBy("print").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"))
    later = each.join(first, "print").where(F.struct("doc_id", "version", "at") != F.col("first"))
    return found.union(later.select("doc_id", "version", F.col("at").alias("start"), (F.col("at") + length).alias("end")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, bucket_bytes: int = 4 << 20, hot_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, sha256, spans, kept): the maximal removed runs [start, end), and the bytes left where any is removed (else null).

    sha256 is that of the whole text, in hex.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    clash = not own.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty()
    own = own.select("doc_id", (F.xxhash64("text") if clash else F.lit(0).cast("long")).alias("version"), "text")
    single = own.dropDuplicates(["doc_id", "version", "text"]) if clash else own
    every = Window.partitionBy("anchor")
    within = Window.partitionBy("anchor", "run").orderBy("doc_id", "version", "at")
    runs = _anchors(single.where(F.octet_length("text") >= length), kind, length)
    runs = runs.withColumns({"lo": F.min("run").over(every), "hi": F.max("run").over(every)}).withColumn("place", F.row_number().over(within))
    gone = F.col("known") | (F.col("place") > 1)
    marked = runs.where(gone | (F.col("lo") < F.col("hi"))).select("doc_id", "version", "at", "n", "anchor", (~gone).alias("edge"))
    listed = marked.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n", "anchor", "edge")).alias("runs"))
    key = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["version"] == y["version"])
    held = staged(single.join(listed, key(single, listed)).select(single["doc_id"], single["version"], "text", "runs"), "repeats")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, flat = b.column(3), b.column(3).flatten()
            edge = flat.field("edge").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())[edge]
            at, n, anchor = (flat.field(c).to_numpy()[edge] for c in ("at", "n", "anchor"))
            for k in range(0, len(of), 20_000):
                rows, part, now, data = pa.array(of[k : k + 20_000]), [], -1, b""
                for d, x, m in zip(of[k : k + 20_000].tolist(), at[k : k + 20_000].tolist(), n[k : k + 20_000].tolist()):
                    if d != now:
                        now, data = d, b.column(2)[d].as_py().encode("utf-8", "surrogatepass")
                    part.append(data[x : x + m - 1 + length])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(at[k : k + 20_000]), pa.array(part, pa.binary()), pa.array(anchor[k : k + 20_000])],
                    names=["doc_id", "version", "at", "content", "anchor"],
                )

    records = staged(held.mapInArrow(contents, f"doc_id {kind}, version long, at long, content binary, anchor long"), "edges")
    edges = _edges(records, kind, length, bucket_bytes, hot_rows).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("more"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def stretches(k: int) -> tuple[np.ndarray, ...]:
                flat = b.column(k).flatten()
                of = np.repeat(np.arange(b.num_rows), b.column(k).value_lengths().fill_null(0).to_numpy())
                if k == 3:
                    whole = ~flat.field("edge").to_numpy(zero_copy_only=False)
                    at = flat.field("at").to_numpy()
                    return of[whole], at[whole], (at + flat.field("n").to_numpy() - 1 + length)[whole]
                return of, flat.field("start").to_numpy(), flat.field("end").to_numpy()

            of, start, end = (np.concatenate(c) for c in zip(stretches(3), stretches(4)))
            order = np.lexsort((start, of))
            merged: list[list[list[int]]] = [[] for _ in range(b.num_rows)]
            for d, s, e in zip(of[order].tolist(), start[order].tolist(), end[order].tolist()):
                spans = merged[d]
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            kept = []
            for spans, t in zip(merged, b.column(2)):
                if spans:
                    data = t.as_py().encode("utf-8", "surrogatepass")
                    kept.append(b"".join(data[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)])))
                else:
                    kept.append(None)
            found = [[{"start": s, "end": e} for s, e in spans] for spans in merged]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "version", "spans", "kept"])

    done = held.join(edges, key(held, edges), "left").select(held["doc_id"], held["version"], "text", "runs", "more").mapInArrow(cut, f"doc_id {kind}, version long, spans array<struct<start: long, end: long>>, kept binary")
    base = own.select("doc_id", "version", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    out = base.join(done, key(base, done), "left")
    return out.select(base["doc_id"], "n_bytes", "sha256", F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"), "kept")
