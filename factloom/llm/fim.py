"""Fill-in-middle transformation by secondary sort: pieces keyed by document and place, streamed into digests.

Each document is cut once, where it is read, into pieces of whole lines (a
longer line at a code point) that carry their place in the output.  One
shuffle by document with a sort inside the partitions by (document, place) -
what repartitionAndSortWithinPartitions does, in its DataFrame form - brings
the pieces in output order, and a task streams them, one at a time, into
whatever is made of them: a digest, a text, or pieces to be restored.  For
restoration each output is read back from its own characters and its form
alone: sentinels are looked for, what lies between them gets the place it had
in the source, and a second sort inside the same partitions, with no second
shuffle, brings it in source order.

A document is a prefix, a middle and a suffix of lines; its form is ``psm``
(<P>prefix<S>suffix<M>middle), ``spm`` (<S>suffix<P>prefix<M>middle) or
``plain`` (the text itself).  Cuts and form follow from a hash of the id.

Defined cases: a null text is an empty one, which is plain with no lines; a
text that holds a sentinel is plain; a null id hashes as no digits; equal rows
and rows of one id are told apart by the partition they are read from and by
their number among equal rows there, which any rerun of a task gives again;
an empty table gives no rows; other columns are ignored, whatever their names.
No text is held whole but in the row it comes in.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The order of the parts of each form's output; parts are numbered as they stand in the source.
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_INFO = "n long, form string, prefix_chars long, middle_chars long"


def _cut(data: bytes, lo: int, hi: int, size: int) -> Iterator[bytes]:
    """data[lo:hi] in pieces of whole lines of about size bytes; a line over size is cut between code points."""
    while hi - lo > size:
        at = data.rfind(b"\n", lo, lo + size) + 1
        if not at:
            at = lo + size
            while data[at] & 0xC0 == 0x80:
                at -= 1
        yield data[lo:at]
        lo = at
    yield data[lo:hi]


def _chars(data: bytes, lo: int, hi: int) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8)[lo:hi] & 0xC0 != 0x80))


def plan(doc_id: int | str | None, data: bytes, salt: str, rate: int, spm: int) -> tuple[int, str, int, int]:
    """Lines, form, and the bytes where prefix and middle end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if data and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    n = len(ends)
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm else "psm", int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0


def _places(data: bytes, form: str, a: int, b: int, size: int) -> Iterator[bytes]:
    """The pieces of the output in order; a sentinel opens a piece."""
    if form == "plain":
        yield from _cut(data, 0, len(data), size)
        return
    spans = ((0, a), (a, b), (b, len(data)))
    for sentinel, part in ORDER[form]:
        for k, piece in enumerate(_cut(data, *spans[part], size)):
            yield sentinel + piece if k == 0 else piece


def output_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: str = "7", rate: int = 100, spm: int = 50, size: int = 1 << 16) -> DataFrame:
    """The transformed documents as rows (key, at, piece, doc_id, n, form, prefix_chars, middle_chars).

    A document's pieces stand together, in the order of ``at``, within one
    partition; the columns from doc_id on are set at its first piece (at 0) alone.
    """
    kind = docs.schema[doc_id].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: Counter[bytes] = Counter()
        part = TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole, 1):
                rows: list[tuple] = []
                for i, d, t in zip(range(b.num_rows), b.column(0).to_pylist(), b.column(1)):
                    data = t.as_py() or b""
                    own = xxhash.xxh3_128_digest(data + b"\0" + str(d).encode())
                    again[own] += 1
                    key = xxhash.xxh3_128_digest(own + f"{part},{again[own]}".encode())
                    n, form, lo, hi = plan(d, data, salt, rate, spm)
                    told = (None, None) if form == "plain" else (_chars(data, 0, lo), _chars(data, lo, hi))
                    for at, piece in enumerate(_places(data, form, lo, hi, size)):
                        rows.append((key, at, piece, i, n, form, *told) if at == 0 else (key, at, piece, None, None, None, None, None))
                key, at, piece, i, n, form, prefix, middle = zip(*rows)
                ids = b.column(0).take(pa.array(i, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(at, pa.int64()), pa.array(piece, pa.binary()), ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())],
                    names=["key", "at", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"],
                )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    out = own.mapInArrow(pieces, f"key binary, at long, piece binary, doc_id {kind.simpleString()}, {_INFO}")
    return out.repartition("key").sortWithinPartitions("key", "at")


def _fold(batches: Iterator[pa.RecordBatch], places: tuple[int, int], start: Callable, add: Callable, end: Callable) -> Iterator[tuple]:
    """Streams sorted pieces: start(first row) gives a state, add(state, row) takes a piece, end(state) gives rows."""
    state, current = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[places[0]] != current or state is None:
                if state is not None:
                    yield from end(state)
                current, state = row[places[0]], start(row)
            yield from add(state, row) or ()
    if state is not None:
        yield from end(state)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about so many bytes of their binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(b: pa.RecordBatch, name: str) -> pa.DataType:
    return b.schema.field(name).type


def _peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]] | None:
    first = next(batches, None)
    if first is None:
        return None

    def again():
        yield first
        yield from batches

    return _arrow(first, "doc_id"), again()


def transformed(pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the pieces of each document joined to its output text."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _peeked(batches)) is None:
            return
        kind, batches = found
        schema = pa.schema([("doc_id", kind), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
        rows = _fold(batches, (0, 1), lambda r: (r[3:], []), lambda s, r: s[1].append(r[2]), lambda s: [(*s[0], b"".join(s[1]))])
        yield from _batches(rows, schema)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(join, f"doc_id {kind}, {_INFO}, output binary").withColumn("output", F.col("output").cast("string"))


class _Reader:
    """Reads one output: its digest, and its pieces with their places in the source, found by form and sentinels alone."""

    def __init__(self, key: bytes, info: tuple):
        self.key, self.info, self.seen = key, info, hashlib.sha256()
        form = info[2]
        self.part, self.ahead, self.at = 0, list(ORDER.get(form, ())), 0

    def take(self, piece: bytes) -> Iterator[tuple]:
        self.seen.update(piece)
        while self.ahead and (found := piece.find(self.ahead[0][0])) >= 0:
            sentinel, part = self.ahead.pop(0)
            if found:
                yield self._row(piece[:found])
            self.part, piece = part, piece[found + len(sentinel) :]
        if piece:
            yield self._row(piece)

    def _row(self, piece: bytes) -> tuple:
        self.at += 1
        return (self.key, self.part, self.at, piece, *(None,) * 6)

    def done(self) -> Iterator[tuple]:
        yield (self.key, 3, 0, b"", *self.info, self.seen.hexdigest())


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """Rows (key, part, at, piece, doc_id, n, form, prefix_chars, middle_chars, output_sha256) in source order.

    Parts are 0 to 2 in the order of the source; part 3 ends a document and
    carries the columns from doc_id on.  Pieces may have been cut anew
    anywhere but inside a sentinel.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _peeked(batches)) is None:
            return
        kind, batches = found
        schema = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("at", pa.int64()), ("piece", pa.binary()), ("doc_id", kind), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string())])
        yield from _batches(_fold(batches, (0, 1), lambda r: _Reader(r[0], r[3:]), lambda s, r: s.take(r[2]), lambda s: s.done()), schema)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    out = pieces.mapInArrow(read, f"key binary, part int, at long, piece binary, doc_id {kind}, {_INFO}, output_sha256 string")
    return out.sortWithinPartitions("key", "part", "at")


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _peeked(batches)) is None:
            return
        kind, batches = found
        schema = pa.schema([("doc_id", kind), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

        def add(state: list, row: tuple) -> None:
            state[0].update(row[3])
            if row[1] == 3:
                state[1] = row[4:]

        rows = _fold(batches, (0, 1), lambda r: [hashlib.sha256(), None], add, lambda s: [(*s[1], s[0].hexdigest())])
        yield from _batches(rows, schema)

    back = restored_pieces(output_pieces(docs, **options))
    kind = back.schema["doc_id"].dataType.simpleString()
    return back.mapInArrow(digest, f"doc_id {kind}, {_INFO}, output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1 : least(x, y)], '') AS pre, array_to_string(us[least(x, y) + 1 : greatest(x, y)], '') AS mid, array_to_string(us[greatest(x, y) + 1 : n], '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
