"""Near-duplicate passages by compact windows.

A document is its sequence of five-word shingles; each of several hash
functions orders the shingles.  In the Cartesian tree of one function's values
a node's range is a compact window: every stretch of shingles inside it that
holds the node has that node as its minimum.  A band is a pair of functions;
stretches of at least a passage's length with the same two minima form a joint
window, the intersection of two compact windows.  Joint windows of equal
minima are candidates.

Texts of equal words are one class, and only its first takes part; the others
give one row for the whole text.  Windows are made where a passage can be: the
least shingle of every eight in a row is an anchor, and a stretch as long as a
passage must hold three anchors that another class has, too.  (Two passages of
50 words at 0.75 differ in one word changed, or a few at the ends; runs of n
equal shingles have at least n // 8 anchors in common, so four or more.)

Each window is first linked with the first of its key, so a passage that many
documents share gives one link each, not all pairs.  Links of two documents
are joined where their intervals overlap, and the stretch of the later
document that repeats the earlier one is then measured on the words
themselves: its longest part whose shingles are found there in the asked
share, and the exact Jaccard similarity of both parts.  A window whose two
minima lie in no passage found so then meets every earlier window of its key,
in blocks where a key has many: both are laid on each other at a minimum, and
the first earlier one that is similar enough in a stretch of the least length
is measured in the same way; where that finds no passage with the window's
minima, the stretch itself is the passage.

A verbatim passage of the least length always gives a link.  At a shingle
similarity of s in a passage a band links with probability s^2, nine bands
with 1-(1-s^2)^9: at 0.75 all fail with probability 6e-4, at 0.8 with 1e-4.

Defined cases: null, empty and shorter texts have no passage and give no row;
passages repeated inside one document count only against other documents;
rows alike in id and text count once; rows of one id and different texts are
told apart; what a copy of a whole earlier text shares with a third document
is told by the rows of that earlier text; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import drop, hash_spans, slices, staged, tidy

SHINGLE = 5
_U = np.uint64
_P = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SHINGLE)], _U)
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, 18, _U) | _U(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in data, in order, and the places of their first bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, length = edges[::2], edges[1::2] - edges[::2]
    return hash_spans(data, begin, length), begin


def _shingles(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles, in order."""
    return _rolled(_hashes(b" ".join(ws))[0])


def _rolled(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of words of these hashes."""
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.empty(0, _U)
    s = np.zeros(n, _U)
    for k in range(SHINGLE):
        s += h[k : k + n] * _P[k]
    return s ^ (s >> _U(31))


def _order(s: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = s * seed
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> _U(32))) | _U(1)


def compact_windows(values: np.ndarray, nodes: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The range of each node in the Cartesian tree of values (leftmost minimum on top); a value of 0 is a border, and no two are further apart than longest."""
    table = [values]
    while 2 << len(table) <= len(values) and 1 << len(table) <= (longest or len(values)):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    low, high, own = nodes.copy(), nodes + 1, values[nodes]
    for k in range(len(table) - 1, -1, -1):
        step, row = 1 << k, table[k]
        to = low - step
        low = np.where((to >= 0) & (row[np.maximum(to, 0)] > own), to, low)
        high = np.where((high + step <= len(values)) & (row[np.minimum(high, len(row) - 1)] >= own), high + step, high)
    return low, high  # [low, high)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each stretch of width values, told by the bits above those that number the places."""
    bits = _U(len(values).bit_length())
    both = values >> bits << bits | np.arange(len(values), dtype=_U)
    have = 1
    while have < width:
        step = min(have, width - have)
        both = np.minimum(both[:-step], both[step:])
        have += step
    return (both & (_U(1) << bits) - _U(1)).astype(np.int64)


def _merged(s: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, key, low, high, near, far) of joint windows in order of their starts, with those of one key whose nearer minimum moves along a run of one shingle merged.

    Each start in such a run has a window of its own.  All that these windows
    could be laid on lies on one another at the run's start, at its end or, if
    both ends are to meet for runs of nearly one length, at its middle; these
    three stand for them.  first is the place of the merged windows' first.
    """
    new = np.concatenate([[True], s[1:] != s[:-1]])
    run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(s)]]) - 1
    of, other = run[near], run[far]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (other[1:] != other[:-1])]))
    start, stop, one_run = begin[of[first]], end[of[first]], of[first] == other[first]
    low, high = np.minimum(np.minimum.reduceat(low, first), start), np.maximum.reduceat(high, first)
    out = []
    for at, of_these in ((start, stop >= start), (stop, stop > start), ((start + stop) // 2, stop > start + 1)):
        out.append((first[of_these], key[first][of_these], low[of_these], high[of_these], at[of_these], np.where(one_run, at, far[first])[of_these]))
    return tuple(np.concatenate(c) for c in zip(*out))


def joint_windows(docs: list[np.ndarray], width: int, bands: range) -> tuple[np.ndarray, ...]:
    """(document, key, low, high, near, far) of the joint windows of documents' shingles, high excluded; near and far are the places of the two minima, windows along a run of one shingle merged."""
    docs_at, parts, out = [], [], []
    size = 0

    def flush() -> None:
        nonlocal docs_at, parts, size
        s = np.concatenate([x for p in parts for x in (p, np.zeros(1, _U))])
        border = np.cumsum([len(p) + 1 for p in parts]) - 1
        base = border - np.array([len(p) for p in parts])
        n = len(s) - width + 1
        of = np.searchsorted(border, np.arange(n), "left")
        valid = np.arange(n) + width <= border[np.minimum(of, len(border) - 1)]
        for k in bands:
            tops, lows, highs, keys = [], [], [], []
            for seed in _SEEDS[2 * k : 2 * k + 2]:
                v = _order(s, seed)
                v[border] = 0
                top = _least(v, width)
                nodes = top[valid]  # in order
                nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
                low, high = compact_windows(v, nodes, max(map(len, parts)))
                tops.append(np.where(valid, top, -1))
                lows.append((nodes, low))
                highs.append(high)
                keys.append(v)
            one, two = tops
            new = np.ones(n, bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            first = np.flatnonzero(new & valid)
            if not len(first):
                continue
            a, b = one[first], two[first]
            i, j = np.searchsorted(lows[0][0], a), np.searchsorted(lows[1][0], b)
            low, high = np.maximum(lows[0][1][i], lows[1][1][j]), np.minimum(highs[0][i], highs[1][j])
            key = (keys[0][a] * _U(0x9E3779B97F4A7C15) + keys[1][b]) * _U(2 * k + 1) + _U(k)
            at, key, low, high, near, far = _merged(s, key, low, high, np.minimum(a, b), np.maximum(a, b))
            d = of[first][at]
            out.append((np.array(docs_at)[d], key.view(np.int64), low - base[d], high - base[d], near - base[d], far - base[d]))
        docs_at, parts, size = [], [], 0

    for k, s in enumerate(docs):
        if len(s) < width:
            continue
        docs_at.append(k)
        parts.append(s)
        size += len(s)
        if size > 30_000:
            flush()
    if parts:
        flush()
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out))


ANCHOR = 8
BUCKETS = 10  # bits of an anchor's hash that name the task in which it meets its equals
_SCAN = "class long, uid long, second long, words int, bucket int, hashes binary, classes binary, places binary"


def _packed(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The values as bytes, a part from each begin on."""
    ends = np.append(begin, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _by_class(classes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each class and its places."""
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    begin = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])[: len(classes)])
    return classes[begin], _packed(places[order], begin)


def _held_by_two(hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes, where each different one begins in it, how many it has and whether two classes have it."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    n = np.diff(np.append(begin, len(order)))
    return order, begin, n, np.minimum.reduceat(classes[order], begin) != np.maximum.reduceat(classes[order], begin)


def _scanned(docs: DataFrame, width: int) -> DataFrame:
    """Of docs (uid, text) with a passage's words: a row (class, uid, second, words) each, and their anchors; the anchors of copies in one slice once.

    Anchors that two classes of a slice have are common: rows (class, places).
    The others, and two of each of these, are rows (bucket, hashes, classes,
    places), by which all of one hash meet.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                texts = b.column(1).cast(pa.binary()).to_pylist()
                h, at = _hashes(b"\n".join(texts).lower())
                last = np.searchsorted(at, np.cumsum([len(x) + 1 for x in texts]))
                first = np.concatenate([[0], last[:-1]])
                of = np.flatnonzero(last - first - SHINGLE + 1 >= width)
                if not len(of):
                    continue
                first, last = first[of], last[of]
                two, one = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h[x:y]) for x, y in zip(first.tolist(), last.tolist())), ">i8").astype(np.int64).reshape(-1, 2).T
                once = np.sort(np.unique(one, return_index=True)[1])
                all_ = _rolled(h)
                s = np.concatenate([all_[x : y - SHINGLE + 1] for x, y in zip(first[once].tolist(), last[once].tolist())])
                sizes = last[once] - first[once] - SHINGLE + 1
                end = np.cumsum(sizes)
                doc = np.repeat(np.arange(len(once)), sizes)
                anchors = _least(_order(s, _SEEDS[0]), ANCHOR)[doc[: len(s) - ANCHOR + 1] == doc[ANCHOR - 1 :]]
                anchors = anchors[np.append(True, anchors[1:] != anchors[:-1])]
                hashes, classes, places = s[anchors], one[once][doc[anchors]], (anchors - (end - sizes)[doc[anchors]]).astype(np.int32)
                order, begin, n, common = _held_by_two(hashes, classes)
                told = np.repeat(common, n)
                new = np.append(True, classes[order][1:] != classes[order][:-1])
                new[begin] = False
                sent = ~told
                sent[begin] = True  # the first, and the first of another class
                other = np.flatnonzero(new & told)
                sent[other[np.unique(np.searchsorted(begin, other, "right"), return_index=True)[1]]] = True
                own, of_own = _by_class(classes[order][told], places[order][told])
                order = order[sent]
                bucket = (hashes[order] >> _U(64 - BUCKETS)).astype(np.int32)
                parts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                yield from _rows(**{"class": one, "uid": b.column(0).take(pa.array(of)), "second": two, "words": last - first})
                yield from _rows(**{"class": own, "places": of_own})
                yield from _rows(bucket=bucket[parts], hashes=_packed(hashes[order], parts), classes=_packed(classes[order], parts), places=_packed(places[order], parts))

    return docs.mapInArrow(scan, _SCAN)


_SCANNED = pa.schema([("class", pa.int64()), ("uid", pa.int64()), ("second", pa.int64()), ("words", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("classes", pa.binary()), ("places", pa.binary())])


def _rows(**columns) -> Iterator[pa.RecordBatch]:
    """Rows of _SCANNED, null where no column is given."""
    n = len(next(iter(columns.values())))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCANNED], schema=_SCANNED)


def _common(t: pa.Table) -> pa.Table:
    """(class, places) of the anchors of one bucket that two classes have."""
    hashes, classes, places = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("hashes", _U), ("classes", np.int64), ("places", np.int32)))
    order, _, n, common = _held_by_two(hashes, classes)
    order = order[np.repeat(common, n)]
    own, of_own = _by_class(classes[order], places[order])
    return pa.table({"class": own, "places": of_own})


_PIECES = "uid long, pieces array<struct<base:int,shingles:binary>>"


def _stretches(docs: DataFrame, width: int) -> DataFrame:
    """(uid, pieces) of docs (uid, text, places in parts): the stretches that hold three of the places in a passage's reach, with a passage's length around, each as its first place and its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                uids, ends, bases, pieces = [], [0], [], []
                for uid, text, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                    at = np.unique(np.frombuffer(b"".join(places), np.int32))
                    k = np.flatnonzero(at[2:] - at[:-2] <= width + ANCHOR)
                    if not len(k):
                        continue
                    s = _rolled(_hashes(text.lower())[0])
                    low, high = np.maximum(at[k] - width, 0), np.minimum(at[k + 2] + width + 1, len(s))
                    new = np.concatenate([[True], low[1:] > high[:-1]])
                    for x, y in zip(low[new].tolist(), high[np.concatenate([new[1:], [True]])].tolist()):
                        bases.append(x)
                        pieces.append(s[x:y].tobytes())
                    uids.append(uid)
                    ends.append(len(bases))
                of_uid = pa.StructArray.from_arrays([pa.array(bases, pa.int32()), pa.array(pieces, pa.binary())], names=["base", "shingles"])
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of_uid)], names=["uid", "pieces"])

    return docs.mapInArrow(cut, _PIECES)


def _laid_out(pieces: list[dict], low: int, high: int) -> np.ndarray:
    """The shingles from low to high, 0 where no piece has them."""
    s = np.zeros(high - low, _U)
    for p in pieces:
        x, base = np.frombuffer(p["shingles"], _U), p["base"]
        a, b = max(base, low), min(base + len(x), high)
        if a < b:
            s[a - low : b - low] = x[a - base : b - base]
    return s


def _windows(stretches: DataFrame, width: int, bands: range) -> DataFrame:
    """(uid, low, high, near, far, key) of the joint windows of stretches (uid, pieces)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, 4 << 20):
                of, key, *places = joint_windows([np.frombuffer(x, _U) for x in b.column(2).to_pylist()], width, bands)
                base = b.column(1).to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[of]), *(pa.array(x + base, pa.int32()) for x in places), pa.array(key)], names=["uid", "low", "high", "near", "far", "key"])

    return stretches.select("uid", F.inline("pieces")).mapInArrow(scan, "uid long, low int, high int, near int, far int, key long")


def _longest(hit: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which at least the share is hit."""
    gain = np.concatenate([[0.0], np.cumsum(hit - share)]) + np.arange(len(hit) + 1) * 1e-12
    lowest = np.minimum.accumulate(gain)  # the first place not above the sum at a stretch's end is its best start
    begin = np.searchsorted(-lowest, -gain[1:], "left")
    k = int(np.argmax(np.arange(1, len(hit) + 1) - begin))
    return int(begin[k]), k + 1


def measure(u: list[bytes], v: list[bytes], least_words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Parts of u that v repeats: words of u, words of v, similarity.

    The longest part with the share of common shingles that two texts of the
    asked similarity have comes first; where its exact similarity falls short,
    stricter shares are tried inside it, down to unbroken runs.  Changed words
    at a part's ends belong to it only where it would else be too short.
    """
    return _measured(_shingles(u), _shingles(v), least_words, percent)


def _measured(s: np.ndarray, t: np.ndarray, least_words: int, percent: int, sorted_: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    width = least_words - SHINGLE + 1
    if len(s) < width or len(t) < width:
        return []
    order, values = sorted_ or (order := np.argsort(t, kind="stable"), t[order])
    at = np.minimum(np.searchsorted(values, s), len(t) - 1)
    hit = values[at] == s
    if np.count_nonzero(hit) < width * 2 * percent / (100 + percent):
        return []
    place = order[at]
    shares = (2 * percent / (100 + percent), 0.93, 1.0)
    found, open_ = [], [(0, len(s), 0)]
    while open_:
        lo, hi, level = open_.pop()
        if hi - lo < width or np.count_nonzero(hit[lo:hi]) < width * shares[0]:
            continue
        a, b = (x + lo for x in _longest(hit[lo:hi], shares[level]))
        if b - a < width:
            continue
        open_ += [(lo, a, level), (b, hi, level)]
        hits = np.flatnonzero(hit[a:b]) + a
        middle = int(np.sort(place[hits] - hits)[len(hits) // 2])  # the diagonal that most of them lie on
        near = hits[np.abs(place[hits] - hits - middle) <= max(20, b - a) // 2]
        best = _fitted(s, t, place, near, width) if len(near) else None
        if best and best[0] * 100 >= percent:
            both, lo1, hi1, lo2, hi2 = best
            found.append((lo1, hi1 + SHINGLE - 1, lo2, hi2 + SHINGLE - 1, both))
            open_ += [(a, lo1, level), (hi1, b, level)]  # it may repeat another part
            continue
        if level + 1 < len(shares):
            open_.append((a, b, level + 1))
        else:
            found += _verbatim(s, t, a, b, order, values, width)
    return found


def _verbatim(s: np.ndarray, t: np.ndarray, a: int, b: int, order: np.ndarray, values: np.ndarray, width: int) -> list[tuple[int, int, int, int, float]]:
    """Equal stretches in s[a:b], all of whose shingles are in t; for texts that repeat themselves, where a shingle has many places."""
    found = []
    while b - a >= width:
        at = order[np.searchsorted(values, s[a]) : np.searchsorted(values, s[a], "right")]
        at = at[at + width <= len(t)]
        at = at[t[at + width - 1] == s[a + width - 1]]
        c = next((c for c in at.tolist() if np.array_equal(t[c : c + width], s[a : a + width])), None)
        if c is None:
            a += 1
            continue
        most = min(b - a, len(t) - c)
        differ = np.flatnonzero(t[c : c + most] != s[a : a + most])
        n = int(differ[0]) if len(differ) else most
        found.append((a, a + n + SHINGLE - 1, c, c + n + SHINGLE - 1, 1.0))
        a += n
    return found


def _fitted(s: np.ndarray, t: np.ndarray, place: np.ndarray, near: np.ndarray, width: int) -> tuple[float, int, int, int, int] | None:
    """Similarity and ends of the parts from the first to the last equal shingle; where these are short of width, words
    that differ at the parts' own ends belong to them, as many on both sides as are the most alike."""
    lo1, hi1, lo2, hi2 = int(near[0]), int(near[-1]) + 1, int(place[near].min()), int(place[near].max()) + 1
    lack = max(0, width - min(hi1 - lo1, hi2 - lo2))
    best = None
    for k in range(lack + 1):
        a, b, c, d = lo1 - k, hi1 + lack - k, lo2 - k, hi2 + lack - k
        if a >= 0 and c >= 0 and b <= len(s) and d <= len(t):
            x, y = set(s[a:b].tolist()), set(t[c:d].tolist())
            both = len(x & y) / len(x | y)
            if best is None or both > best[0]:
                best = (both, a, b, c, d)
    return best


_ROW = pa.schema([("uid", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("other", pa.int64()), ("match_start", pa.int64()), ("match_end", pa.int64()), ("similarity", pa.float64())])


def _overlapping(places: np.ndarray) -> list[list[int]]:
    """Windows (low, high, other_low, other_high) of a pair as groups whose intervals overlap on both sides."""
    groups: list[list[int]] = []
    for w in places[np.lexsort(places.T[::-1])].tolist():
        for g in groups:
            if w[0] < g[1] and w[2] < g[3] and g[2] < w[3]:  # in order of low
                if w[1] > g[1]:
                    g[1] = w[1]
                if w[2] < g[2]:
                    g[2] = w[2]
                if w[3] > g[3]:
                    g[3] = w[3]
                break
        else:
            groups.append(w)
    return groups


def _verify(least_words: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ends, flat = b.column(b.schema.names.index("windows")).offsets.to_numpy(), b.column(b.schema.names.index("windows")).values
            places = np.stack([flat.field(c).to_numpy() for c in ("low", "high", "other_low", "other_high")], axis=1)
            for k, (uid, first, shingles, other, other_first, other_shingles) in enumerate(zip(*(b.column(c).to_pylist() for c in ("uid", "first", "shingles", "other", "other_first", "other_shingles")))):
                s, t = np.frombuffer(shingles, _U), np.frombuffer(other_shingles, _U)
                for lo, hi, lo2, hi2 in _overlapping(places[ends[k] : ends[k + 1]]):
                    for found in _measured(s[lo - first : hi - first], t[lo2 - other_first : hi2 - other_first], least_words, percent):
                        out.append({"uid": uid, "start_word": lo + found[0], "end_word": lo + found[1], "other": other, "match_start": lo2 + found[2], "match_end": lo2 + found[3], "similarity": found[4]})
            yield pa.RecordBatch.from_pylist(out, _ROW)

    return verify


FOUND = "uid long, start_word long, end_word long, other long, match_start long, match_end long, similarity double"


SHIFTS = (0, 1, -1, 2, -2)
_ALIKE = pa.schema([(c, pa.int64()) for c in ("key", "uid", "low", "high", "near", "far", "other", "other_low", "other_high", "start", "other_start")] + [("similarity", pa.float64())])


def _alike(x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of shingles around a common minimum: how many of x are in y near the same place, in the best stretch of width that holds the minimum, and its start."""
    hit = np.zeros(x.shape, bool)
    n = x.shape[1]
    for k in SHIFTS:
        hit[:, max(0, -k) : n - max(0, k)] |= x[:, max(0, -k) : n - max(0, k)] == y[:, max(0, k) : n - max(0, -k)]
    sums = np.zeros((len(x), n + 1), np.int16)
    np.cumsum(hit & (x != 0), axis=1, out=sums[:, 1:])
    sums = sums[:, width:] - sums[:, :-width]
    return sums.max(axis=1), sums.argmax(axis=1)


def _exact(x: np.ndarray, y: np.ndarray, start: int, width: int) -> tuple[float, int]:
    """Similarity of the stretch of x at start and the stretch of y near it that is the most like it, and that one's start."""
    own, best = set(x[start : start + width].tolist()) - {0}, (0.0, start)
    for k in SHIFTS:
        y_ = y[start + k : start + k + width] if start + k >= 0 else y[:0]
        if len(y_) == width and y_.all():
            other = set(y_.tolist())
            best = max(best, (len(own & other) / len(own | other), start + k))
    return best if x[start : start + width].all() else (0.0, start)


def _dealt(windows: DataFrame, large: int, block: int, tasks: int) -> DataFrame:
    """Windows (key, uid, low, open, n_open, n_members, more) with the task where they meet the others of their key.

    Of a key of over ``large`` windows, every block of open ones meets every
    block of members: an open window is sent once for each block of members,
    a member once for each block of open ones.
    """
    wide = F.col("n_open") + F.col("n_members") > large
    blocks = lambda n: F.when(wide, F.ceil(F.col(n) / block)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("uid", "low"), F.when(F.col("open"), blocks("n_open")).otherwise(blocks("n_members"))).cast("int")
    others = F.when(F.col("open"), blocks("n_members")).otherwise(blocks("n_open"))
    dealt = windows.withColumn("own", own).withColumn("other_block", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = (F.when(F.col("open"), F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other_block"), ("other_block", "own")))
    return dealt.withColumn("task", F.when(wide, F.xxhash64("key", i, j)).otherwise(F.pmod("key", F.lit(tasks)))).drop("own", "other_block", "n_open", "n_members")


def _first_alike(open_: DataFrame, members: DataFrame, stretches: DataFrame, width: int, percent: int, large: int, block: int) -> DataFrame:
    """For each open window (key, uid, low, high, near, far) the first window of an earlier document that it is like, among members (key, uid, low, high, near).

    Windows of a key meet in one task, many keys a task, or block by block.
    """
    at_least = int(np.ceil(width * 2 * percent / (100 + percent)))
    counts = open_.groupBy("key").agg(F.count("*").alias("n_open")).join(members.groupBy("key").agg(F.count("*").alias("n_members")), "key")
    same = ("key", "uid", "low", "high", "near")
    every = open_.select(*same, "far", F.lit(True).alias("open")).unionByName(members.select(*same, F.lit(0).alias("far"), F.lit(False).alias("open")))
    of_document = every.join(counts, "key").groupBy("uid").agg(F.collect_list(F.struct(*same[:1], *same[2:], "far", "open", "n_open", "n_members")).alias("windows"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20):
                b = whole.slice(at, 20)
                for uid, windows, pieces in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    s = _laid_out(pieces, -width, max(p["base"] + len(p["shingles"]) // 8 for p in pieces) + width)
                    s = (s >> _U(32)).astype(np.uint32) | (s != 0)
                    flat = windows.values
                    near = flat.field("near").to_numpy()
                    for cut in range(0, len(near), 10_000):
                        k = near[cut : cut + 10_000]
                        shape = s[k[:, None] + np.arange(1, 2 * width)]
                        part = flat.slice(cut, 10_000)
                        yield pa.RecordBatch.from_arrays([part.field("key"), pa.array(np.full(len(k), uid)), *(part.field(c) for c in names[2:-1]), pa.array([r.tobytes() for r in shape], pa.binary())], names=names)

    names = ["key", "uid", "low", "high", "near", "far", "open", "n_open", "n_members", "shape"]
    rows = of_document.join(stretches, "uid").mapInArrow(around, "key long, uid long, low int, high int, near int, far int, open boolean, n_open long, n_members long, shape binary")
    rows = _dealt(rows, large, block, max(64, members.count() // 2000))

    def compare(t: pa.Table) -> pa.Table:
        uid, key, near = (t.column(c).to_numpy() for c in ("uid", "key", "near"))
        is_open = t.column("open").to_numpy()
        shape = np.frombuffer(b"".join(t.column("shape").to_pylist()), np.uint32).reshape(len(uid), -1)
        order = np.lexsort((t.column("low").to_numpy(), uid, key))
        mine, others = order[is_open[order]], order[~is_open[order]]
        of_shape = np.fromiter((xxhash.xxh3_64_intdigest(shape[k], int(key[k]) & (1 << 64) - 1) for k in others.tolist()), _U, len(others))
        others = others[np.sort(np.unique(of_shape, return_index=True)[1])]  # of members alike in key and shape the first one answers for all
        lo, hi = np.searchsorted(key[others], key[mine]), np.searchsorted(key[others], key[mine], "right")
        to, at, other_at, similarity = (np.full(len(uid), -1, t) for t in (np.int64, np.int64, np.int64, np.float64))
        # the open windows side by side, each with its next few earlier ones, until all have one or have met all
        earlier = [others[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        first = lo.copy()
        stop = np.array([a + np.searchsorted(uid[e], x, "left") for a, e, x in zip(lo.tolist(), earlier, uid[mine].tolist())], np.int64)
        left = np.flatnonzero(first < stop)
        while len(left):
            take = np.minimum(stop[left] - first[left], max(1, 4096 // len(left)))
            rest = []
            ends = np.cumsum(take)
            a = 0
            while a < len(left):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 4096, "right")))
                w, n = left[a:b], take[a:b]
                of = np.repeat(np.arange(len(w)), n)
                place = first[w][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
                x, y = mine[w[of]], others[place]
                count, start = _alike(shape[x], shape[y], width)
                for k in np.flatnonzero(count >= at_least).tolist():
                    if to[x[k]] < 0:
                        both, there = _exact(shape[x[k]], shape[y[k]], int(start[k]), width)
                        if both * 100 >= percent:
                            to[x[k]], at[x[k]], other_at[x[k]], similarity[x[k]] = y[k], start[k], there, both
                first[w] += n
                rest.append(w[(to[mine[w]] < 0) & (first[w] < stop[w])])
                a = b
            left = np.concatenate(rest)
        found = np.flatnonzero(to >= 0)
        cols = [t.column(c).to_numpy()[found] for c in ("key", "uid", "low", "high", "near", "far")] + [t.column(c).to_numpy()[to[found]] for c in ("uid", "low", "high")]
        cols += [near[found] - (width - 1) + at[found], near[to[found]] - (width - 1) + other_at[found]]
        return pa.Table.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), pa.array(similarity[found])], schema=_ALIKE)

    alike = rows.groupBy("task").applyInArrow(compare, ", ".join(f"{f.name} {'double' if f.name == 'similarity' else 'long'}" for f in _ALIKE))
    best = alike.groupBy("key", "uid", "low", "high", "near", "far").agg(F.min(F.struct("other", "other_low", "other_high", "start", "other_start", "similarity")).alias("best"))
    return best.select("key", "uid", "low", "high", "near", "far", "best.*")


def _measure_pairs(stretches: DataFrame, linked: DataFrame, least_words: int, percent: int) -> DataFrame:
    """FOUND of linked windows (uid, low, high, other, other_low, other_high)."""
    near = max(1, (least_words - SHINGLE + 1) // 2)  # windows that begin nearer than this on both sides overlap
    joined = linked.groupBy("uid", "other", F.floor(F.col("low") / near).alias("a"), F.floor(F.col("other_low") / near).alias("b")).agg(*(f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "other_low"), (F.max, "other_high"))))
    pairs = staged(joined.groupBy("uid", "other").agg(F.collect_list(F.struct("low", "high", "other_low", "other_high")).alias("windows")), "window-pairs")
    each = pairs.select("uid", "other", F.inline("windows"))
    hulls = each.select("uid", "low", "high").union(each.select("other", "other_low", "other_high")).groupBy("uid").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [_laid_out(pieces, lo, hi).tobytes() for pieces, lo, hi in zip(*(c.to_pylist() for c in b.columns[1:]))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(found, pa.binary())], names=["uid", "first", "shingles"])

    parts = staged(stretches.join(hulls, "uid").select("uid", "pieces", "low", "high").mapInArrow(fetch, "uid long, first int, shingles binary"), "window-shingles")
    others = parts.withColumnsRenamed({"uid": "other", "first": "other_first", "shingles": "other_shingles"})
    found = pairs.join(others, "other").join(parts, "uid").select("uid", "first", "shingles", "other", "other_first", "other_shingles", "windows")
    found = staged(found.mapInArrow(_verify(least_words, percent), FOUND), "passages")
    drop(pairs, parts)
    return found


def _uncovered(windows: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """Windows (key, uid, low, high, near, far, more) whose two minima lie in no one passage found."""
    parts = found.groupBy(F.col("uid").alias("of")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("parts"))
    in_one = F.exists("parts", lambda p: (F.col("near") >= p["start_word"]) & (F.col("far") + SHINGLE <= p["end_word"]))
    return windows.join(parts, (F.col("uid") == F.col("of")) & in_one, "left_anti").select("key", "uid", "low", "high", "near", "far", *more)


def _covering(bare: DataFrame, least_words: int) -> DataFrame:
    """FOUND of stretches (uid, other, start, other_start, similarity) of equal length: of a document's, as few as cover all their words."""
    of_document = bare.groupBy("uid").agg(F.collect_set(F.struct("start", "other", "other_start", "similarity")).alias("stretches"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20):
                out = []
                for uid, stretches in zip(*(c.to_pylist() for c in whole.slice(at, 20).columns)):
                    starts: dict[int, dict] = {}
                    for x in sorted(stretches, key=lambda x: (x["start"], x["other"], x["other_start"])):
                        starts.setdefault(x["start"], x)
                    places = list(starts)
                    for k, p in enumerate(places):
                        end = out[-1]["end_word"] if out and out[-1]["uid"] == uid else -1
                        if p > end or p > end - least_words and (k + 1 == len(places) or places[k + 1] > end):
                            x = starts[p]
                            out.append({"uid": uid, "start_word": p, "end_word": p + least_words, "other": x["other"], "match_start": x["other_start"], "match_end": x["other_start"] + least_words, "similarity": x["similarity"]})
                yield pa.RecordBatch.from_pylist(out, _ROW)

    return of_document.mapInArrow(cover, FOUND)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 50, percent: int = 75, bands: int = 9, large: int = 512, block: int = 512) -> DataFrame:
    """(doc_id, start_word, end_word, match_id, match_start, match_end, similarity): passages that repeat one of an earlier document.

    A row for each passage of a later document and the earlier document that
    its windows were found to repeat; words are counted from 0 at ASCII white space, ends excluded.
    """
    width = least_words - SHINGLE + 1
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    plain = docs.schema[doc_id].dataType.simpleString() in ("bigint", "int") and docs.groupBy(F.col(doc_id).alias("doc_id")).count().where("count > 1 or doc_id is null").isEmpty()
    if plain:
        named = own.withColumn("uid", F.col("doc_id").cast("long"))
    else:  # numbers in the order of the ids, written once so that they hold
        named = staged(own.dropDuplicates(["doc_id", "text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("uid", F.monotonically_increasing_id()), "numbered")
    scanned = staged(_scanned(named.select("uid", "text"), width), "anchors")
    texts = scanned.where("uid is not null").select("class", "second", "uid", "words")
    common = scanned.where("hashes is not null").groupBy("bucket").applyInArrow(_common, "class long, places binary")
    common = common.union(scanned.where("uid is null and hashes is null").select("class", "places"))
    firsts = texts.groupBy("class", "second").agg(F.min("uid").alias("other"))
    copies = texts.join(firsts, ["class", "second"]).where("uid != other")
    copies = copies.select("uid", F.lit(0).cast("long").alias("start_word"), F.col("words").cast("long").alias("end_word"), "other", F.lit(0).cast("long").alias("match_start"), F.col("words").cast("long").alias("match_end"), F.lit(1.0).alias("similarity"))
    places = common.groupBy("class").agg(F.collect_list("places").alias("places"))
    places = staged(places.join(firsts, "class").select(F.col("other").alias("uid"), "places"), "common-anchors")
    copies = staged(copies, "copies")
    drop(scanned)
    tidy(spark)
    stretches = staged(_stretches(named.join(places, "uid").select("uid", "text", "places"), width), "stretches")
    drop(places)
    tidy(spark)
    shared = []
    for k in range(0, bands, 3):  # some bands at a time, so that the shuffle of one part is gone before the next
        of_key = Window.partitionBy("key")
        part = _windows(stretches, width, range(k, min(k + 3, bands))).withColumns({"first": F.min(F.struct("uid", "low", "high")).over(of_key), "most": F.max("uid").over(of_key), "n": F.count("*").over(of_key)})
        shared.append(staged(part.where("first.uid < most").drop("most"), "shared-windows"))
        tidy(spark)
    linked = reduce(DataFrame.union, shared).where("uid != first.uid")
    linked = linked.select("uid", "low", "high", F.col("first.uid").alias("other"), F.col("first.low").alias("other_low"), F.col("first.high").alias("other_high"))
    found = [_measure_pairs(stretches, linked, least_words, percent)]
    for part in shared:  # what one part finds closes windows of the next
        open_ = _uncovered(part.where("n > 2 and uid != first.uid").select("key", "uid", "low", "high", "near", "far"), reduce(DataFrame.union, found))
        open_ = staged(open_, "open")
        last = open_.groupBy("key").agg(F.max("uid").alias("last"))
        members = staged(part.join(last, "key").where("uid < last").select("key", "uid", "low", "high", "near"), "members")
        drop(part)
        alike = staged(_first_alike(open_, members, stretches, width, percent, large, block), "alike")
        drop(open_, members)
        tidy(spark)
        found.append(_measure_pairs(stretches, alike.select("uid", "low", "high", "other", "other_low", "other_high"), least_words, percent))
        bare = _uncovered(alike, found[-1], "other", "start", "other_start", "similarity")  # where measuring took another part, the stretch itself
        found.append(staged(_covering(bare, least_words), "bare-stretches"))
        drop(alike)
        tidy(spark)
    drop(stretches)
    result = reduce(DataFrame.union, found).distinct().union(copies)
    if plain:
        kind = docs.schema[doc_id].dataType
        return result.select(F.col("uid").cast(kind).alias("doc_id"), "start_word", "end_word", F.col("other").cast(kind).alias("match_id"), "match_start", "match_end", "similarity")
    ids = named.select("uid", "doc_id")
    return result.join(ids, "uid").join(ids.toDF("other", "match_id"), "other").select("doc_id", "start_word", "end_word", "match_id", "match_start", "match_end", "similarity")
