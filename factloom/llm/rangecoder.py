"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own from a fresh model, so any block can be decoded
alone.  Its ids are cut into up to 128 stripes that are coded side by side and
teach one model.  The model mixes three predictions of the next id:

* order 2 and order 1: a hashed table each, from the last two ids and the last
  id to the id that followed them, with a confidence of 1..15 that rises and
  falls with its success;
* order 0: the frequencies of the ids that the other two did not foretell,
  with an escape to any id.

P(x) = w2*P2(x) + w1*P1(x) + w0*P0(x).  The weights are those with which each
order came true so far for the pair of confidences at hand, so they adapt as
the tables do.  An id costs one step of the range coder, by its order's mass
and, if that is order 0, the mass of the id in it; and its plain bits if it is new.

The model learns after each generation of steps (1, 1, 2, 4, 8, 16, then 32 steps of
all stripes).  Within a generation it stands still, so the encoder weighs a
generation of all blocks in a few array operations, and only the coder itself
walks step by step.  All arithmetic is on whole numbers under 2^53, and
single quotients and products of them, hence encoder and decoder agree.

Ids are whole numbers of 0 to 2^32-1; those from 2^16 on are coded by their
bits and never foretold.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"FLR4"
BLOCK = 1 << 16
_STRIPES, _STRIPE_IDS, _STEPS = 128, 256, 32  # stripes of a block at most; ids of each at least, if there are several; steps of a generation at most
_BITS1, _BITS2 = 14, 15  # slots of the tables of order 1 and 2
_WAYS, _WAY_BITS = 3, 12  # order 2, order 1, order 0
_CONTEXTS = 512  # two confidences, and whether both foretell the same id
_SLOTS, _BITS0 = 1 << 14, 16  # ids that order 0 can hold; the first two are the escapes to 16 and 32 bits
_STEP_BITS = _WAY_BITS + _BITS0  # of the masses of a step
_TOP, _LOW = 1 << 48, (1 << 32) - 1
_NEW, _WIDE = 0, 1


def _first_counts() -> np.ndarray:
    """What each pair of confidences is believed to do before anything is seen: times of order 2, order 1 and order 0."""
    sure = np.arange(16) / 16
    f1, f2, same = (x.reshape(-1) for x in np.meshgrid(sure, sure, [0, 1], indexing="ij"))
    two = f2 * (1 - 0.5 * f1 * (1 - same))
    one = (1 - two) * f1 * (1 - same)
    return np.stack([8 * two, 8 * one, 8 * (1 - two - one) + 1], axis=1).astype(np.int64)


_FIRST = _first_counts()


def _generations(steps: int) -> list[tuple[int, int]]:
    cuts = [0]
    while cuts[-1] < steps:
        cuts.append(cuts[-1] + min(_STEPS, max(1, cuts[-1])))
    return [(a, min(b, steps)) for a, b in zip(cuts[:-1], cuts[1:])]


class _Model:
    """Tables, weights and frequencies of each block; lanes are the blocks' stripes, blocks with more steps first."""

    def __init__(self, stripes: np.ndarray) -> None:
        n = len(stripes)
        self.block = np.repeat(np.arange(n), stripes)  # of each lane
        self.base1, self.base2, self.base_c = self.block << _BITS1, self.block << _BITS2, self.block * _CONTEXTS
        self.table1 = np.full(n << _BITS1, -16, np.int32)  # id << 4 | confidence
        self.table2 = np.full(n << _BITS2, -16, np.int32)
        self.ways = np.tile(_FIRST.reshape(-1), n)
        self.slot = np.zeros(n << 16, np.uint16)  # of each id; _NEW if it has none
        self.used = np.full(n, 2, np.int64)
        self.ids = np.zeros((n, _SLOTS), np.int64)  # of each slot
        self.counts = np.zeros((n, _SLOTS), np.int64)
        self._weigh(n)
        self._rate(n, np.full(n, 1 << _BITS0))

    def places(self, last: np.ndarray, before: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        h = last * 0x9E3779B1
        k1 = self.base1[:lanes] + ((h >> 15) & ((1 << _BITS1) - 1))
        k2 = self.base2[:lanes] + (((h + before * 0x85EBCA6B) >> 14) & ((1 << _BITS2) - 1))
        return k1, k2

    def context(self, e1: np.ndarray, e2: np.ndarray, lanes: int) -> np.ndarray:
        return self.base_c[:lanes] + ((((e1 & 15) << 4) | (e2 & 15)) << 1 | ((e1 >> 4) == (e2 >> 4)))

    def _weigh(self, blocks: int) -> None:
        """Masses of the three ways in each context."""
        c = self.ways[: blocks * _CONTEXTS * _WAYS].reshape(-1, _WAYS)
        f = 1 + (c * (((1 << _WAY_BITS) - _WAYS) / (c[:, 0] + c[:, 1] + c[:, 2])[:, None])).astype(np.int64)
        f[1::2, 1] = 0  # both foretell the same
        f[:, 2] = (1 << _WAY_BITS) - f[:, 0] - f[:, 1]
        self.way_mass = f.reshape(-1)
        self.after2, self.after1 = f[:, 0].copy(), f[:, 0] + f[:, 1]
        self.way_start = np.stack([np.zeros_like(self.after2), self.after2, self.after1], axis=1).reshape(-1)

    def _rate(self, blocks: int, escape: np.ndarray) -> None:
        """Masses of order 0."""
        width = int(self.used[:blocks].max()) if blocks else 2
        c, used = self.counts[:blocks, :width], self.used[:blocks, None]
        escape = np.minimum(escape, (1 << _BITS0) - 2 * used[:, 0])
        f = (c * (((1 << _BITS0) - escape[:, None] - used) / np.maximum(c.sum(axis=1, keepdims=True), 1))).astype(np.int64)
        f += np.arange(width) < used
        f[:, _NEW] = 0
        f[:, _NEW] = (1 << _BITS0) - f.sum(axis=1)
        self.mass = f
        self.start = np.cumsum(f, axis=1) - f
        self.width = width

    def slot_by_mass(self) -> np.ndarray:
        return np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), len(self.mass)), self.mass.reshape(-1))

    def learn(self, blocks: int, x: np.ndarray, k1: np.ndarray, k2: np.ndarray, e1: np.ndarray, e2: np.ndarray, way: np.ndarray, lane0: np.ndarray, slot0: np.ndarray, x0: np.ndarray) -> None:
        """Take in a generation (steps x lanes) of the first so many blocks; lane0, slot0, x0: what order 0 coded."""
        stored = np.where(x < 1 << 16, x, -1).astype(np.int32)
        fresh = stored << 4 | 1
        for table, k, e in ((self.table1, k1, e1), (self.table2, k2, e2)):
            c = e & 15
            true = (e >> 4) == stored
            new = e - c + (c >> 1)  # a confidence is halved where its id did not come, and rises to 15 where it did
            np.copyto(new, fresh, where=c < 2)
            np.copyto(new, e + (c < 15), where=true)
            table[k.reshape(-1)] = new.reshape(-1)  # of one slot the last counts
        ways = self.ways[: blocks * _CONTEXTS * _WAYS]
        ways += 4 * np.bincount(way.reshape(-1), minlength=len(ways))
        self._weigh(blocks)
        of = self.block[lane0]
        coded = np.bincount(of, minlength=blocks)
        first, at = np.unique((of[slot0 == _NEW] << 16) | x0[slot0 == _NEW], return_inverse=True)
        b = first >> 16
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.used[b] + rank < _SLOTS
        place = np.where(free, self.used[b] + rank, _NEW)
        self.slot[first] = place
        self.ids[b[free], place[free]] = first[free] & 0xFFFF
        slot = slot0.copy()
        slot[slot0 == _NEW] = place[at]
        self.used[:blocks] += np.bincount(b[free], minlength=blocks)
        width = int(self.used[:blocks].max())
        self.counts[:blocks, :width] += np.bincount(of * width + slot, minlength=blocks * width).reshape(blocks, width)
        self.counts[:blocks, :2] = 0
        new = np.bincount(of[slot0 == _NEW], minlength=blocks)
        self._rate(blocks, ((new + 1) << _BITS0) // (coded + 2))


def _shape(n: int) -> tuple[int, int]:
    """Stripes and steps of a block."""
    stripes = min(_STRIPES, max(1, n // _STRIPE_IDS))
    return stripes, -(-n // stripes)


class _Lanes:
    """Which blocks and stripes are under way at a step."""

    def __init__(self, lengths: list[int]) -> None:
        shapes = [_shape(n) for n in lengths]
        self.order = sorted(range(len(lengths)), key=lambda k: -shapes[k][1])
        self.stripes = np.array([shapes[k][0] for k in self.order], np.int64)
        self.steps = np.array([shapes[k][1] for k in self.order], np.int64)
        self.longest = int(self.steps[0]) if len(lengths) else 0
        self.ends = np.concatenate([[0], np.cumsum(self.stripes)])  # lanes of the first so many blocks
        self.blocks_at = np.searchsorted(-self.steps, -np.arange(self.longest + 1), "left")  # blocks with more steps

    def lanes_at(self, step: int) -> int:
        return int(self.ends[self.blocks_at[step]])


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes: magic, number of ids, CRC of the ids and of the payload; payload: words of each stripe, and the words."""
    if any(len(b) > BLOCK for b in blocks):
        raise ValueError(f"a block has {BLOCK} ids at most")
    lanes = _Lanes([len(b) for b in blocks])
    n, longest = int(lanes.ends[-1]), lanes.longest
    ids = np.zeros((longest + 2, n), np.int64)  # two rows of zeros first: what stands before a stripe
    for j, k in enumerate(lanes.order):
        stripes, steps = int(lanes.stripes[j]), int(lanes.steps[j])
        padded = np.zeros(stripes * steps, np.int64)
        padded[: len(blocks[k])] = blocks[k]
        ids[2 : 2 + steps, lanes.ends[j] : lanes.ends[j + 1]] = padded.reshape(stripes, steps).T
    model = _Model(lanes.stripes)
    low, rng = np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    room = np.repeat(4 * lanes.steps + 2, lanes.stripes)
    first = np.cumsum(room) - room
    out, pos = np.zeros(int(room.sum()), np.int32), first.copy()

    def put(k: slice | np.ndarray, start: np.ndarray, mass: np.ndarray, bits: int) -> None:
        r = rng[k] >> bits
        lo, size, p = start * r, mass * r, pos[k]
        lo += low[k]
        out[p] = lo >> 32  # stands if the word is full, else is overwritten; a carry stays in bit 16 till the end
        full = size <= _LOW
        np.bitwise_and(lo, _LOW, out=lo, where=full)
        shift = full.astype(np.int64) << 4
        low[k], rng[k], pos[k] = lo << shift, size << shift, p + full

    def again(now: int) -> None:
        """A second word of the lanes whose step had little mass."""
        k = np.flatnonzero(rng[:now] <= _LOW)
        if len(k):
            out[pos[k]] = low[k] >> 32
            low[k], rng[k] = (low[k] & _LOW) << 16, rng[k] << 16
            pos[k] += 1

    for t0, t1 in _generations(longest):
        live, after = lanes.lanes_at(t0), int(lanes.blocks_at[t1]) if t1 < longest else 0
        x = ids[t0 + 2 : t1 + 2, :live]
        k1, k2 = model.places(ids[t0 + 1 : t1 + 1, :live], ids[t0:t1, :live], live)
        e1, e2 = model.table1.take(k1, mode="clip"), model.table2.take(k2, mode="clip")
        hit2, hit1 = (e2 >> 4) == x, (e1 >> 4) == x
        way = model.context(e1, e2, live) * _WAYS + np.where(hit2, 0, np.where(hit1, 1, 2))
        start, mass = model.way_start.take(way, mode="clip"), model.way_mass.take(way, mode="clip")
        step, lane0 = np.nonzero(~(hit1 | hit2))
        x0 = x[step, lane0]
        of = model.block[lane0]
        slot0 = np.where(x0 >> 16, _WIDE, model.slot.take((of << 16) | (x0 & 0xFFFF)))
        at0 = of * model.width + slot0
        start <<= _BITS0
        flat = step * live + lane0
        whole = mass.reshape(-1)[flat]  # of order 0; an id has its share
        start.reshape(-1)[flat] += whole * model.start.take(at0, mode="clip")
        mass <<= _BITS0
        mass.reshape(-1)[flat] = whole * model.mass.take(at0, mode="clip")
        cuts = np.searchsorted(step, np.arange(t1 - t0 + 1)).tolist()
        for t in range(t1 - t0):
            now = lanes.lanes_at(t0 + t)
            put(slice(now), start[t, :now], mass[t, :now], _STEP_BITS)
            again(now)
            part = slice(cuts[t], cuts[t] + int(np.searchsorted(lane0[cuts[t] : cuts[t + 1]], now)))
            plain = np.flatnonzero(slot0[part] <= _WIDE) + part.start
            if len(plain):
                wide = plain[slot0[plain] == _WIDE]
                if len(wide):
                    put(lane0[wide], x0[wide] >> 16, np.ones(len(wide), np.int64), 16)
                put(lane0[plain], x0[plain] & 0xFFFF, np.ones(len(plain), np.int64), 16)
        if after:
            cut, held = int(lanes.ends[after]), lane0 < lanes.ends[after]
            model.learn(after, *(a[:, :cut] for a in (x, k1, k2, e1, e2, way)), lane0[held], slot0[held], x0[held])
    out[pos] = (low + _LOW) >> 32
    pos += 1
    while len(carried := np.flatnonzero(out >> 16)):
        np.add.at(out, carried - 1, 1)
        out[carried] &= 0xFFFF
    done: list[bytes] = [b""] * len(blocks)
    for j, k in enumerate(lanes.order):
        mine = range(int(lanes.ends[j]), int(lanes.ends[j + 1]))
        payload = (pos - first)[mine.start : mine.stop].astype("<u2").tobytes() + b"".join(out[first[i] : pos[i]].astype("<u2").tobytes() for i in mine)
        head = np.array([len(blocks[k]), zlib.crc32(np.asarray(blocks[k]).astype("<u4").tobytes()), zlib.crc32(payload)], "<u4").tobytes()
        done[k] = MAGIC + head + payload
    return done


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids (unsigned 32 bits) of each block; a wrong magic or checksum raises ValueError."""
    heads = []
    for d in data:
        length, ids_crc, payload_crc = np.frombuffer(d, "<u4", 3, 4).tolist() if len(d) >= 16 else (0, 0, -1)
        if d[:4] != MAGIC or length > BLOCK or zlib.crc32(d[16:]) != payload_crc:
            raise ValueError("a block is damaged")
        heads.append((length, ids_crc))
    lanes = _Lanes([h[0] for h in heads])
    n, longest = int(lanes.ends[-1]), lanes.longest
    parts, pos, size = [], np.empty(n, np.int64), 0
    for j, k in enumerate(lanes.order):
        stripes = int(lanes.stripes[j])
        lengths = np.frombuffer(data[k], "<u2", stripes, 16).astype(np.int64)
        pos[lanes.ends[j] : lanes.ends[j + 1]] = np.cumsum(lengths + 3) - lengths - 3 + size
        body = np.frombuffer(data[k], "<u2", offset=16 + 2 * stripes)
        padded = np.zeros(int(lengths.sum()) + 3 * stripes, np.int64)  # a stripe's last words may be zeros that were not written
        padded[np.arange(len(body)) + 3 * np.repeat(np.arange(stripes), lengths)] = body
        parts.append(padded)
        size += len(padded)
    words = np.concatenate([*parts, np.zeros(1, np.int64)])
    model = _Model(lanes.stripes)
    code, rng = (words[pos] << 32) | (words[pos + 1] << 16) | words[pos + 2], np.full(n, _TOP, np.int64)
    pos += 3

    def value(k: slice | np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        r = rng[k] >> bits
        return r, (code[k] / r).astype(np.int64)  # exact: both are under 2^48, and quotients under 2^28

    def take(k: slice | np.ndarray, r: np.ndarray, start: np.ndarray, mass: np.ndarray) -> None:
        c, left, p = code[k] - start * r, mass * r, pos[k]
        full = left <= _LOW
        shift = full.astype(np.int64) << 4
        c <<= shift
        np.bitwise_or(c, words.take(p, mode="clip"), out=c, where=full)
        code[k], rng[k], pos[k] = c, left << shift, p + full

    def again(now: int) -> None:
        k = np.flatnonzero(rng[:now] <= _LOW)
        if len(k):
            code[k], rng[k] = (code[k] << 16) | words.take(pos[k], mode="clip"), rng[k] << 16
            pos[k] += 1

    ids = np.zeros((longest + 2, n), np.int64)
    for t0, t1 in _generations(longest):
        live, after = lanes.lanes_at(t0), int(lanes.blocks_at[t1]) if t1 < longest else 0
        slot_by_mass = model.slot_by_mass()
        k1, k2, way = (np.zeros((t1 - t0, live), np.int64) for _ in range(3))
        e1, e2 = (np.zeros((t1 - t0, live), np.int32) for _ in range(2))
        order0 = []
        for t in range(t1 - t0):
            now = lanes.lanes_at(t0 + t)
            every, row = slice(now), t0 + t + 2
            k1[t, :now], k2[t, :now] = model.places(ids[row - 1, :now], ids[row - 2, :now], now)
            f1, f2 = model.table1.take(k1[t, :now], mode="clip"), model.table2.take(k2[t, :now], mode="clip")
            c = model.context(f1, f2, now)
            r, v = value(every, _STEP_BITS)
            way0 = v >> _BITS0
            not2, miss = way0 >= model.after2.take(c, mode="clip"), way0 >= model.after1.take(c, mode="clip")
            w = c * _WAYS + not2 + miss
            start, mass = model.way_start.take(w, mode="clip") << _BITS0, model.way_mass.take(w, mode="clip")
            x = ids[row, :now]
            x[:] = np.where(not2, f1, f2) >> 4
            e1[t, :now], e2[t, :now], way[t, :now] = f1, f2, w
            lane = np.flatnonzero(miss)
            whole = mass[lane]
            of = model.block[lane]
            slot = slot_by_mass.take((of << _BITS0) | ((v[lane] - start[lane]) / whole).astype(np.int64)).astype(np.int64)
            at = of * model.width + slot
            start[lane] += whole * model.start.take(at, mode="clip")
            mass <<= _BITS0
            mass[lane] = whole * model.mass.take(at, mode="clip")
            take(every, r, start, mass)
            again(now)
            x[lane] = model.ids.take(of * _SLOTS + slot)
            plain = np.flatnonzero(slot <= _WIDE)
            if len(plain):
                wide = plain[slot[plain] == _WIDE]
                high = np.zeros(now, np.int64)
                for k, far in ((lane[wide], True), (lane[plain], False))[len(wide) == 0 :]:
                    r, v = value(k, 16)
                    take(k, r, v, np.ones(len(k), np.int64))
                    if far:
                        high[k] = v << 16
                    else:
                        x[k] = high[k] | v
            order0.append((lane, slot, x[lane]))
        if after:
            cut = int(lanes.ends[after])
            lane0, slot0, x0 = (np.concatenate(c) for c in zip(*order0))
            held = lane0 < cut
            model.learn(after, ids[t0 + 2 : t1 + 2, :cut], *(a[:, :cut] for a in (k1, k2, e1, e2, way)), lane0[held], slot0[held], x0[held])
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(data)
    for j, k in enumerate(lanes.order):
        x = ids[2 : 2 + int(lanes.steps[j]), lanes.ends[j] : lanes.ends[j + 1]].T.reshape(-1)[: heads[k][0]].astype("<u4")
        if zlib.crc32(x.tobytes()) != heads[k][1]:
            raise ValueError("a block is damaged")
        found[k] = x
    return found
