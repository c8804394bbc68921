"""Benchmark decontamination: a BM25 index of the test items, searched by every passage of the corpus.

Items are indexed by word pairs; a passage (a window of a document's words, as
long as two of the longest item, in half steps) is a query of its distinct
pairs.  An item's score is divided by its score for itself, so one threshold
serves short and long items.  Search is block-max WAND: items lie in blocks of
like length, and a block is scored only if the greatest weights of the query's
pairs in it reach the threshold; a passage whose pairs' greatest weights over
all items do not reach it needs no search at all.  Everything above the
threshold is retrieved, then verified: enough of the item's word shingles must
stand in the passage, and enough of the words of its question and of its
answer (its last sentence).

Items are dealt to parts of bounded size by a hash of their ids; each part's
index is sent to the tasks that scan the documents, one scan per part.

Defined cases: null or empty texts match nothing, nor do items without words;
an item of fewer words than a shingle is one shingle; equal item texts are
found each; repeated documents give their rows each; an empty table on either
side gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import keep_rows

_WORD = re.compile(r"\w+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a lone word pairs with nothing but itself."""
    return h[:-1] * _PAIR + h[1:] if len(h) > 1 else h


def shingles(ws: list[str], width: int = 5) -> set[tuple[str, ...]]:
    width = min(width, len(ws))
    return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if ws else set()


class ItemIndex:
    """Inverted index of items with the greatest weight of each pair, over all items and in each block of items."""

    def __init__(self, items: list[tuple[int, str | None]], k1: float = 1.2, b: float = 0.75, block: int = 64) -> None:
        rows = [(i, t or "", ws) for i, t in items if (ws := tokens(t))]
        rows.sort(key=lambda r: len(r[2]))
        self.ids = [r[0] for r in rows]
        self.words = [r[2] for r in rows]
        self.parts = [self._question_answer(r[1]) for r in rows]
        self.longest = max(map(len, self.words), default=0)
        self.block = block
        counts = [Counter(_pairs(_hashes(ws)).tolist()) for ws in self.words]
        df = Counter(t for c in counts for t in c)
        mean = sum(map(len, self.words)) / max(1, len(rows))
        n = len(rows)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(self.words[k]) / mean)) for t, f in c.items()}
            own = sum(w.values())
            for t, x in w.items():
                postings[t].append((k, x / own))
        self.terms = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(t)] for t in self.terms]
        self.most = np.array([max(x for _, x in p) for p in self.postings] + [0.0])
        self.blocks = []
        for p in self.postings:
            best: dict[int, float] = {}
            for k, x in p:
                best[k // block] = max(best.get(k // block, 0.0), x)
            self.blocks.append(best)

    @staticmethod
    def _question_answer(text: str) -> tuple[set[str], set[str]]:
        """Words of all sentences but the last, and of the last; both of the whole if there is one sentence."""
        cut = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text) if _WORD.search(s)]
        if len(cut) < 2:
            return set(tokens(text)), set(tokens(text))
        return set(tokens(" ".join(cut[:-1]))), set(tokens(cut[-1]))

    def lookup(self, pairs: np.ndarray) -> np.ndarray:
        """Term numbers; len(terms) for a pair that no item has."""
        if not len(self.terms):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.terms, pairs), len(self.terms) - 1)
        return np.where(self.terms[at] == pairs, at, len(self.terms))

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items (by place) whose share of their own score reaches the threshold, by block-max WAND."""
        bounds: dict[int, float] = defaultdict(float)
        for t in query:
            for k, x in self.blocks[t].items():
                bounds[k] += x
        open_ = {k for k, x in bounds.items() if x >= threshold - 1e-9}
        if not open_:
            return []
        lists = sorted((self.postings[t], self.most[t], 0) for t in query)
        cursors = [[p, m, 0] for p, m, _ in lists]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]][0])
            total, pivot = 0.0, -1
            for c in cursors:
                total += c[1]
                if total >= threshold - 1e-9:
                    pivot = c[0][c[2]][0]
                    break
            if pivot < 0:
                break
            if pivot // self.block in open_:
                target, score = pivot + 1, 0.0
                for c in cursors:
                    while c[2] < len(c[0]) and c[0][c[2]][0] < pivot:
                        c[2] += 1
                    if c[2] < len(c[0]) and c[0][c[2]][0] == pivot:
                        score += c[0][c[2]][1]
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                target = (pivot // self.block + 1) * self.block
            for c in cursors:
                while c[2] < len(c[0]) and c[0][c[2]][0] < target:
                    c[2] += 1
            cursors = [c for c in cursors if c[2] < len(c[0])]
        return found

    def verify(self, item: int, ws: list[str], least: float) -> float | None:
        """Share of the item's shingles in the words of the passage, or None where that, or either part's words, is too little."""
        own = shingles(self.words[item])
        share = len(own & shingles(ws, min(5, len(self.words[item])))) / len(own)
        have = set(ws)
        return share if share >= least and all(len(p & have) >= least * len(p) for p in self.parts[item]) else None


def held_items(index: ItemIndex, text: str | None, threshold: float, least: float) -> dict[int, tuple[float, float, int]]:
    """The items (by place) that a document holds: overlap, score and first word of its best passage."""
    width, step = 2 * index.longest + 16, max(1, index.longest)
    ws = tokens(text)
    if not ws or not index.ids:
        return {}
    terms = index.lookup(_pairs(_hashes(ws)))
    if (terms == len(index.terms)).all():
        return {}
    ends = np.concatenate([[0.0], np.cumsum(index.most[terms])])
    starts = np.arange(0, max(1, len(ws) - width + step), step)
    stops = np.minimum(starts + width - 1, len(terms))
    best: dict[int, tuple[float, float, int]] = {}
    for s in np.flatnonzero(ends[stops] - ends[np.minimum(starts, len(terms))] >= threshold - 1e-9):
        at = int(starts[s])
        query = np.unique(terms[at : stops[s]])
        for item, score in index.search(query[query < len(index.terms)].tolist(), threshold):
            share = index.verify(item, ws[at : at + width], least)
            if share is not None and (item not in best or (share, score) > best[item][:2]):
                best[item] = (share, score, at)
    return best


def _scan(index: ItemIndex, threshold: float, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(b.column(0), b.column(1)):
                for item, (share, score, at) in sorted(held_items(index, text.as_py(), threshold, least).items()):
                    for col, v in zip(out, (key.as_py(), index.ids[item], at, score, share)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), *(pa.array(v, t) for v, t in zip(out[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=["doc_id", "item_id", "passage_start", "score", "overlap"])

    return scan


def _indexes(items: DataFrame, item_id: str, item_text: str, part_bytes: int) -> Iterator[ItemIndex]:
    """The index of each part of the items; a part is dealt by hash and holds about part_bytes of text."""
    tests = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    for k in range(parts):
        yield ItemIndex([tuple(r) for r in tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()])


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, least: float = 0.75, part_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, passage_start, score, overlap): a row for each document and item it holds, by its best passage."""
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    found = None
    for index in _indexes(items, item_id, item_text, part_bytes):
        rows = own.mapInArrow(_scan(index, threshold, least), f"doc_id {kind}, item_id long, passage_start long, score double, overlap double")
        found = rows if found is None else found.unionAll(rows)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, least: float = 0.75, part_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that hold no item, with all their columns and without a shuffle."""
    for index in _indexes(items, item_id, item_text, part_bytes):
        docs = keep_rows(docs, text, lambda texts, index=index: np.array([not held_items(index, t, threshold, least) for t in texts], bool))
    return docs
