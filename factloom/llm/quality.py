"""Quality rules: distance of a document's histograms from those of its language.

Two histograms describe a document: character classes (by code point) and
common words (a fixed list per language, and one bin for all other words).
References are the same histograms summed over every document of a language.
A document's divergence is its Jensen-Shannon distance (square root, base 2,
0..1) to the nearest reference; histograms of too few items are not judged.

Defined cases: a null or empty text has no words, so it fails the base rule;
a null or unlisted lang adds to no reference and is judged against all of
them; with no reference at all (empty table, no listed lang) the method
rejects nothing; repeated rows are judged each on its own; columns other than
the id, text and lang columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import keep_rows, words

# Frequent function words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and a to in is was that it for on with as are be by at this from or an have not which but they you his her".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais on".split(),
}

LETTER_LOWER, LETTER_UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER_PUNCT, BEYOND_ASCII = range(8)
N_CLASSES = 8

#: Marks of continuation bytes, which are no characters of their own, and of the counted symbols.
_CLASS = np.full(256, BEYOND_ASCII, np.uint8)
_CLASS[0:128] = OTHER_PUNCT
_CLASS[ord("a") : ord("z") + 1] = LETTER_LOWER
_CLASS[ord("A") : ord("Z") + 1] = LETTER_UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[list(b" \t\n\v\f\r")] = SPACE
_CLASS[list(b".,;:!?'\"()-")] = STOP
_CLASS[list(b"#*$%&|<>")] = SYMBOL
_CLASS[0x80:0xC0] = N_CLASSES

_BINS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
_OTHER = len(_BINS)
#: Written forms (case, one closing mark) of the listed words, so that a word needs one look-up.
_BIN = {(form + mark).encode(): k for k, w in enumerate(_BINS) for form in (w, w.upper(), w.capitalize()) for mark in ("", ".", ",", ";", ":", "!", "?")}


def char_classes(text: str | None) -> np.ndarray:
    """Code points by class; white space is the six ASCII bytes that end a word."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.bincount(_CLASS[data], minlength=N_CLASSES + 1)[:N_CLASSES]


def common_words(ws: list[bytes]) -> np.ndarray:
    return np.bincount(np.fromiter(map(_BIN.get, ws, repeat(_OTHER)), np.int64, len(ws)), minlength=_OTHER + 1)


def repeat_words(ws: list[bytes], window: int = 8) -> int:
    """Words inside a window of so many words that occurs twice or more; windows are compared exactly, by doubling ranks."""
    n = len(ws) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    for w in ws:
        ids.setdefault(w, len(ids))
    if len(ids) == len(ws):
        return 0
    rank = np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws))
    width = 1
    while True:
        step = min(width, window - width)
        pair = rank[: len(ws) - width - step + 1] * (len(ws) + 1) + rank[step : len(ws) - width + 1]
        width += step
        order = np.argsort(pair)
        new = np.diff(pair[order]) != 0
        if new.all():
            return 0
        if width == window:
            break
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
    same = ~new
    at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    edge = np.zeros(len(ws) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts in p to the counts q; an empty row has distance 0."""
    p = p / np.maximum(1, p.sum(axis=1, keepdims=True))
    q = np.broadcast_to(q / q.sum(), p.shape)
    m = np.where(p + q > 0, (p + q) / 2, 1)
    half = lambda x: np.sum(x * np.log2(np.where(x > 0, x, 1) / np.where(x > 0, m, 1)), axis=1)
    return np.sqrt(np.maximum(0.0, (half(p) + half(q)) / 2))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Both histograms of each listed language over every document.

    What reaches the driver is bounded by the word lists: languages x bins counts.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(N_CLASSES + _OTHER + 1, np.int64) for k in COMMON_WORDS}
        for b in batches:
            for t, of in zip(b.column(0), b.column(1)):
                t = t.as_py()
                sums[of.as_py()] += np.concatenate([char_classes(t), common_words(words(t))])
        yield pa.RecordBatch.from_pydict({"of": list(sums), "counts": [v.tolist() for v in sums.values()]}, pa.schema([("of", pa.string()), ("counts", pa.list_(pa.int64()))]))

    own = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("of")).where(F.col("of").isin(*COMMON_WORDS) & F.col("t").isNotNull())
    rows = own.mapInArrow(partial, "of string, counts array<long>").select("of", F.posexplode("counts").alias("bin", "n")).groupBy("of", "bin").agg(F.sum("n").alias("n")).where("n > 0").collect()
    out = {}
    for k in COMMON_WORDS:
        full = np.zeros(N_CLASSES + _OTHER + 1, np.int64)
        for r in rows:
            if r["of"] == k:
                full[r["bin"]] = r["n"]
        if full[:N_CLASSES].any() and full[N_CLASSES:].any():
            out[k] = (full[:N_CLASSES], full[N_CLASSES:])
    return out


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; rejected are documents that fail the base rule, or lie further than
    the allowed distance in one histogram, or than both_distances in both."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_char_distance: float = 0.3
    max_word_distance: float = 0.45
    both_distances: tuple[float, float] = (0.16, 0.32)
    min_judged_chars: int = 200
    min_judged_words: int = 50

    def judge(self, texts: list[str | None], refs: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """Counts, distances (NaN where not judged) and verdicts of some texts."""
        counts, class_rows, word_rows = [], [], []
        for t in texts:
            ws, chars = words(t), char_classes(t)
            class_rows.append(chars)
            word_rows.append(common_words(ws))
            counts.append((len(ws), chars.sum() - chars[SPACE], chars[SYMBOL], duplicate_lines(t), repeat_words(ws)))
        n, n_chars, symbols, lines, repeated = np.array(counts, np.int64).reshape(-1, 5).T

        def nearest(rows: list[np.ndarray], k: int, sizes: np.ndarray, least: int) -> np.ndarray:
            if not refs or not rows:
                return np.full(len(rows), np.nan)
            return np.where(sizes >= least, np.min([js_distances(np.array(rows), r[k]) for r in refs], axis=0), np.nan)

        cd, wd = nearest(class_rows, 0, n_chars, self.min_judged_chars), nearest(word_rows, 1, n, self.min_judged_words)
        failed = (n < self.min_words) | (100 * repeated > self.max_repeat_percent * n)
        far = (cd > self.max_char_distance) | (wd > self.max_word_distance) | ((cd > self.both_distances[0]) & (wd > self.both_distances[1]))
        return {"n_words": n, "word_chars": n_chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated, "char_distance": cd, "word_distance": wd, "base_failed": failed, "kept": ~failed & ~far}


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: counts, both distances (null when not judged), base_failed and kept."""
    refs = list(language_references(docs, text, lang).values())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = rules.judge(b.column(1).to_pylist(), refs)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, from_pandas=True) for v in found.values())], names=["doc_id", *found])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean")


def good_documents(docs: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and without a shuffle."""
    refs = list(language_references(docs, text, lang).values())
    return keep_rows(docs, text, lambda texts: rules.judge(texts, refs)["kept"])
