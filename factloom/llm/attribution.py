"""Token counts by section: whole documents are encoded once, and token spans are joined to section spans.

A token has the characters (code points of the document) that it stands for.
The words of many documents are looked up at once in the table of ``tokenout``,
where each id keeps its characters within the word; adding the word's place
gives its span in the document, which is that of encoding the whole document,
as the table refuses tokenizers for which it would not be.  Sections and tokens
of those documents are then joined as intervals on one line of characters.

Each token goes to exactly one section, by a stated rule for tokens that cross
a border: "start" - the section of its first character; "end" - of its last;
"most" - of most of its characters, the first of equals.  Tokens outside all
sections are counted as section -1.

Defined cases: a null or empty text has no sections and gives no row; sections
without tokens give rows of 0; sections must not overlap, and may leave gaps;
repeated rows give their rows each; a null id passes through; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices
from factloom.llm.tokenout import WordTokenizer, word_tokenizer

Section = tuple[int, int]


def line_sections(text: str) -> list[Section]:
    """Lines with something in them."""
    return [m.span() for m in re.finditer(r"[^\n]+", text)]


def page_sections(text: str, width: int = 1000) -> list[Section]:
    """Pages of width characters, cut wherever that falls."""
    return [(k, min(k + width, len(text))) for k in range(0, len(text), width)]


def token_spans(tok: WordTokenizer, texts: list[str]) -> np.ndarray:
    """(start, end) of each token of the texts, in code points of all texts with one character between them."""
    joined = b"\n".join(t.encode("utf-8", "replace") for t in texts)
    data = np.frombuffer(joined, np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(data) and inside[0]:
        first = np.concatenate([[0], first])
    if not len(first):
        return np.empty((0, 2), np.int64)
    place = np.cumsum((data & 0xC0) != 0x80)[first] - 1  # of each word, in code points
    word = tok.numbers([joined.split()])
    begin, lens = tok.starts[:-1][word], np.diff(tok.starts)[word]
    ends = np.cumsum(lens)
    rows = np.arange(int(ends[-1])) - np.repeat(ends - lens - begin, lens)
    return tok.spans[rows] + np.repeat(place, lens)[:, None]


def allocate(spans: np.ndarray, sections: list[Section] | np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and which tokens cross a border of their section."""
    starts, ends = np.asarray(sections, np.int64).reshape(-1, 2).T
    if not len(starts):
        return np.full(len(spans), -1), np.zeros(len(spans), bool)

    def holding(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, "right") - 1
        return np.where((k >= 0) & (at < ends[np.maximum(k, 0)]), k, -1)

    first, last = holding(spans[:, 0]), holding(np.maximum(spans[:, 1] - 1, spans[:, 0]))
    crossing = (first != last) & (spans[:, 1] > spans[:, 0])
    if rule == "start":
        out = np.where(first >= 0, first, last)
    elif rule == "end":
        out = np.where(last >= 0, last, first)
    elif rule == "most":
        out = first.copy()
        for t in np.flatnonzero(crossing):
            s, e = spans[t]
            lo = np.searchsorted(ends, s, "right")
            hi = np.searchsorted(starts, e, "left")
            held = [int(min(e, ends[k]) - max(s, starts[k])) for k in range(lo, hi)]
            out[t] = lo + int(np.argmax(held)) if held else -1
    else:
        raise ValueError(f"no such rule: {rule}")
    return out, crossing


def section_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", sections: Callable[[str], list[Section]] = line_sections, rule: str = "start") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): a row for each section, and one of section -1 if tokens are left over."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path, offsets=True)
        for whole in batches:
            for b in slices(whole, 1):
                some = [k for k, t in enumerate(b.column(1)) if t.is_valid and len(t.as_buffer())]
                texts = [b.column(1)[k].as_py() for k in some]
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                base = np.cumsum(lengths + 1) - lengths - 1
                parts = [sections(t) for t in texts]
                n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
                of = np.repeat(np.arange(len(texts)), n_parts)
                number = np.arange(len(of)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                borders = np.array([x for p in parts for x in p], np.int64).reshape(-1, 2)
                spans = token_spans(tok, texts)
                where, crossing = allocate(spans, borders + base[of, None], rule)
                n = np.bincount(where[where >= 0], minlength=len(of))
                cross = np.bincount(where[crossing & (where >= 0)], minlength=len(of))
                out = where < 0
                loose = np.searchsorted(base, spans[out, 0], "right") - 1
                rest = np.unique(loose)
                rows = np.array(some, np.int64)[np.concatenate([of, rest])]
                null = np.concatenate([np.zeros(len(of), bool), np.ones(len(rest), bool)])
                at = lambda k: pa.array(np.concatenate([borders[:, k], rest]), pa.int64(), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(np.concatenate([number, np.full(len(rest), -1)])),
                        at(0),
                        at(1),
                        pa.array(np.concatenate([n, np.bincount(loose, minlength=len(texts))[rest]])),
                        pa.array(np.concatenate([cross, np.bincount(loose[crossing[out]], minlength=len(texts))[rest]])),
                    ],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(count, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")
