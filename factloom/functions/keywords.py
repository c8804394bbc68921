"""All keyword rules in one pass over a text: an automaton of every keyword, built once per Python worker.

The automaton gives each keyword's places; what a rule needs follows from the
first place of each of its keywords that stands there as a whole word: whether
it holds, whether it is behind a negation, and the span that shows it.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.rules import CLASSES, GUARDED, NEGATED, RISKS, SIGNALS

SIGNAL, RISK = 0, 1
#: (kind, field, value, severity, keywords) of all rules, in order.
_RULES = [(SIGNAL, f, v, None, k) for f, v, k in SIGNALS] + [(RISK, f, v, s, k) for f, v, s, k in RISKS]
_behind = re.compile(NEGATED)
_HIT = [("kind", pa.int32()), ("field_name", pa.string()), ("value", pa.string()), ("severity", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]
_DDL = "kind: int, field_name: string, value: string, severity: string, start_offset: int, end_offset: int"


@functools.cache
def _automaton(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k in keywords:
        found.add_word(k, k)
    found.make_automaton()
    return found


_RULE_WORDS = tuple(dict.fromkeys(k for *_, kws in _RULES for k in kws))
_CLASS_WORDS = tuple(dict.fromkeys(k for _, kws in CLASSES for k in kws))


def lowered(text: str) -> str:
    """The text in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def first_places(low: str) -> dict[str, int]:
    """The start of the first place of each keyword that stands in the text as a whole word."""
    out: dict[str, int] = {}
    for last, k in _automaton(_RULE_WORDS).iter(low):
        start = last + 1 - len(k)
        if k not in out and not (start and _is_word(low[start - 1])) and not (last + 1 < len(low) and _is_word(low[last + 1])):
            out[k] = start
    return out


def rule_spans(text: str | None) -> list[tuple]:
    """(kind, field, value, severity, start, end) of each rule that holds, by its first keyword in the rule's order; of stages the first only."""
    low = lowered(text or "")
    places = first_places(low)
    out: list[tuple] = []
    if not places:
        return out
    staged = False
    for kind, field, value, severity, keywords in _RULES:
        if field == "stage" and staged:
            continue
        for k in keywords:
            start = places.get(k)
            if start is not None and not ((field, value) in GUARDED and kind == SIGNAL and _behind.search(low[max(0, start - 80) : start])):
                out.append((kind, field, value, severity, start, start + len(k)))
                staged |= field == "stage"
                break
    return out


def _line(text: str, start: int, end: int) -> str:
    stop = text.find("\n", end)
    return text[text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(text)]


def _hits(lines: bool):
    kind = pa.list_(pa.struct([*_HIT, *([("text", pa.string())] if lines else [])]))
    names = [f.name for f in kind.value_type]

    def hits(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append([dict(zip(names, (*s, _line(t, s[4], s[5])) if lines else s)) for s in rule_spans(t)])
        return pa.array(out, kind)

    return F.arrow_udf(hits, f"array<struct<{_DDL}{', text: string' if lines else ''}>>")


def rule_hits(text: Column, lines: bool = False) -> Column:
    """array of the rules that hold, signals and then risks in their order; lines: with the line or lines of each span."""
    return _hits(lines)(text)


def class_scores(text: Column) -> Column:
    """array<int>: how many keywords of each document class occur anywhere in the text."""

    def scores(texts: pa.Array) -> pa.Array:
        words, out = _automaton(_CLASS_WORDS), []
        for t in texts.to_pylist():
            found = {k for _, k in words.iter((t or "").lower())}
            out.append([sum(k in found for k in kws) for _, kws in CLASSES])
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(scores, "array<int>")(text)
