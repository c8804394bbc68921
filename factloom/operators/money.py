"""Financial fields of a text and the money spans behind them, by one pass over each text of an Arrow batch.

Which money is a raise, a valuation or a metric depends on the phrases around
it, on its order and on what others have taken; as columns this would evaluate
the same lines once a rule.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from factloom.functions.parsers import CURRENCIES, DURATION, MONEY, MULTIPLIERS, NUMBER

# Phrases that tie money to a raise, a round or a valuation, and metric keywords, in order.
RAISE_PHRASES = (
    r"\bamount\s+(?:being\s+)?raised\b",
    r"\braise\s+amount\b",
    r"\btarget\s+raise\b",
    r"\bfundraising\s+(?:target|amount)\b",
    r"\bamount\s+raising\b",
    r"\bcurrently\s+raising\b",
    r"\braising\b",
    r"\braised\b",
)
ROUND_PHRASES = (r"\b(?:funding|financing|investment)\s+round\b", r"\bround\s+size\b")
TICKET_PHRASES = ("minimum investment", "minimum ticket", "investment size")
VALUATIONS = (
    ("pre_money", r"\bpre[-\s]?money\s+valuation\b"),
    ("post_money", r"\bpost[-\s]?money\s+valuation\b"),
    ("valuation_cap", r"\bvaluation\s+cap\b"),
    ("unspecified", r"\b(?:numeric|company|current|estimated|indicative)?\s*valuation\b"),
    ("unspecified", r"\bvalued\s+at\b"),
)
METRICS = (("revenue", ("revenue", "sales", "income")), ("ebitda", ("ebitda",)), ("arr", ("arr", "annual recurring revenue")), ("burn_rate", ("burn", "burn rate")))
MARGINS = (r"\bebitda\s+margin\b(?:\s+(?:is|was|of|at|reached|increased\s+to|decreased\s+to))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%", r"(\d+(?:\.\d+)?)\s*%\s+\bebitda\s+margin\b")
CLIP = 40  # characters of a line to either side of money that speak for a raise

_any = lambda phrases: re.compile("|".join(phrases), re.I)
_MONEY, _NUMBER, _DURATION = (re.compile(p.replace("(?iuU)", ""), re.I) for p in (MONEY, NUMBER, DURATION))
_UNIT, _CURRENCY = re.compile(r"\d\s*([A-Za-z]+)\s*$"), re.compile(r"₹|\$|[A-Za-z]{3}|£|€")
_RAISE, _ROUND = _any(RAISE_PHRASES), _any(ROUND_PHRASES)
_VALUATIONS = [(name, re.compile(p, re.I)) for name, p in VALUATIONS]
_MARGINS = [re.compile(p, re.I) for p in MARGINS]
_CENT, _MOST = Decimal("0.0001"), Decimal(10) ** 16

_DECIMAL = pa.decimal128(20, 4)
_SPAN = pa.struct([("field_name", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("text", pa.string()), ("detail", pa.string())])
_TYPE = pa.struct(
    [("currency", pa.string()), ("raise_amount", _DECIMAL), ("valuation", _DECIMAL), ("valuation_type", pa.string())]
    + [(name, _DECIMAL) for name, _ in METRICS]
    + [("margin", _DECIMAL), ("runway_months", pa.int32()), ("confidence", pa.float64()), ("evidence", pa.list_(_SPAN))]
)
SCHEMA = (
    "currency string, raise_amount decimal(20,4), valuation decimal(20,4), valuation_type string, revenue decimal(20,4), ebitda decimal(20,4), arr decimal(20,4), burn_rate decimal(20,4), margin decimal(20,4), runway_months int, confidence double,"
    " evidence array<struct<field_name: string, start_offset: int, end_offset: int, text: string, detail: string>>"
)


def _decimal(value: Decimal) -> Decimal | None:
    """The value in four decimals, null beyond decimal(20,4)."""
    return value.quantize(_CENT, ROUND_HALF_UP) if abs(value) < _MOST else None


def line_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    stop = text.find("\n", end)
    return text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop


class Money:
    """One occurrence of money with its line."""

    def __init__(self, text: str, m: re.Match) -> None:
        self.start, self.end = m.span()
        number, unit, currency = _NUMBER.search(m[0])[0], _UNIT.search(m[0]), _CURRENCY.match(m[0])
        self.amount = _decimal(Decimal(number.replace(",", "")) * MULTIPLIERS.get(unit[1].lower() if unit else "", 1))
        self.currency = CURRENCIES.get(currency[0]) if currency else None
        begin, stop = line_bounds(text, self.start, self.end)
        self.line = text[begin:stop]
        first = max(begin, self.start - CLIP)
        self.near, self.at = text[first : min(stop, self.end + CLIP)], self.start - first

    def gap(self, phrases: re.Pattern) -> int | None:
        """Characters to the nearest phrase in the clipped line."""
        end = self.at + self.end - self.start
        return min((max(0, self.at - p.end(), p.start() - end) for p in phrases.finditer(self.near)), default=None)

    def names(self, keywords: tuple[str, ...]) -> bool:
        return any(k in self.line.lower() for k in keywords)


def _raise(found: list[Money]) -> Money | None:
    """The money most strongly tied to fundraising: explicit phrases before rounds, then the nearest, then the first."""
    rated = []
    for m in found:
        if not any(t in m.near.lower() for t in TICKET_PHRASES):
            rank = next(((k, gap) for k, gap in enumerate((m.gap(_RAISE), m.gap(_ROUND))) if gap is not None), None)
            if rank:
                rated.append((*rank, m.start, m))
    return min(rated, key=lambda r: r[:3])[3] if rated else None


def _valuation(found: list[Money]) -> tuple[Money | None, str]:
    """The first money whose line matches the first valuation pattern that any line matches."""
    for name, pattern in _VALUATIONS:
        for m in found:
            if pattern.search(m.line):
                return m, name
    return None, "unspecified"


def financial_fields(text: str | None) -> dict:
    """The financial fields of one text, and evidence for each, by start."""
    text = text or ""
    found = [m for x in _MONEY.finditer(text) if (m := Money(text, x)).amount is not None]
    values: dict[str, Decimal] = {}
    currency = None
    for m in found:  # each money in turn fills the first metric that is still empty and named in its line
        name = next((n for n, kws in METRICS if n not in values and m.names(kws)), None)
        if name:
            values[name] = m.amount
            currency = currency or m.currency
    raised, (valued, kind) = _raise(found), _valuation(found)
    margin = next((x for p in _MARGINS if (x := p.search(text))), None)
    months = _DURATION.search(text)
    spans, open_ = [], dict(values)
    for m in found:
        name = next((n for n, kws in METRICS if n in open_ and m.names(kws) and open_[n] == m.amount), None)
        if name:
            del open_[name]
            spans.append((m.start, m.end, name, None))
    if raised:
        spans.append((raised.start, raised.end, "raise_amount", None))
    if valued:
        spans.append((valued.start, valued.end, "valuation", kind))
    if margin:
        spans.append((*margin.span(), "margin", None))
    known = len(values) + (raised is not None) + (margin is not None) + (months is not None)
    out = {name: values.get(name) for name, _ in METRICS}
    return out | {
        "currency": (raised.currency if raised else None) or currency or (valued.currency if valued else None),
        "raise_amount": raised.amount if raised else None,
        "valuation": valued.amount if valued else None,
        "valuation_type": kind,
        "margin": _decimal(Decimal(margin[1])) if margin else None,
        "runway_months": int(months[1]) * (12 if months[2].lower().startswith("year") else 1) if months and len(months[1]) < 9 else None,
        "confidence": min(1.0, 0.25 + 0.1 * known),
        "evidence": [{"field_name": f, "start_offset": s, "end_offset": e, "text": text[slice(*line_bounds(text, s, e))], "detail": d} for s, e, f, d in sorted(spans, key=lambda x: x[0])],
    }


def financial_struct(text: Column) -> Column:
    """struct of the financial fields and array<struct<field_name, start_offset, end_offset, text, detail>> of evidence."""
    return arrow_udf(lambda texts: pa.array([financial_fields(t) for t in texts.to_pylist()], _TYPE), SCHEMA)(text)
