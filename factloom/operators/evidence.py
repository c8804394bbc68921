"""Where in a document each extracted field was read: spans, their lines and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.keywords import RISK, SIGNAL, rule_hits
from factloom.operators import extraction, joins
from factloom.operators.money import financial_struct, line_bounds


def _label_spans(text: str | None) -> list[dict]:
    """The first label line of each entity field that has a value; of a company's labels the first that stands in the text decides."""
    text, out = text or "", []
    for field, patterns in _LABELS:
        m = next((m for p in patterns if (m := p.search(text))), None)
        if m and re.sub(r"[\s,;]" if field != "company_name" else r"\s", "", m[1]):
            out.append({"field_name": field, "value": None, "start_offset": m.start(), "end_offset": m.end(), "text": text[slice(*line_bounds(text, *m.span()))]})
    return out


_label = lambda name: re.compile(rf"^[ \t]*{name}[ \t]*:[ \t]*([^\r\n]*)$", re.I | re.M)
_LABELS = [("company_name", [*map(_label, extraction.COMPANY_LABELS)]), *((f, [_label(p)]) for f, p in extraction.ENTITY_LABELS.items())]


_SPAN = pa.list_(pa.struct([("field_name", pa.string()), ("value", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("text", pa.string())]))
_SPAN_DDL = "array<struct<field_name: string, value: string, start_offset: int, end_offset: int, text: string>>"


def _by_rules(docs: DataFrame, extractor: str, spans: Callable[[str | None], list[dict]]) -> DataFrame:
    found = F.arrow_udf(lambda texts: pa.array([spans(t) for t in texts.to_pylist()], _SPAN), _SPAN_DDL)(F.col("text"))
    return _in_chunks(docs.select("doc_id", F.inline(found), F.char_length("text").alias("n")), extractor)


def _in_chunks(rows: DataFrame, extractor: str) -> DataFrame:
    n = F.col("n")
    placed = joins.containing_chunk(rows.withColumn("n_chunks", F.when(n <= 1000, 1).otherwise(F.ceil((n - 1000) / 800) + 1)))
    return placed.select("doc_id", F.lit(extractor).alias("extractor"), "field_name", "value", "start_offset", "end_offset", "text", F.col("chunk_idx").alias("chunk_index"))


def entity_evidence(docs: DataFrame) -> DataFrame:
    """The whole label line behind each entity field that has a value."""
    return _by_rules(docs, "entities", _label_spans)


def _rule_evidence(docs: DataFrame, extractor: str, kind: int) -> DataFrame:
    found = F.filter(rule_hits(F.col("text"), lines=True), lambda h: h["kind"] == kind)
    return _in_chunks(docs.select("doc_id", F.inline(found), F.char_length("text").alias("n")), extractor)


def signal_evidence(docs: DataFrame) -> DataFrame:
    """The first keyword behind each signal; of stages only the one that is the result."""
    return _rule_evidence(docs, "signals", SIGNAL)


def risk_evidence(docs: DataFrame) -> DataFrame:
    """The first keyword behind each risk."""
    return _rule_evidence(docs, "risks", RISK)


def financial_evidence(docs: DataFrame) -> DataFrame:
    """The money, or margin, behind each financial field, by start; value is the type of a valuation."""
    each = docs.select("doc_id", F.inline(financial_struct(F.col("text"))["evidence"]), F.char_length("text").alias("n"))
    return _in_chunks(each.withColumnRenamed("detail", "value"), "financials")


def profile_evidence(docs: DataFrame) -> DataFrame:
    """All evidence of each document, with the extractor's place in order."""
    parts = (entity_evidence(docs), financial_evidence(docs), signal_evidence(docs), risk_evidence(docs))
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("place", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def analysis_evidence(evidence: DataFrame, profiled: DataFrame) -> DataFrame:
    """(document_id, page, section, source_text, confidence): evidence as an analysis cites it; the section is the field's name."""
    joined = evidence.join(profiled.select("doc_id", "confidence"), "doc_id")
    return joined.select(F.col("doc_id").alias("document_id"), F.lit(None).cast("int").alias("page"), F.col("field_name").alias("section"), F.col("text").alias("source_text"), F.col("confidence").cast("decimal(5,4)").alias("confidence"))
