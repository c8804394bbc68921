"""Deterministic extractors: a document's text to structs and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.keywords import RISK, SIGNAL, rule_hits
from factloom.functions.rules import RISK_LISTS, SIGNAL_LISTS
from factloom.functions.spans import fold, squeeze
from factloom.operators.chunking import document_title, sections, type_from_title
from factloom.operators.money import financial_struct

# Labels of entity lines.
COMPANY_LABELS = ("company", "startup", "organization")
ENTITY_LABELS = {"founders": "founders?", "investors": "investors?", "accelerators": "accelerators?", "locations": "locations?", "sectors": "sectors?", "products": "products?", "technologies": "technolog(?:y|ies)"}


def _label(pattern: str) -> str:
    return rf"(?dim)^[ \t]*{pattern}[ \t]*:[ \t]*([^\r\n]*)$"


def financials(docs: DataFrame) -> DataFrame:
    """docs with a struct column financials (fields, confidence and evidence)."""
    return docs.withColumn("financials", financial_struct(F.col("text")))


def _of_kind(hits: Column, kind: int) -> Column:
    return F.filter(hits, lambda h: h["kind"] == kind)


def _values(hits: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["field_name"] == field), lambda h: h["value"])))


def _sure(hits: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.25) + F.size(hits) * F.lit(0.08)).alias("confidence")


def signals(text: Column) -> Column:
    """struct of stage, six sorted value lists and confidence."""
    hits = _of_kind(rule_hits(text), SIGNAL)
    stage = F.get(F.filter(hits, lambda h: h["field_name"] == "stage"), F.lit(0))["value"]
    return F.struct(stage.alias("stage"), *(_values(hits, n).alias(n) for n in SIGNAL_LISTS), _sure(hits))


def risks(text: Column) -> Column:
    """struct of six sorted risk lists, the severity of each risk found, and confidence."""
    hits = _of_kind(rule_hits(text), RISK)
    severity = F.map_from_entries(F.transform(hits, lambda h: F.struct(h["value"], h["severity"])))
    return F.struct(*(_values(hits, n).alias(n) for n in RISK_LISTS), severity.alias("severity"), _sure(hits))


def _first_of_each(items: Column) -> Column:
    """The items in order, of those equal without regard to case the first; the items are computed once, not again for each of them."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(fold(x).alias("key"), i.alias("at"), x.alias("value"))))
    firsts = F.transform(F.array(keyed), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"])))  # an array of one, so that a is a variable
    return F.transform(F.sort_array(F.transform(F.get(firsts, F.lit(0)), lambda x: F.struct(x["at"], x["value"]))), lambda x: x["value"])


def entities(text: Column) -> Column:
    """struct of company_name, seven lists from the first line of each label, and confidence."""
    company = F.lit(None).cast("string")
    for label in reversed(COMPANY_LABELS):
        company = F.when(text.rlike(_label(label)), F.nullif(squeeze(F.regexp_extract(text, _label(label), 1)), F.lit(""))).otherwise(company)

    def listed(pattern: str) -> Column:
        return _first_of_each(F.filter(F.transform(F.split(F.regexp_extract(text, _label(pattern), 1), r"\s*,\s*|\s*;\s*"), squeeze), lambda x: x != ""))

    present = sum((text.rlike(_label(p)).cast("int") for p in (*COMPANY_LABELS, *ENTITY_LABELS.values())), F.lit(0))
    return F.struct(company.alias("company_name"), *(listed(p).alias(n) for n, p in ENTITY_LABELS.items()), F.least(F.lit(1.0), F.lit(0.25) + present * F.lit(0.10)).alias("confidence"))


def metadata(title: Column, text: Column) -> Column:
    name = document_title(title, text)
    return F.struct(name.alias("title"), type_from_title(name).alias("document_type"), F.lit(None).cast("string").alias("language"), sections(text).alias("sections"), F.lit(1.0).alias("confidence"))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, metadata, entities, financials, signals, risks, confidence): one row per document.

    Financial fields and keyword rules are each one pass of a Python worker over
    the text; the structs follow from what they found.
    """
    out = financials(docs).withColumns({"metadata": metadata(F.col("title"), F.col("text")), "entities": entities(F.col("text")), "signals": signals(F.col("text")), "risks": risks(F.col("text"))})
    return out.select("doc_id", *COMPONENTS, profile_confidence().alias("confidence"))


COMPONENTS = ("metadata", "entities", "financials", "signals", "risks")


def profile_confidence() -> Column:
    """The mean of the components' confidences; a missing component counts as 1."""
    return sum((F.coalesce(F.col(f"{p}.confidence"), F.lit(1.0)) for p in COMPONENTS), F.lit(0.0)) / len(COMPONENTS)


def quality_metadata(profiled: DataFrame) -> Column:
    """struct of how many and which components are there, and the confidence of each; a component is missing where its struct is null."""
    there = F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), F.lit(p)) for p in COMPONENTS)))
    names = F.array(*map(F.lit, COMPONENTS))
    confidence = F.map_from_arrays(names, F.array(*(F.coalesce(F.col(f"{p}.confidence"), F.lit(1.0)) for p in COMPONENTS)))
    return F.struct(
        F.lit(len(COMPONENTS)).alias("expected"), F.size(there).alias("available"), (len(COMPONENTS) - F.size(there)).alias("missing"),
        there.alias("available_components"), F.array_except(names, there).alias("missing_components"), confidence.alias("component_confidence"),
    )
