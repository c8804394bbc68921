"""Prompts and run settings as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import answers

# Settings by mode.
RUN_MODES = (("standard", False, 768), ("deep", True, 1024))
RUN_VERSION = "3.7.5"


def fill_template(template: str, **values: Column) -> Column:
    """{name} replaced by each value, in one pass over the template; other names are an error when the plan is made."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] not in values:
            raise KeyError(m[1])
        parts += [F.lit(template[at : m.start()]), values[m[1]]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def context_block(document: Column, chunk: Column, relevance: Column, text: Column) -> Column:
    return F.concat(F.lit("[Document: "), document, F.lit(" | Chunk: "), F.coalesce(chunk, F.lit("None")), F.lit(" | Relevance: "), F.format_string("%.4f", relevance), F.lit("]\n"), text)


def thinking_directive(text: Column, thinking: Column) -> Column:
    """A user message with its trailing directive replaced."""
    bare = F.regexp_replace(text, r"(?U)\s*/(?:no_)?think\s*$", "")
    return F.concat(bare, F.when(thinking, "\n/think").otherwise("\n/no_think"))


def analysis_payload(company: Column, metrics: Column) -> Column:
    """JSON of a company and its metrics; nulls are left out, decimals are strings."""
    return F.to_json(F.struct(company.alias("startup"), metrics.alias("deterministic_financial_metrics")))


def output_schema() -> dict:
    """What an answer looks like, field by field: the fields that answers.valid takes."""
    return {f: "string or null" for f in answers.TEXTS} | {f: ["string"] for f in answers.LISTS} | {answers.RECOMMENDATION: " | ".join(answers.RECOMMENDATIONS)}


ANALYST = "You assess startups for an investor. Rely on the given data alone, never fill gaps with guesses, and answer with one JSON object."


def analysis_messages(company: Column, metrics: Column, system: str = ANALYST) -> Column:
    """The two messages that ask for an analysis: the payload of a company and its metrics, then the form of the answer."""
    form = f"\n\nAnswer with a JSON object of this form and nothing else:\n{json.dumps(output_schema(), ensure_ascii=False)}\nUse null where the data do not suffice and name what is missing under missing_information."
    return chat_messages(system, F.concat(F.lit("Assess this startup.\n\nData:\n"), analysis_payload(company, metrics), F.lit(form)))


def chat_messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def usable(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that ended by themselves, and those cut off."""
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return answers.where(~cut), answers.where(cut)


def run_settings(runs: DataFrame) -> DataFrame:
    """runs (mode, ...) with thinking, max_tokens and version by mode, in place of columns of these names."""
    spark = runs.sparkSession
    modes = spark.createDataFrame([(m, t, n, RUN_VERSION) for m, t, n in RUN_MODES], "mode string, thinking boolean, max_tokens int, version string")
    return runs.drop("thinking", "max_tokens", "version").join(F.broadcast(modes), "mode")  # two rows
