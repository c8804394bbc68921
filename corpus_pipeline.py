"""The training-data pipeline: stages that each read what the one before kept.

Quality rules, near-duplicate removal, benchmark decontamination, mixing to
target weights and token-ID output.  Each stage takes and returns rows with
the columns of documents, but the last, which returns each document's place,
length and checksum in the token files.

Defined cases: rows with a null or empty text fail the quality rules; a null
id or source passes through as in the stages' operators; equal rows count once
from the second stage on; an empty table gives no rows; other columns pass
through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontam, minhash, mixing, quality, tokenout
from factloom.llm.common import drop, staged, table
from factloom.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's budget takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files."""
    return tokenout.token_digests(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mixing_sources),
    ("token_output", token_output),
]

#: The method's floating-point verdicts and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads the token files that it has written
    drop(*before)
    return out
