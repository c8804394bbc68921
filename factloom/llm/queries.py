"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import attribution, decontam, fim, htmlmain, minhash, mixing, passages, prefixjoin, quality, quotes, runs, substrings, tokenout
from factloom.llm.common import staged, table


#: The tokenizer of the queries; operators take its path as a parameter.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.token_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = staged(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), "sizes")
    return mixing.mix_sources(sized, size="words").select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract_main_text(table(spark, sf_dir, "pages"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), TOKENIZER, sections=attribution.page_sections, rule="most")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, in every tenth with a tail that repeats."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * times + words[a : a + rest]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_tail)
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"), salt="7", rate=100, spm=50)


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_mix_sources, op3_substring_dedup, op4_main_text, op5_minhash_near_duplicates, op6_quotation_linking, op7_section_tokens, op8_benchmark_decontamination, op9_repeated_passages, op10_quality_rules, op11_ngram_jaccard, op12_periodic_runs, op13_fill_in_middle)}

ORACLES: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op5_minhash_near_duplicates": minhash.ORACLE, "op11_ngram_jaccard": prefixjoin.ORACLE, "op13_fill_in_middle": fim.ORACLE}
