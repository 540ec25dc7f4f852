"""Registered queries of the text operators: each runs over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.llm import bpe as _bpe
from readroute.llm import decontaminate as _decontaminate
from readroute.llm import html_difference as _html_difference
from readroute.llm import language as _language
from readroute.llm import language_model as _language_model
from readroute.llm import lexical_search as _lexical_search
from readroute.llm import line_dedup as _line_dedup
from readroute.llm import ngram_join as _ngram_join
from readroute.llm import quality as _quality
from readroute.llm import token_alignment as _token_alignment
from readroute.llm import token_counts as _token_counts
from readroute.llm import toxicity as _toxicity
from readroute.llm import url_filter as _url_filter
from readroute.llm.common import load, split_key


def tokenizer_path(name: str) -> str:
    """A vocabulary file; READROUTE_TOKENIZERS names the folder if the package is elsewhere."""
    if top := os.environ.get("READROUTE_TOKENIZERS"):
        return os.path.join(top, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_model.language_model(load(spark, sf_dir, "documents"))


def _held_out(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", split_key(F.col("doc_id"), 4) == 2)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = _language.learn(docs.filter(split_key(F.col("doc_id"), 4) != 2))
    return _held_out(_language.identify(docs, model))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of every text after the cut."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return _line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the splits of a host of equal probability, the one whose last word is longest counts."""
    return _url_filter.url_filter(load(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    machine = _toxicity.learn(docs, labels.filter(split_key(F.col("doc_id"), 4) != 2))
    return _held_out(_toxicity.toxicity(docs, machine))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word pieces: the pieces of a byte-level BPE file are taken as a word-piece vocabulary, its merges are not used."""
    return _token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_join.ngram_join(load(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality(load(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical_search.lexical_search(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_alignment.token_alignment(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_html_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_difference.html_difference(load(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_model": op1_language_model,
        "op2_language": op2_language,
        "op3_line_dedup": op3_line_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_decontamination": op5_decontamination,
        "op6_bpe": op6_bpe,
        "op7_toxicity": op7_toxicity,
        "op8_token_counts": op8_token_counts,
        "op9_ngram_join": op9_ngram_join,
        "op10_quality": op10_quality,
        "op11_lexical_search": op11_lexical_search,
        "op12_token_alignment": op12_token_alignment,
        "op13_html_difference": op13_html_difference,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": _line_dedup.ORACLE_SQL,
        "op9_ngram_join": _ngram_join.ORACLE_SQL,
        "op11_lexical_search": _lexical_search.ORACLE_SQL,
    }
