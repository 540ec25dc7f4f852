"""The corpus pipeline: quality rules, line de-duplication, near-duplicate join,
benchmark decontamination, encoding. Each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.llm.bpe import bpe
from readroute.llm.common import load, materialize, numbered, place, with_key
from readroute.llm.decontaminate import leaks
from readroute.llm.line_dedup import line_dedup
from readroute.llm.ngram_join import ngram_join
from readroute.llm.quality import quality
from readroute.llm.queries import tokenizer_path


KEY = ["k1", "k2"]


def _column(docs: DataFrame, name: str) -> str:
    """The name that a column of `docs` has in with_key(docs)."""
    return f"c{place(docs.columns, name)}"


def _only(keyed: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of `keyed` whose key is among `rows`."""
    return keyed.join(rows.select(*KEY), KEY, how)


def _as(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of with_key(docs) under the names of `docs`."""
    return keyed.drop(*KEY).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own text.

    A null or empty text has no words and goes; texts of any length are measured whole.
    Rows alike in text, language and source have one verdict. All columns pass.
    """
    keyed = with_key(docs)
    judged = quality(keyed.withColumn("key", F.struct(*KEY)), "key", *[_column(docs, c) for c in ("text", "lang", "source")])
    return _as(docs, _only(keyed, judged.filter("kept").select("key.*")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut; those with nothing left go. n_chars is counted anew.

    The first occurrence by (doc_id, position) stays; null ids come first. A null or empty
    text that lost nothing stays. Rows alike in doc_id and text count as one text.
    """
    cut = line_dedup(numbered(docs), _column(docs, "doc_id"), _column(docs, "text"))
    text, n_chars = _column(docs, "text"), _column(docs, "n_chars")
    left = cut.filter((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    counted = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))
    return left.withColumn(n_chars, counted).drop("n_lines", "n_removed").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of least id; of rows alike one.

    A null id is the least only if the class has no other. Texts without a word are a
    class each and stay, but one of rows alike; texts of any length are compared whole.
    Rows that differ in nothing but columns of maps count as alike.
    """
    keyed = with_key(docs)
    joined = ngram_join(keyed, "k1", _column(docs, "text")).groupBy("k1").agg(F.min("component_id").alias("class"))
    order = F.struct(F.col("id").isNull(), F.col("id"), *KEY)
    named = keyed.select(*KEY, F.col(_column(docs, "doc_id")).alias("id")).join(joined, "k1")
    least = named.groupBy("class").agg(F.min(order).alias("least")).select("least.k1", "least.k2")
    return _as(docs, _only(keyed, least).dropDuplicates(KEY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, each row by its own text; null and empty texts stay, texts of any length are searched whole."""
    keyed = with_key(docs)
    found = leaks(keyed.withColumn("key", F.struct(*KEY)), load(spark, sf_dir, "benchmark"), id_col="key", text_col=_column(docs, "text"))
    return _as(docs, _only(keyed, found.select("key.*").distinct(), "left_anti"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and digests of each document, one row for each; a null text is empty, one of any length is encoded whole. Other columns go."""
    return bpe(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

ORACLE_SQL = None  # outlier verdicts, similarity classes and tokens have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
