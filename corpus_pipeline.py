"""Corpus preparation in stages; each stage is written as Parquet and read again as the next one's input.

Quality rules take boilerplate lines and poor documents out, language identification those without
a known language, SimHash all but one of each group of near copies. Personal data and the terms
that reveal it are replaced, and what is left is packed into sequences of 1024 ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.llm import langid, packing, pii, quality, queries, simhash
from finsearch.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_SCORE = 0.2  # of the n-grams of a text, the share that its language must know, unless its held-out texts reach less


def _sized(docs: DataFrame) -> DataFrame:
    """The number of characters follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their host repeats.

    Null, empty and short texts go; repeated rows and null ids are judged by their text; no rows give no rows.
    """
    return _sized(quality.cleaned(docs))


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known. Without any labelled document nothing can be told, and all stay.

    Texts without a letter go, and those of which the language knows fewer n-grams than ``MIN_SCORE`` and than
    nearly all of its own held-out texts show. Languages without a held-out text are judged by ``MIN_SCORE`` alone.
    """
    model = queries.language_filter(docs)
    if not model.languages:
        return docs
    least = langid.least_scores(docs.where(langid.held_out()), model).select(F.col("lang_pred").alias("_known"), F.col("least").alias("_least"))
    named = langid.predict(docs.withColumnsRenamed({"lang_pred": "_lang_pred", "score": "_score"}), model)
    bounded = named.join(F.broadcast(least), F.col("lang_pred") == F.col("_known"), "left")  # a row per language
    enough = F.col("score") >= F.least(F.lit(MIN_SCORE), F.col("_least"))  # least() passes nulls over
    known = bounded.where((F.col("lang_pred") != langid.UNKNOWN) & enough).drop("lang_pred", "score", "_known", "_least")
    return known.withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group that links of few differing bits connect: that of the smallest id.

    Equal texts are one group, repeated rows leave one; documents with a null id count as well. No rows give no rows.
    """
    return simhash.representatives(docs, queries.SHINGLE, queries.MAX_BITS)


def information_theoretic_pii(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced."""
    return _sized(pii.sanitised(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents as pieces with their ids and places in sequences.

    A null or empty text is one piece, its end; long texts are several; repeated rows are packed each; no rows give no rows.
    """
    return packing.pack(docs, queries.TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("information_theoretic_pii", information_theoretic_pii),
    ("best_fit_packing", best_fit_packing),
]

# SQL has no tokenizer and no such hash: tests/llm/test_pipeline.py compares with a brute-force run
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
