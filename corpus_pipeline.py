"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, encoding.

Each stage takes the rows that the one before kept, with the columns of documents, and returns those it keeps; the last one
returns doc_id and the ids of the text. SQL cannot express the learned stages, so ORACLE_SQL is None and tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.llm import common, decontamination, languages, ngram_join, pieces, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is predicted with confidence; the model learns from the labelled rows of docs."""
    return languages.accepted(docs, languages.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, likeness of 0.8 or more)."""
    return ngram_join.one_of_each(docs, 5, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in texts replaced by its kind."""
    return pii.redacted(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of each text, and whether decoding them gave the text back."""
    done = pieces.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), decoded="decoded")
    return done.select("doc_id", "lang", "source", "n_chars", "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("same"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as a table before the next stage reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs)
    return docs
