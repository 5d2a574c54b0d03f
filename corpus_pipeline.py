"""Corpus pipeline: good documents, one of each near-duplicate group, none of the benchmark, no secrets, as token ids.

Each stage works on all documents that the one before kept; a stage's result is written as Parquet and read again.
Documents with a null text are judged as empty ones; columns that a stage does not need pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetable.llm.common import ready, table, written
from kinetable.llm.decontaminate import drop_contaminated
from kinetable.llm.neardup import drop_near_duplicates
from kinetable.llm.quality import keep_good, train
from kinetable.llm.secrets import redact_secrets
from kinetable.llm.subword import encode_and_check


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on the labels that aren't held out."""
    ready(spark)
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: shingles of five words, similarity of 0.8 or more."""
    ready(spark)
    return drop_near_duplicates(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    ready(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, ``n_chars`` counted anew."""
    ready(spark)
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text."""
    ready(spark)
    return encode_and_check(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("token_ids", token_ids),
]

#: The classifier's training can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
