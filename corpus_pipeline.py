"""The corpus pipeline: quality, near duplicates, secrets, mixture, packing.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns the
documents it keeps, with their columns; the last one returns the pieces of the packed sequences.
Every stage reads what its predecessor has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexlytics.llm import mixing, neardup, packing, quality, secrets
from hexlytics.llm.tables import table
from hexlytics.session import remove_path, scratch_path

REJECT_BELOW = 0.5
ALIKE_PERCENT = 80  # least similarity of five-word shingles; op5's own contract has 85

ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is not below ``REJECT_BELOW``; trained on the labelled ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accept(docs, model, REJECT_BELOW)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (0.8 or more)."""
    return neardup.keep_one(docs, ALIKE_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; repeated documents are packed each time."""
    return packing.pack(docs)


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # nothing reads it any more
            remove_path(spark, before)
        before = path
    return docs
