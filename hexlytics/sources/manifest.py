"""Which raw files have been loaded: a manifest of batches, each written first and then committed.

A batch has an id of its own, so nothing depends on the checkpoint of a stream or on the order of
runs. Its file entries and landed rows lie in folders named by that id; they count from the moment
its one-row commit is there. What a run that died has left behind is never read. A file is known by
path, length and time of change: a changed file is a new entry, and the latest commit of a path is
the one whose rows count. Files that vanish from a folder keep their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hexlytics.sources.layers import read_or_none
from hexlytics.sources.raw import FILES

ENTRY = ["file", "length", "changed"]


@dataclass(frozen=True)
class Store:
    """The folders of an incrementally loaded set of layers, below one root."""

    root: str

    def __getattr__(self, table: str) -> str:
        if table.startswith("_"):
            raise AttributeError(table)
        return f"{self.root}/{table}"


def listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, length, changed) of all files below the folders. Contents are not read."""
    files = spark.read.format("binaryFile").options(**FILES).load(list(paths))
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("changed"))


def commits(spark: SparkSession, store: Store) -> DataFrame:
    """(batch, turn) of the committed batches."""
    found = read_or_none(spark, store.commits)
    return found if found is not None else spark.createDataFrame([], "batch string, turn long")


def entries(spark: SparkSession, store: Store) -> DataFrame:
    """(file, length, changed, batch, turn) of all committed files."""
    found = read_or_none(spark, store.files)
    if found is None:
        found = spark.createDataFrame([], "file string, length long, changed timestamp, batch string")
    return found.select(*ENTRY, "batch").join(commits(spark, store), "batch")


def current(spark: SparkSession, store: Store) -> DataFrame:
    """(file, batch): for each path, the batch whose rows count."""
    latest = F.row_number().over(W.partitionBy("file").orderBy(F.desc("turn")))
    return entries(spark, store).withColumn("_k", latest).where("_k = 1").select("file", "batch")


def new_files(spark: SparkSession, paths: Sequence[str], store: Store) -> DataFrame:
    """Files that are not in the manifest as they are now."""
    return listing(spark, paths).join(entries(spark, store), ENTRY, "left_anti")


def stage(listed: DataFrame, batch: str, store: Store) -> None:
    listed.select(*ENTRY).write.mode("overwrite").parquet(f"{store.files}/batch={batch}")


def commit(spark: SparkSession, batch: str, store: Store) -> None:
    """From here on the batch counts: one row in one file, which appears as a whole."""
    turn = commits(spark, store).agg(F.coalesce(F.max("turn"), F.lit(0)) + 1).first()[0]
    spark.range(1).select(F.lit(batch).alias("batch"), F.lit(turn).cast("long").alias("turn")).coalesce(
        1).write.mode("append").parquet(store.commits)


def landed(spark: SparkSession, store: Store) -> DataFrame | None:
    """All rows that committed batches have landed, with ``file`` and ``batch``. The broadcast has
    one row per batch."""
    rows = read_or_none(spark, store.landing)
    return None if rows is None else rows.join(
        F.broadcast(commits(spark, store).select("batch")), "batch", "left_semi")


def counting_rows(spark: SparkSession, store: Store) -> DataFrame | None:
    """The landed rows of each file's latest batch. The broadcast has one row per raw file, whose
    names the driver lists anyway; so the landed rows stay where they lie."""
    rows = read_or_none(spark, store.landing)
    return None if rows is None else rows.join(
        F.broadcast(current(spark, store)), ["file", "batch"], "left_semi").drop("file", "batch")


def pending(spark: SparkSession, store: Store) -> DataFrame:
    """(batch) committed, but not yet in all layers."""
    built = read_or_none(spark, store.built)
    out = commits(spark, store).select("batch")
    return out if built is None else out.join(built, "batch", "left_anti")


def mark_built(batches: DataFrame, store: Store) -> None:
    batches.select("batch").coalesce(1).write.mode("append").parquet(store.built)
