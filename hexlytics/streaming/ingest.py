"""Load raw files that have not been loaded yet, up to the layers.

The manifest tells what is new. A load lands the rows of new files as a batch, commits it, renews
bronze and all layers after it for the months the batch touches, and marks it as built. A run may die
anywhere: a batch without commit never counts and its files are new again; a committed one that is not
marked is built by the next run, which writes the same months again. So neither a repeated run nor a
stream with a lost or another checkpoint repeats or replaces rows. One load runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from hexlytics.operators.cleaning import quality_counts
from hexlytics.plans.bronze import kept, typed
from hexlytics.plans.refresh import Month, in_months, refresh, replace_months
from hexlytics.session import checkpointed
from hexlytics.sources import layers as T, manifest as M
from hexlytics.sources.manifest import Store
from hexlytics.sources.raw import FILES, read_raw

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def land(spark: SparkSession, paths: Sequence[str], store: Store) -> str | None:
    """Commit the rows of new files below ``paths`` as a batch; its id, or None without new files.

    What the load keeps and drops is counted while it writes, and stored with the batch.
    """
    listed = checkpointed(M.new_files(spark, paths, store))
    # As many paths as there are new files; the reader takes a list.
    files = listed.select("file", "length").collect()
    if not files:
        return None
    batch, seen = uuid.uuid4().hex, Observation()
    filled = sorted(unquote(r["file"]) for r in files if r["length"])
    if filled:
        rows = typed(read_raw(spark, filled, file="file"), carry=["file"])
        counted = rows.observe(seen, *quality_counts())
        T.write_partitioned(kept(counted).withColumn("batch", F.lit(batch)), store.landing,
                            ["batch", "year", "month"])
        if T.read_or_none(spark, f"{store.landing}/batch={batch}") is not None:
            quality = spark.createDataFrame([{"batch": batch} | seen.get])
        else:  # no row is kept: Spark leaves out the plan, and what it would have counted
            quality = rows.agg(*quality_counts()).withColumn("batch", F.lit(batch))
        quality.select("batch", "total_rows", "null_datetime", "null_coordinates", "kept_rows").coalesce(
            1).write.mode("append").parquet(store.quality)
    M.stage(listed, batch, store)
    M.commit(spark, batch, store)
    return batch


def touched_months(spark: SparkSession, batches: DataFrame, store: Store) -> list[Month]:
    """Months of the batches' rows, and of the rows they take the place of; calendar months only."""
    rows = M.landed(spark, store)
    if rows is None:
        return []
    files = M.entries(spark, store).join(batches, "batch", "left_semi").select("file").distinct()
    found = rows.join(F.broadcast(files), "file", "left_semi").select("year", "month").distinct()
    return sorted((r["year"], r["month"]) for r in found.collect())


def build(spark: SparkSession, store: Store) -> list[Month]:
    """Bring bronze and the layers up to the committed batches; the months renewed in bronze."""
    batches = checkpointed(M.pending(spark, store))
    if batches.limit(1).count() == 0:
        return []
    months = touched_months(spark, batches, store)
    if months:
        rows = M.counting_rows(spark, store).where(in_months(months))
        # Landed rows lie by month already.
        replace_months(spark, rows, store.bronze, ("year", "month"), months,
                       lambda df, to: T.write_partitioned(df, to, ("year", "month"), gather=False))
        refresh(spark, store, months)
    M.mark_built(batches, store)
    return months


def load(spark: SparkSession, paths: str | Sequence[str], store: Store) -> list[Month]:
    """Load new and changed raw files below the folders into all layers; the months renewed."""
    land(spark, [paths] if isinstance(paths, str) else paths, store)
    return build(spark, store)


def load_quality(spark: SparkSession, store: Store) -> DataFrame:
    """Per committed batch, what its load has kept and dropped, as counted on the way."""
    return spark.read.parquet(store.quality).join(M.commits(spark, store).select("batch"), "batch", "left_semi")


def follow(spark: SparkSession, path: str, store: Store, checkpoint: str) -> None:
    """Load whenever the folder has new files, until none is left. The stream reads names only and
    is nothing but the bell: what to load comes from the manifest."""
    (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**FILES).load(path).select("path")
        .writeStream.foreachBatch(lambda names, k: load(spark, path, store) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
