"""Incremental loads: every layer after several loads equals one built at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics.operators.cleaning import with_dropped
from hexlytics.session import scratch_path
from hexlytics.sources import layers as T, raw as R
from hexlytics.sources.manifest import Store
from hexlytics.streaming.ingest import land, load, load_quality
from workload import cell_queries, layer_queries  # noqa: F401  (their SQL is used here)
from workload.fixture import raw_incidents
from workload.registry import EXPECTED, query, rounded

_stores: dict[tuple[str, str], Store] = {}


def _put_file(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A few rows as one file of this very name, in place of an earlier one."""
    folder = scratch_path(spark, "one-file")
    rows.coalesce(1).write.options(**R.CSV).csv(folder)
    name = spark.read.text(folder).select("_metadata.file_path").first()[0]
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (name, path))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    system.delete(target, False)
    system.rename(source, target)


def loaded(spark: SparkSession, sf_dir: str) -> Store:
    """Layers after several loads of two folders that grow, once per session: a first load; a run that
    dies after landing; one that finds its batch and a second folder, whose files have their columns
    in another order; one in which a file has changed, so that its first rows must go, with a month
    that only they had; one without news."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        first, second = scratch_path(spark, "incoming"), scratch_path(spark, "incoming-too")
        store = Store(scratch_path(spark, "loaded"))
        rows = raw_incidents(spark, sf_dir)
        part = F.when(F.col("id").startswith("E"), 0).otherwise(F.crc32("id") % 3)
        changing = (part == 2) & (F.crc32("id") % 64 == 7)
        write = lambda df, to: df.write.mode("append").options(**R.CSV).csv(to)
        write(rows.where(part == 0), first)
        load(spark, first, store)
        write(rows.where(part == 1), first)
        land(spark, [first], store)
        write(rows.where((part == 2) & ~changing).select(*reversed(rows.columns)), second)
        wrong = rows.where(changing).withColumn("id", F.concat(F.lit("X"), "id"))
        lone = wrong.withColumn("date", F.lit("2031-05-06T07:08:09"))
        _put_file(spark, wrong.unionByName(lone), f"{first}/changing.csv")
        load(spark, [first, second], store)
        _put_file(spark, rows.where(changing), f"{first}/changing.csv")
        load(spark, [first, second], store)
        load(spark, [first, second], store)
        _stores[key] = store
    return _stores[key]


def _layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.read_layer(spark, getattr(loaded(spark, sf_dir), name), strict=True)


@query(EXPECTED["bronze_incidents"])
def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, "bronze").select(*layer_queries._BRONZE)


@query(EXPECTED["silver_features"])
def incremental_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir, "silver"))


@query(EXPECTED["gold_daily_cells"])
def incremental_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir, "daily"))


@query(EXPECTED["gold_monthly_cells"])
def incremental_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir, "monthly"))


@query(EXPECTED["gold_rolling_r9"])
def incremental_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir, "rolling"))


@query(EXPECTED["gold_rolling_across_months"])
def incremental_rolling_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir, "rolling_across"))


@query(EXPECTED["drill_mapping"])
def incremental_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, "drill")


@query(EXPECTED["load_quality"])
def observed_load_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of one load, counted while its rows were written."""
    incoming, store = scratch_path(spark, "incoming"), Store(scratch_path(spark, "observed"))
    R.write_raw_by_year(raw_incidents(spark, sf_dir), incoming)
    land(spark, [incoming], store)
    return rounded(with_dropped(load_quality(spark, store).drop("batch")))
