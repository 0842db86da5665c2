"""The layers of the test incidents as stored tables.

Each layer is written once per application and input folder, as in regular use, where a layer
is a table and the next one reads it. Tables lie in the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexlytics.plans.bronze import bronze
from hexlytics.plans.gold import gold_daily, gold_monthly, gold_rolling
from hexlytics.plans.silver import silver
from hexlytics.operators.cells import drill_map
from hexlytics.functions import lattice as L
from hexlytics.functions.subtree import with_subtree_key
from hexlytics.session import scratch_path
from hexlytics.sources import layers as T, raw as R
from pyspark.sql import functions as F
from workload.fixture import raw_incidents

_paths: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _paths:
        path = scratch_path(spark, name)
        write(build(), path)
        _paths[key] = path
    return _paths[key]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as yearly CSV files."""
    path = _stored(
        spark, sf_dir, "raw", lambda: raw_incidents(spark, sf_dir), R.write_raw_by_year
    )
    return R.read_raw(spark, path)


def bronze_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "bronze", lambda: bronze(raw_rows(spark, sf_dir)), T.write_bronze
    )


def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_layer(spark, bronze_path(spark, sf_dir), strict=True)


def silver_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "silver", lambda: silver(bronze_rows(spark, sf_dir)), T.write_silver
    )


def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_layer(spark, silver_path(spark, sf_dir), strict=True)


def gold_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "gold-daily", lambda: gold_daily(silver_rows(spark, sf_dir)), T.write_gold
    )


def gold_rows(spark: SparkSession, sf_dir: str, res: int | None = None) -> DataFrame:
    rows = T.read_layer(spark, gold_path(spark, sf_dir), strict=True)
    return rows if res is None else rows.where(F.col("res") == res)


def monthly_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "gold-monthly", lambda: gold_monthly(gold_rows(spark, sf_dir)),
        T.write_gold,
    )


def rolling_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "gold-rolling", lambda: gold_rolling(silver_rows(spark, sf_dir)),
        T.write_gold,
    )


def cells_of(gold: DataFrame) -> DataFrame:
    """(res, i, j) of the cells in a gold table."""
    return gold.select(
        "res", L.id_part(F.col("cell"), 2).alias("i"), L.id_part(F.col("cell"), 3).alias("j")
    )


def drill_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(
        spark, sf_dir, "drill-map", lambda: drill_map(cells_of(gold_rows(spark, sf_dir))),
        T.write_drill_map,
    )


def clustered_path(spark: SparkSession, sf_dir: str) -> str:
    """Daily cells of level 9 by year, in subtree order."""
    def build() -> DataFrame:
        rows = gold_rows(spark, sf_dir, 9).select("year", "cell", "date", "n_crimes")
        return with_subtree_key(
            rows, L.id_part(F.col("cell"), 2), L.id_part(F.col("cell"), 3), 9)

    return _stored(spark, sf_dir, "gold-clustered", build,
                   lambda df, path: T.write_clustered(df, path, ["year"], "subtree"))
