"""Partitioned tables of the layers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from hexlytics import constants as K, schemas as S
from hexlytics.session import open_writers, remove_path
from hexlytics.sources.raw import normalize_months


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], gather: bool = True) -> None:
    """Overwrite only the partitions present in ``df``.

    Gathering collects small partitions into few files and splits a partition that holds much
    of the data over many tasks. It costs a shuffle, so it is left out where rows already lie
    by partition. Tasks write without sorting their rows.
    """
    with open_writers(df.sparkSession):
        _overwrite(df.hint("rebalance", *keys) if gather else df, path, keys)


def _overwrite(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path)
    )


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """``write_partitioned`` with the rows of a partition in ``order``: ranges of it go to tasks
    of their own, so files and row groups skip by their least and greatest value. Ranges are
    chosen from a sample of the rows, so a large partition is split into many."""
    rows = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    _overwrite(rows, path, keys)


def write_bronze(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["year", "month"])


def with_provenance(df: DataFrame, producer: str) -> DataFrame:
    """Declared types, and column metadata that parquet keeps with the schema."""
    note = {"h3_resolutions": ",".join(map(str, K.RESOLUTIONS)), "producer": producer}
    typed = S.conform(df, S.SILVER_SCHEMA)
    return typed.select(
        *[
            F.col(c).alias(c, metadata=note) if c.startswith("h3_r") else F.col(c)
            for c in typed.columns
        ]
    )


def write_silver(df: DataFrame, path: str, producer: str = "hexlytics.plans.silver") -> None:
    """Silver rows keep the order of bronze, which lies by month: no shuffle on the way."""
    write_partitioned(with_provenance(df, producer), path, ["year", "month"], gather=False)


def write_gold(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["res", "year", "month"])


def write_drill_map(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["parent_res", "child_res"])


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV: one file while it is small, more when it grows; the query above it keeps
    its own tasks."""
    df.hint("rebalance").write.mode("overwrite").option("header", True).csv(path)


def drop_partition(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    """Remove one partition of a table, wherever the table lies."""
    remove_path(spark, "/".join([path, *(f"{key}={value}" for key, value in values.items())]))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if it does not exist or has no file."""
    return _read(spark, path, strict=False)


def _read(spark: SparkSession, path: str, strict: bool) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if strict or error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _of_period(df: DataFrame, year: int | None, months, start_year: int | None) -> DataFrame:
    if start_year is not None:
        df = df.where(F.col("year") >= start_year)
    if year is not None:
        df = df.where(F.col("year") == year)
    if months is not None:
        df = df.where(F.col("month").isin(list(normalize_months(months))))
    return df


def _require(df: DataFrame, year: int | None, months) -> None:
    """Fail when a requested month has no partition (at most twelve rows come back)."""
    if months is None:
        return
    found = {r["month"] for r in df.select("month").distinct().collect()}
    absent = [m for m in normalize_months(months) if m not in found]
    if absent:
        raise FileNotFoundError(f"Missing partitions: year={year}, months={absent}")


def read_layer(spark: SparkSession, path: str, year: int | None = None,
               months: int | Iterable[int] | None = None, *, start_year: int | None = None,
               strict: bool = False) -> DataFrame | None:
    """A layer's rows of a period, by partition pruning.

    Lenient: absent partitions give no rows, an absent table gives None. Strict: both fail.
    """
    df = _read(spark, path, strict)
    if df is None:
        return None
    df = _of_period(df, year, months, start_year)
    if strict:
        _require(df, year, months)
    return df


def read_gold(spark: SparkSession, path: str, res: int, year: int | None = None,
              months: int | Iterable[int] | None = None, strict: bool = True) -> DataFrame | None:
    """Gold rows of one level, with the level's own column name for the cell."""
    df = read_layer(spark, path, strict=False)
    if df is None:
        if strict:
            raise FileNotFoundError(f"Missing table: {path}")
        return None
    df = _of_period(df.where(F.col("res") == res), year, months, None)
    if strict:
        _require(df, year, months)
    return df.withColumn("date", F.to_date("date")).withColumnRenamed("cell", f"h3_r{res}")


def read_drill_map(spark: SparkSession, path: str, parent_res: int, child_res: int) -> DataFrame:
    """The mapping of one pair of levels; empty when the table does not exist."""
    df = _read(spark, path, strict=False)
    if df is None:
        return spark.createDataFrame([], "parent string, child string")
    return df.where(
        (F.col("parent_res") == parent_res) & (F.col("child_res") == child_res)
    ).select("parent", "child")


def serving_view(silver: DataFrame) -> DataFrame:
    """The columns serving queries use, with fallbacks; unknown arrest counts as no."""
    out = []
    for name in [*SERVING, "month"]:
        names = [name, *S.SERVING_FALLBACKS.get(name, [])]
        source = S.first_present(silver, names)
        if source is None:
            continue
        column = F.col(source)
        if name == "arrest_made":
            column = F.coalesce(column.cast("boolean"), F.lit(False))
        out.append(column.alias(name))
    return silver.select(*out)


SERVING = S.SERVING_COLUMNS


def partitions(df: DataFrame, *keys: str) -> DataFrame:
    """The partitions a table has."""
    return df.select(*keys).distinct()
