"""Declared schemas and plan-time column choice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hexlytics import constants as K

RAW_SCHEMA = T.StructType([T.StructField(raw, T.StringType()) for raw, _, _ in K.RAW_COLUMNS])

_SPARK = {
    "string": T.StringType(), "boolean": T.BooleanType(),
    "bigint": T.LongType(), "double": T.DoubleType(),
}

BRONZE_SCHEMA = T.StructType(
    [T.StructField(name, _SPARK[kind]) for _, name, kind in K.RAW_COLUMNS]
    + [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

CYCLIC_COLUMNS = [f"{p}_{f}" for p in ("hour", "dow", "month") for f in ("sin", "cos")]

SILVER_SCHEMA = T.StructType(
    [f for f in BRONZE_SCHEMA if f.name not in ("year", "month")]
    + [
        T.StructField("primary_type", T.StringType()),
        T.StructField("crime_category", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in CYCLIC_COLUMNS]
    + [T.StructField("street_norm", T.StringType())]
    + [T.StructField(f"h3_r{r}", T.StringType()) for r in K.RESOLUTIONS]
    + [
        T.StructField("date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

# Columns a serving query may read, and where each comes from when the usual name is absent.
SERVING_COLUMNS = [
    "datetime", "primary_type", "crime_category", "street_norm", "block_address", "arrest_made",
    "community_area_id", "district_id", "ward_id",
] + [f"h3_r{r}" for r in K.RESOLUTIONS]
SERVING_FALLBACKS = {
    "arrest_made": ["arrest"],
    "primary_type": ["crime_type"],
    "street_norm": ["block_address", "block"],
    "block_address": ["block"],
}


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def column_or(df: DataFrame, names: Iterable[str], default: Column) -> Column:
    name = first_present(df, names)
    return F.col(f"`{name}`") if name else default


def id_column(df: DataFrame) -> Column:
    """The incident id, or a generated one when the frame has none."""
    return column_or(df, K.ID_NAMES, F.monotonically_increasing_id())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order and type; absent ones null, others kept behind."""
    declared = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return df.select(*declared, *[c for c in df.columns if c not in schema.names])


def schema_differences(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column that is absent, unexpected, or of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in schema}
    rows = [
        (name, want.get(name), have.get(name))
        for name in sorted(set(have) | set(want))
        if have.get(name) != want.get(name)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")
