"""From raw text columns to typed, bounded, complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions.features import tolerant_cast, with_moment

STANDARD_NAME = {raw: name for raw, name, _ in K.RAW_COLUMNS}
STANDARD_TYPE = {name: kind for _, name, kind in K.RAW_COLUMNS}


def standard_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(STANDARD_NAME)


def known_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in STANDARD_TYPE if c in df.columns])


def standard_types(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            tolerant_cast(F.col(c), STANDARD_TYPE[c]).alias(c) if c in STANDARD_TYPE else F.col(c)
            for c in df.columns
        ]
    )


def cast_failures(df: DataFrame) -> DataFrame:
    """Per typed column: values that had text but no valid value of the declared type."""
    typed = [c for c in df.columns if STANDARD_TYPE.get(c, "string") != "string"]
    counted = df.agg(
        *[
            F.count_if(
                F.col(c).isNotNull() & tolerant_cast(F.col(c), STANDARD_TYPE[c]).isNull()
            ).alias(c)
            for c in typed
        ]
    )
    return counted.unpivot([], typed, "column", "failures")


def with_datetime(df: DataFrame) -> DataFrame:
    if "created_date" not in df.columns:
        return df.withColumn("datetime", F.lit(None).cast("timestamp_ntz"))
    return with_moment(df, "created_date", "datetime")


def with_partition_values(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("datetime")).withColumn("month", F.month("datetime"))


def in_box(box: dict[str, tuple[float, float]]) -> Column:
    """Inclusive box; a missing coordinate is outside."""
    return F.coalesce(
        F.col("latitude").between(*box["lat"]) & F.col("longitude").between(*box["lon"]),
        F.lit(False),
    )


def has_datetime() -> Column:
    return F.col("datetime").isNotNull()


def missing_coordinate() -> Column:
    return F.col("latitude").isNull() | F.col("longitude").isNull()


def quality_counts() -> list[Column]:
    """What a load keeps and why the rest goes, as aggregates over rows before the row filters."""
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~has_datetime()).alias("null_datetime"),
        F.count_if(missing_coordinate()).alias("null_coordinates"),
        F.count_if(has_datetime() & in_box(K.BRONZE_BOX)).alias("kept_rows"),
    ]


def load_quality(typed: DataFrame) -> DataFrame:
    """One row: what the load keeps and why the rest goes. Input as before the row filters."""
    return with_dropped(typed.agg(*quality_counts()))


def with_dropped(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        (F.col("total_rows") - F.col("kept_rows")).alias("dropped_rows"),
        F.try_divide(
            (F.col("total_rows") - F.col("kept_rows")) * 100.0, F.col("total_rows")
        ).alias("dropped_percent"),
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["datetime", "latitude", "longitude"])


def fill_text(df: DataFrame) -> DataFrame:
    return df.fillna(K.UNKNOWN, subset=[c for c in K.TEXT_FILL_COLUMNS if c in df.columns])


def month_modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("year", "month")
                ) -> DataFrame:
    """Most frequent value of each column per month, smallest on ties.

    Counted per value first, so a month of any size arrives at the second step as one row per
    distinct value and task.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]
    )
    counts = (
        df.select(*by, F.inline(entries)).where(F.col("value").isNotNull())
        .groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = [
        F.max(F.when(F.col("field") == c, F.struct("n", (-F.col("value")).alias("v")))).alias(c)
        for c in columns
    ]
    picked = counts.groupBy(*by).agg(*best)
    return picked.select(*by, *[(-F.col(f"{c}.v")).alias(f"mode_{c}") for c in columns])


def fill_ids(df: DataFrame, by: Sequence[str] = ("year", "month")) -> DataFrame:
    """Null ids take the month's mode, or 0 where a month has none.

    The mode table has one row per calendar month of the data (at most 120 thousand for all
    years a date can hold), which bounds the broadcast.
    """
    columns = [c for c in K.ID_FILL_COLUMNS if c in df.columns]
    if not columns:
        return df
    modes = F.broadcast(month_modes(df, columns, by))
    return df.join(modes, list(by), "left").select(
        *[
            F.coalesce(F.col(c), F.col(f"mode_{c}"), F.lit(0).cast("bigint")).alias(c)
            if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def fill_report(df: DataFrame) -> DataFrame:
    """Rows dropped for a missing key field, and null counts that the fills will replace."""
    incomplete = F.col("datetime").isNull() | missing_coordinate()
    fields = [c for c in [*K.TEXT_FILL_COLUMNS, *K.ID_FILL_COLUMNS] if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(incomplete).alias("dropped_critical"),
        *[F.count_if(~incomplete & F.col(c).isNull()).alias(f"filled_{c}") for c in fields],
    )
