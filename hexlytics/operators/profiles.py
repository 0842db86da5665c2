"""Temporal and offense profiles of a set of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions.features import arrest_flag, category_of


def _incidents() -> Column:
    return F.count(F.lit(1)).alias("incidents")


def arrest(df: DataFrame) -> Column:
    """1 for a row with an arrest, else 0; 0 for all rows of a frame without the column."""
    if "arrest_made" not in df.columns:
        return F.lit(0).cast("bigint")
    return arrest_flag(df, "arrest_made")


def _arrests(df: DataFrame) -> Column:
    return F.sum(arrest(df)).alias("arrests")


def daily_series(df: DataFrame) -> DataFrame:
    """Incidents and arrests per day, counted in one pass."""
    at = "datetime" if "datetime" in df.columns else "date"
    return (
        df.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("date"))
        .agg(_incidents(), _arrests(df))
    )


def daily_from_gold(gold: DataFrame) -> DataFrame:
    """The same from aggregates that already carry counts."""
    return gold.groupBy(F.to_date("date").alias("date")).agg(
        F.sum("n_crimes").alias("incidents"), F.sum("n_arrests").alias("arrests")
    )


def day_name(at: str = "datetime") -> Column:
    return F.date_format(at, "EEEE")


def on_weekday(df: DataFrame, day: str) -> DataFrame:
    return df.where(day_name() == day)


def hourly(df: DataFrame, day: str | None = None) -> DataFrame:
    """Incidents and arrests per hour, of one weekday when asked."""
    rows = on_weekday(df, day) if day else df
    return (
        rows.where(F.col("datetime").isNotNull()).groupBy(F.hour("datetime").alias("hour"))
        .agg(_incidents(), _arrests(df))
    )


def weekdays(df: DataFrame) -> DataFrame:
    """Monday to Sunday; a day without rows keeps null incidents and 0 arrests."""
    counts = (
        df.where(F.col("datetime").isNotNull()).groupBy(day_name().alias("dow"))
        .agg(_incidents(), _arrests(df))
    )
    week = df.sparkSession.createDataFrame(
        list(enumerate(K.WEEKDAYS)), "position int, dow string"
    )
    # Both sides have seven rows at most.
    return week.join(F.broadcast(counts), "dow", "left").select(
        "position", "dow", "incidents", F.coalesce("arrests", F.lit(0)).alias("arrests")
    )


def top_counts(df: DataFrame, column: str, limit: int, alias: str = "incident_count") -> DataFrame:
    """The most frequent values; the smaller value first on ties. Nulls are left out."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias(alias)).orderBy(F.col(alias).desc(), column).limit(limit)
    )


def offense_mix(df: DataFrame, top: int = 5, other: str = "Other") -> DataFrame:
    """Incidents per day and type, types beyond the most frequent gathered as one bucket.

    Rows are reduced to (date, type) before the top types are joined; that list has ``top`` rows.
    """
    column = next(c for c in ("primary_type", "crime_category") if c in df.columns)
    counts = (
        df.where(F.col("datetime").isNotNull())
        .groupBy(F.to_date("datetime").alias("date"), F.col(column).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    leading = (
        counts.where(F.col("type").isNotNull()).groupBy("type").agg(F.sum("n").alias("t"))
        .orderBy(F.col("t").desc(), "type").limit(top)
        .select("type", F.col("type").alias("bucket"))
    )
    return (
        counts.join(F.broadcast(leading), "type", "left")
        .groupBy("date", F.coalesce("bucket", F.lit(other)).alias("type_bucket"))
        .agg(F.sum("n").alias("incidents"))
    )


def arrest_outcome(df: DataFrame) -> DataFrame:
    """Incidents with and without an arrest, as two rows."""
    totals = df.where(F.col("datetime").isNotNull()).agg(_incidents(), _arrests(df))
    arrests = F.coalesce("arrests", F.lit(0))
    return totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("Arrests").alias("category"), arrests.alias("count")),
                F.struct(
                    F.lit("No arrest").alias("category"),
                    F.greatest(F.col("incidents") - arrests, F.lit(0)).alias("count"),
                ),
            )
        )
    )


def by_offense(df: DataFrame, limit: int = 12) -> DataFrame:
    """Incidents and arrests of the most frequent types, in long form."""
    wide = (
        df.where(F.col("primary_type").isNotNull()).groupBy("primary_type")
        .agg(_incidents(), _arrests(df))
        .orderBy(F.col("incidents").desc(), "primary_type").limit(limit)
    )
    return wide.unpivot(["primary_type"], ["incidents", "arrests"], "metric", "count")


def categories(df: DataFrame, column: str = "primary_type") -> DataFrame:
    """Every offense type with its category, once each."""
    types = df.where(F.col(column).isNotNull()).select(F.col(column).alias("type")).distinct()
    return types.select(category_of(F.col("type")).alias("category"), "type")


def filter_options(df: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """What a filter offers: mapped categories, and types (of the chosen categories if any)."""
    listed = categories(df)
    kinds = listed.where(F.col("category") != K.UNCLASSIFIED).select(
        F.lit("category").alias("option"), F.col("category").alias("value")
    )
    within = listed.where(F.col("category").isin(chosen)) if chosen else listed
    types = within.select(F.lit("type").alias("option"), F.col("type").alias("value"))
    return kinds.distinct().unionByName(types)
