"""Reports on stored layers and on row quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics import constants as K
from hexlytics.functions.features import cyclic_distance
from hexlytics.operators.cleaning import in_box, missing_coordinate


def _partition_of(path: str) -> dict:
    return {
        k: F.regexp_extract(F.col(path), rf"/{k}=(\d+)/", 1).try_cast("int")
        for k in ("res", "year", "month")
    }


def partition_manifest(spark: SparkSession, path: str, layer: str,
                       levels: Sequence[int] = (7, 8, 9), expected: DataFrame | None = None
                       ) -> DataFrame:
    """One row per stored file: its partition values, rows, and which cell columns hold values.

    A file that cannot be read has a row with an error. ``expected`` (year, month) adds a row
    for each month without any file.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True).load(path).select(F.col("path").alias("_path"))
    )
    rows = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(path)
    flags = {f"h3_r{r}": f"h3_r{r}" in rows.columns for r in levels}
    read = rows.select(
        F.col("_metadata.file_path").alias("_read"),
        *[F.col(c) if there else F.lit(None).cast("string").alias(c) for c, there in flags.items()]
    ).groupBy("_read").agg(
        F.count(F.lit(1)).alias("rows"), *[(F.count(c) > 0).alias(c) for c in flags])
    # Both paths in one spelling: some listings leave out the slashes of an empty host.
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(
        F.col(c), F.lit("+"), F.lit("%2B"))), "^([a-z]+:)/+", "$1/")
    files = listed.select(plain("_path").alias("path")).join(
        read.withColumn("path", plain("_read")).drop("_read"), "path", "left"
    ).withColumns(_partition_of("path")).withColumn("exists", F.lit(True))
    if expected is not None:
        files = expected.select("year", "month").join(files, ["year", "month"], "left").withColumn(
            "exists", F.coalesce("exists", F.lit(False))
        )
    return files.select(
        F.lit(layer).alias("layer"), "res", "year", "month", "path", "exists", "rows",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in flags],
        F.when(~F.col("exists"), "missing partition")
        .when(F.col("rows").isNull(), "unreadable or empty file").alias("error"),
    )


def rows_per_year(raw: DataFrame, bronze: DataFrame, raw_year, bronze_year) -> DataFrame:
    """Raw and kept rows of each year, dropped rows and percent."""
    before = raw.groupBy(raw_year.alias("year")).agg(F.count(F.lit(1)).alias("raw_count"))
    after = bronze.groupBy(bronze_year.alias("year")).agg(F.count(F.lit(1)).alias("kept_count"))
    joined = before.where(F.col("year").isNotNull()).join(after, "year", "full").na.fill(
        0, ["raw_count", "kept_count"]
    )
    dropped = F.col("raw_count") - F.col("kept_count")
    return joined.select(
        "*", dropped.alias("dropped_count"),
        F.coalesce(F.try_divide(dropped * 100.0, F.col("raw_count")), F.lit(0.0))
        .alias("drop_percent"),
    )


def coordinate_report(df: DataFrame, year) -> DataFrame:
    """Coordinates present, inside and outside the box, per year."""
    present = ~missing_coordinate()
    inside = in_box(K.BRONZE_BOX)
    return (
        df.groupBy(year.alias("year"))
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(present).alias("valid_coordinates"),
            F.count_if(present & inside).alias("in_bounds"),
            F.count_if(present & ~inside).alias("out_of_bounds"),
        )
        .withColumn(
            "out_of_bounds_percent",
            F.coalesce(
                F.try_divide(F.col("out_of_bounds") * 100.0, F.col("valid_coordinates")),
                F.lit(0.0),
            ),
        )
    )


def layer_size(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Files and bytes of a stored layer, from the listing; contents are not read. Files without
    rows count; files without bytes and markers of the writer do not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("length").agg(
        F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    )


def size_reduction(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Bytes of two stored layers and the reduction in percent (60 to 80 is the documented range)."""
    sizes = layer_size(spark, before, "before").unionByName(layer_size(spark, after, "after"))
    b = F.max(F.when(F.col("layer") == "before", F.col("bytes")))
    a = F.max(F.when(F.col("layer") == "after", F.col("bytes")))
    percent = F.try_divide((b - a) * 100.0, b)
    return sizes.agg(
        b.alias("bytes_before"), a.alias("bytes_after"), percent.alias("reduction_percent")
    ).withColumn("in_documented_range", F.col("reduction_percent").between(60, 80))


# --- fixed values: cycle, period, point, near point, far point ---------------------------------
CONTINUITY_POINTS = [
    ("hour", 24, 23, 1, 12),
    ("day_of_week", 7, 6, 0, 3),
    ("month", 12, 11, 0, 5),
]


def cyclic_continuity(df: DataFrame) -> DataFrame:
    """Per cycle: the distance over the wrap and across the circle, for the codes stored in a
    feature table (mean point of each step, so wrong codes show). One scan."""
    means, cycles = {}, []
    for column, _, point, near, far in CONTINUITY_POINTS:
        offset = 1 if column == "month" else 0
        prefix = {"day_of_week": "dow"}.get(column, column)
        for step in (point, near, far):
            for part in ("sin", "cos"):
                here = F.when(F.col(column) == step + offset, F.col(f"{prefix}_{part}"))
                means[f"{prefix}_{step}_{part}"] = F.avg(here)

        def apart(a: int, b: int):
            gaps = [F.col(f"{prefix}_{a}_{p}") - F.col(f"{prefix}_{b}_{p}") for p in ("sin", "cos")]
            return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1])

        cycles.append(F.struct(
            F.lit(column).alias("cycle"), apart(point, near).alias("near_distance"),
            apart(point, far).alias("far_distance")))
    one = df.agg(*[c.alias(name) for name, c in means.items()])
    return one.select(F.inline(F.array(*cycles))).withColumn(
        "valid", F.col("near_distance") < F.col("far_distance"))


def step_distances(df: DataFrame, column: str, period: int) -> DataFrame:
    """Distance on the circle between each pair of consecutive steps that occur."""
    steps = df.where(F.col(column).isNotNull()).select(F.col(column).alias("step")).distinct()
    following = (F.col("step") + 1) % period
    return steps.select(
        "step", following.alias("next_step"),
        cyclic_distance(F.col("step"), following, period).alias("distance"),
    )


def cell_success(silver: DataFrame) -> DataFrame:
    """Share of rows with a cell, per level."""
    named = [f"h3_r{r}" for r in K.RESOLUTIONS if f"h3_r{r}" in silver.columns]
    rates = silver.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in named])
    return rates.unpivot([], named, "level", "success_rate")
