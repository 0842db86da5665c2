"""Order statistics without a global window.

Values are first reduced to one row per distinct value. Those rows are range-partitioned, the
slice number is fixed by a checkpoint, each slice gets the weight of the slices before it, and
running sums stay within a slice. No task ever sees a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hexlytics.session import checkpointed


def sliced(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Range-partition by (by, order) and record the slice each row fell into."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(slices, *[F.col(c) for c in by], F.col(order))
    return checkpointed(spread.withColumn("_slice", F.spark_partition_id()))


def _over_slices(cut: DataFrame, by: Sequence[str], order: str, value: Column, merge, empty,
                 out: str, descending: bool, inclusive: bool) -> DataFrame:
    """Running ``merge`` (sum, min, max) of ``value`` in order of ``order``."""
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    ahead = W.partitionBy(*by).orderBy(direction("_slice")).rowsBetween(
        W.unboundedPreceding, -1
    )
    inside = W.partitionBy(*by, "_slice").orderBy(direction(order)).rowsBetween(
        W.unboundedPreceding, W.currentRow if inclusive else -1
    )
    valued = cut.withColumn("_v", value)
    # One row per slice: a table as long as the number of shuffle partitions.
    totals = (
        valued.groupBy(*by, "_slice").agg(merge("_v").alias("_t"))
        .select(*by, "_slice", merge("_t").over(ahead).alias("_ahead"))
    )
    combine = {F.sum: lambda a, b: F.coalesce(a, empty) + F.coalesce(b, empty),
               F.min: F.least, F.max: F.greatest}[merge]
    return (
        valued.withColumn("_inside", merge("_v").over(inside))
        .join(totals, [*by, "_slice"])
        .withColumn(out, combine(F.col("_ahead"), F.col("_inside")))
        .drop("_v", "_inside", "_ahead")
    )


def running_sum(cut: DataFrame, by: Sequence[str], order: str, weight: str, out: str) -> DataFrame:
    """Weight of all smaller values (exclusive), per ``by``. ``cut`` comes from ``sliced``."""
    zero = F.lit(0).cast("bigint")
    return _over_slices(cut, by, order, F.col(weight), F.sum, zero, out, False, False)


def running_min_from_top(cut: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    return _over_slices(cut, [], order, value, F.min, None, out, True, True)


def running_max(cut: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    return _over_slices(cut, [], order, value, F.max, None, out, False, True)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n): one row per distinct value; nulls are left out."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``mid_rank`` to value counts."""
    placed = running_sum(sliced(counts, by, value), by, value, "n", "before")
    return placed.drop("_slice").withColumn(
        "mid_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    )


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts and ranks of each distinct value."""
    return ranked(value_counts(df, by, value), by, value)
