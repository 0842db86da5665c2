"""Global positions without a global window.

Rows are range-partitioned and sorted, and each keeps its partition and place in one long. That
frame is checkpointed, so the partitions never change afterwards; what lies before a partition
follows from one count per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hexlytics.session import checkpointed

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row within it below


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in global order: ``_part`` and ``_place`` (from 0 within it), pinned by a checkpoint."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(partitions(df), *cols).sortWithinPartitions(*cols)
    at = checkpointed(spread.withColumn("_at", F.monotonically_increasing_id()))
    return at.select(
        *df.columns, F.shiftright("_at", _PLACE_BITS).alias("_part"),
        F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"),
    )


def row_numbers(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``out``: 0 to n - 1 in the given order. Ties beyond ``order`` fall as they lie."""
    at = placed(df, order)
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # One row per shuffle partition, however many rows the table has.
    starts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(before, F.lit(0)).alias("_start")
    )
    return at.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(out)
    )


def running_within(df: DataFrame, key: str, order: Sequence[str | Column], value: Column,
                   out: str) -> DataFrame:
    """``out``: sum of ``value`` (long) over the rows of the same ``key`` that come earlier.

    ``key`` must not be null. A key with most of the rows is spread over many partitions; what
    comes before a partition is one sum per (partition, key).
    """
    at = placed(df, [key, *order]).withColumn("_v", value)
    here = W.partitionBy("_part", key).orderBy("_place")
    ahead = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = at.groupBy("_part", key).agg(F.sum("_v").alias("_t")).select(
        "_part", key, F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = at.withColumn(
        "_inside", F.sum("_v").over(here.rowsBetween(W.unboundedPreceding, -1)))
    return inside.join(totals, ["_part", key]).select(
        *df.columns, (F.col("_ahead") + F.coalesce("_inside", F.lit(0))).alias(out)
    )
