"""One-row frames side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def beside(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns into one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
