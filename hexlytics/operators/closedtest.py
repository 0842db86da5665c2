"""Hommel's adjusted p-values: the closed test with Simes' test of every set, without the sets.

Of the m sorted p-values, the i largest have the Simes value c_i, which is i times the least slope from
the point (m - i, 0) to the points (rank, p) right of it. Those slopes touch the lower convex hull of all
points. c falls with i, and a p-value's adjusted one is the largest min(c_i, i p) over i, which lies where
the two cross. Slices find their hulls as streams; the hull of these hulls is small (about log m corners
for p-values without pattern, ``MOST_CORNERS`` at most) and goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOST_CORNERS = 1_000_000


def lower_hull(rank: Iterator[float], p: Iterator[float]) -> list[tuple[float, float]]:
    """Corners of the lower convex hull of points with rising ranks."""
    corners: list[tuple[float, float]] = []
    for x, y in zip(rank, p):
        while len(corners) > 1:
            (x1, y1), (x2, y2) = corners[-2:]
            if (y2 - y1) * (x - x1) < (y - y1) * (x2 - x1):
                break
            corners.pop()
        corners.append((x, y))
    return corners


def _simes(size: np.ndarray, m: int, rank: np.ndarray, p: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """c of each size: from (m - size, 0) to the corner that the least slope touches."""
    x = m - size
    at = np.searchsorted(cross, x, "left")
    # Equal corners aside, rounding may favour a neighbour.
    best = np.full(len(x), np.inf)
    for near in (at - 1, at, at + 1):
        k = np.clip(near, 0, len(rank) - 1)
        slope = np.where(rank[k] > x, p[k] / np.maximum(rank[k] - x, 1e-300), np.inf)
        best = np.minimum(best, slope)
    return size * best


def adjusted(p: np.ndarray, m: int, corners: list[tuple[float, float]]) -> np.ndarray:
    """Adjusted values of some of the m p-values whose hull has these corners."""
    rank, low = (np.array(c, np.float64) for c in zip(*corners))
    rise = np.diff(low) / np.diff(rank)
    # Where the line along each side of the hull meets zero.
    cross = np.where(rise > 0, rank[:-1] - low[:-1] / np.where(rise > 0, rise, 1), -np.inf)
    few, many = np.ones(len(p)), np.full(len(p), m + 1.0)  # i p <= c_i at the first, not at the other
    while (many - few > 1).any():
        middle = np.floor((few + many) / 2)
        under = middle * p <= _simes(middle, m, rank, low, cross)
        few, many = np.where(under, middle, few), np.where(under, many, middle)
    beyond = np.where(few < m, _simes(np.minimum(few + 1, m), m, rank, low, cross), 0.0)
    return np.minimum(1.0, np.maximum(few * p, beyond))


def hommel(ranks: DataFrame, p: str, last: Column, m: int) -> Column:
    """The adjusted value of column ``p``. ``ranks`` has one row per distinct p-value; ``last`` is the
    rank of its last row. Runs a job when called."""
    points = ranks.select(F.col(p).alias("p"), last.cast("double").alias("rank"))
    slices = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = points.repartitionByRange(slices, "p").sortWithinPartitions("p")

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float]] = []
        for batch in batches:
            held = lower_hull([*[x for x, _ in held], *batch["rank"]], [*[y for _, y in held], *batch["p"]])
        yield pd.DataFrame(held, columns=["rank", "p"])

    found = spread.mapInPandas(corners, "rank double, p double").limit(MOST_CORNERS + 1).toPandas()
    if len(found) > MOST_CORNERS:
        raise ValueError(f"the hull of these p-values has over {MOST_CORNERS} corners")
    found = found.sort_values("rank")
    hull = lower_hull(found["rank"], found["p"])

    @F.pandas_udf("double")
    def value(some: pd.Series) -> pd.Series:
        return pd.Series(adjusted(some.to_numpy(np.float64), m, hull))

    return value(F.col(p))
