"""Cells in subtree order: one number whose range holds a cell and all cells below it.

The key is the coarsest ancestor's place, then one base-7 digit per level: which of its seven
children the path takes. Descendants of a cell at any level are one half-open range, so a drill
is a comparison that reaches the scan, without a mapping table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L

COARSEST = K.RESOLUTIONS[0]
_HALF = 1 << 20  # cells of the coarsest level lie within this distance of the origin


def subtree_width(res: int) -> int:
    """Keys of the finest level below one cell of ``res``."""
    return 7 ** (L.FINEST - res)


def with_subtree_key(df: DataFrame, i: Column, j: Column, res: int, name: str = "subtree"
                     ) -> DataFrame:
    """Add the key of cell (i, j) of level ``res``: the first key of its range. Null for a null
    cell; a column called ``name`` is replaced."""
    kept = [c for c in df.columns if c != name]
    out = df.select(*kept, i.alias("_si"), j.alias("_sj"), F.lit(0).cast("bigint").alias("_sk"))
    for level in range(res, COARSEST, -1):
        up_i, up_j = L.parent(F.col("_si"), F.col("_sj"), level)
        out = out.select(*kept, "_si", "_sj", "_sk", up_i.alias("_ui"), up_j.alias("_uj"))
        mid_i, mid_j = L.centre_child(F.col("_ui"), F.col("_uj"), level - 1)
        # The seven offsets from the centre child give 0 to 6.
        digit = 2 * (F.col("_si") - mid_i) + (F.col("_sj") - mid_j) + 3
        out = out.select(
            *kept, F.col("_ui").alias("_si"), F.col("_uj").alias("_sj"),
            (F.col("_sk") + digit * F.lit(subtree_width(level))).alias("_sk"))
    root = (F.col("_si") + F.lit(_HALF)) * F.lit(2 * _HALF) + F.col("_sj") + F.lit(_HALF)
    return out.select(
        *kept, (root * F.lit(subtree_width(COARSEST)) + F.col("_sk")).cast("bigint").alias(name))


def subtree_range(spark: SparkSession, cell: str) -> tuple[int, int]:
    """First key of a cell and the first one after it. Runs a one-row job, so that the arithmetic
    is that of the columns."""
    res = int(cell.split(":")[0])
    one = spark.range(1).select(F.lit(cell).alias("cell"))
    low = with_subtree_key(
        one, L.id_part(F.col("cell"), 2), L.id_part(F.col("cell"), 3), res).first()["subtree"]
    return low, low + subtree_width(res)


def below(df: DataFrame, cell: str, key: str = "subtree") -> DataFrame:
    """Rows whose cell is ``cell`` or lies below it. Literals, so the scan can skip by them."""
    low, high = subtree_range(df.sparkSession, cell)
    return df.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))
