"""Mergeable sketches of distinct values, so that longer periods need no second scan.

A sketch has at most 2 ** ``LG_SIZE`` registers. Sketches of days merge into those of months, those of
finer cells into their parents. The relative deviation of an estimate is about 1.04 / sqrt(2 ** LG_SIZE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K, schemas as S
from hexlytics.functions import lattice as L

LG_SIZE = 12
DEVIATION = 1.04 / 2 ** (LG_SIZE / 2)


def sketched(df: DataFrame, by: Sequence[str | Column], value: Column, out: str = "sketch") -> DataFrame:
    """One sketch of the distinct values per group; nulls do not count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(LG_SIZE)).alias(out))


def merged(sketches: DataFrame, by: Sequence[str | Column], sketch: str = "sketch") -> DataFrame:
    """The sketches of larger groups."""
    return sketches.groupBy(*by).agg(F.hll_union_agg(sketch, F.lit(False)).alias(sketch))


def estimated(sketches: DataFrame, out: str, sketch: str = "sketch") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate(sketch)).drop(sketch)


def street_sketches(silver: DataFrame, res: int = 9) -> DataFrame:
    """(cell, date, sketch): the distinct streets of each cell and day, for any longer period."""
    cell = F.col(f"h3_r{res}")
    street = S.column_or(silver, K.STREET_NAMES, F.lit(None).cast("string")).cast("string")
    return sketched(silver.where(cell.isNotNull()), [cell.alias("cell"), "date"], street)


def cell_sketches(silver: DataFrame) -> DataFrame:
    """(res, year, month, sketch): the distinct cells of each level and month."""
    levels = F.array(*[
        F.struct(F.lit(r).alias("res"), F.col(f"h3_r{r}").alias("cell")) for r in K.RESOLUTIONS])
    return sketched(silver.select("year", "month", F.inline(levels)), ["res", "year", "month"], F.col("cell"))


def parents_of(sketches: DataFrame, res: int) -> DataFrame:
    """Sketches by cell as sketches of the parent cells."""
    i, j = (L.id_part(F.col("cell"), k) for k in (2, 3))
    up_i, up_j = L.parent(i, j, res)
    rest = [c for c in sketches.columns if c not in ("cell", "sketch")]
    return merged(sketches.withColumn("cell", L.cell_id(res - 1, up_i, up_j)), ["cell", *rest])
