"""Density clusters: embed, bin on the hex lattice, join adjacent dense bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L
from hexlytics.operators.hierarchy import density_clusters
from hexlytics.session import checkpointed


def cyclic_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_sin", "_cos"))]


def code_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, columns, n): one row per distinct tuple of codes, nulls as 0.

    The six cyclic codes take 24 x 7 x 12 values at most, however many rows there are.
    """
    filled = df.select(*by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    return filled.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))


def _scaled(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Centred and divided by the population deviation, rows counting ``n`` times each; a
    constant column is 0."""
    mean = (n[:, None] * x).sum(0) / n.sum()
    away = x - mean
    deviation = np.sqrt((n[:, None] * away * away).sum(0) / n.sum())
    constant = np.ptp(x, axis=0) == 0
    return np.where(constant, 0.0, away / np.where(constant | (deviation == 0), 1.0, deviation))


def standardised(counts: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Code counts with every column standardised over the rows of its group.

    A group holds distinct code tuples only, so it is small by construction.
    """
    def scale(rows: pd.DataFrame) -> pd.DataFrame:
        z = _scaled(rows[list(columns)].to_numpy(float), rows["n"].to_numpy(float))
        return rows.assign(**{f"z_{c}": z[:, k] for k, c in enumerate(columns)})

    return _per_group(counts, by, scale, "".join(f", z_{c} double" for c in columns))


def _per_group(counts: DataFrame, by: Sequence[str], fn, added: str) -> DataFrame:
    """``fn`` over the code counts of each group (of all, without ``by``)."""
    schema = ", ".join(f"{c} {t}" for c, t in counts.dtypes) + added
    if by:
        return counts.groupBy(*by).applyInPandas(fn, schema)
    whole = counts.withColumn("_one", F.lit(1)).groupBy("_one")
    return whole.applyInPandas(lambda rows: fn(rows.drop(columns="_one")), schema)


def components(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two principal directions of weighted rows, each with its largest loading positive."""
    _, vectors = np.linalg.eigh((n[:, None] * z).T @ z / n.sum())
    two = vectors[:, ::-1][:, :2]
    lead = np.argmax(np.round(np.abs(two), 9), axis=0)
    return two * np.where(two[lead, np.arange(two.shape[1])] < 0, -1.0, 1.0)


def embedding(counts: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Code counts with two principal components of the standardised columns of their group,
    ``embed_x`` and ``embed_y``."""
    def embed(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(float)
        z = _scaled(rows[list(columns)].to_numpy(float), n)
        point = z @ components(z, n)
        return rows.assign(embed_x=point[:, 0], embed_y=point[:, 1])

    return _per_group(counts, by, embed, ", embed_x double, embed_y double")


def connected_labels(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Component of each lattice cell (by, i, j): cells of one group are joined when they are
    neighbours.

    The label is the smallest cell of the component, packed into one number. Each round takes
    the smallest label of the ring, then the label of the labelled cell, so labels travel in
    doubling steps. A cell hears from at most six neighbours; the second step has one row per
    label on its other side, so a label that many cells share is split, not gathered. Rounds
    are cut by a checkpoint, and run when this is called.
    """
    pack = _pack(F.col("i"), F.col("j"))
    state = checkpointed(nodes.select(*by, "i", "j", pack.alias("node"), pack.alias("label")))
    while True:
        heard = (
            L.ring_cells(state, "label", "i", "j", 1)
            .groupBy(*by, F.col("ni").alias("i"), F.col("nj").alias("j"))
            .agg(
                F.max(
                    F.when((F.col("ni") == F.col("i")) & (F.col("nj") == F.col("j")),
                           F.col("label"))
                ).alias("old"),
                F.min("label").alias("label"),
            )
            .where(F.col("old").isNotNull())
            .select(*by, "i", "j", _pack(F.col("i"), F.col("j")).alias("node"), "old", "label")
        )
        used = heard.select(*by, "label").distinct()
        jump = heard.select(*by, F.col("node").alias("label"), F.col("label").alias("_next")).join(
            used, [*by, "label"])
        moved = checkpointed(
            heard.join(jump, [*by, "label"]).select(
                *by, "i", "j", "node", "old", F.col("_next").alias("label"))
        )
        if moved.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            return moved.select(*by, "i", "j", "label")
        state = moved.drop("old")


def _pack(i: Column, j: Column) -> Column:
    """Order-preserving pack of two lattice integers (each below 2**31 in size)."""
    return i * F.lit(1 << 32) + (j + F.lit(1 << 31))


def dense_regions(counts: DataFrame, dense: Column, min_size: int = K.MIN_CLUSTER_SIZE,
                  by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, n) -> (by, i, j, n, cluster): bins where ``dense`` holds, joined when adjacent.
    Regions under ``min_size`` rows and thin bins get -1; others are named by smallest bin."""
    keys = [*by, "i", "j"]
    labelled = connected_labels(counts.where(dense), by).join(counts, keys)
    sizes = labelled.groupBy(*by, "label").agg(F.sum("n").alias("size"))
    named = labelled.join(sizes, [*by, "label"]).select(
        *keys, F.when(F.col("size") >= min_size, F.col("label")).otherwise(-1).alias("cluster")
    )
    return counts.join(named, keys, "left").select(
        *keys, "n", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster")
    )


def cluster_incidents(df: DataFrame, cell: str, by: Sequence[str] = ("year", "month"),
                      bin_radius: float = 0.25, min_share: float = 0.005,
                      min_size: int = K.MIN_CLUSTER_SIZE) -> DataFrame:
    """Density clusters of the cyclic codes, each group of ``by`` for itself: (by, cell,
    embed_x, embed_y, cluster), -1 for noise.

    A bin is dense when it holds ``min_share`` of the group's rows, so more rows of the same
    kind leave labels as they are; a cluster has at least ``min_size`` rows. Rows are counted
    per distinct code tuple first; everything else works on that small table, and labels come
    back by the tuple.
    """
    rows, placed, bins = _binned(df, cell, by, bin_radius)
    if by:
        bins = bins.join(bins.groupBy(*by).agg(F.sum("n").alias("_all")), list(by))
    else:
        bins = bins.withColumn("_all", bins.agg(F.sum("n")).scalar())
    regions = dense_regions(bins, F.col("n") >= F.col("_all") * min_share, min_size, by)
    return _with_labels(rows, placed, regions, cell, by)


def density_incidents(df: DataFrame, cell: str, by: Sequence[str] = ("year", "month"),
                      bin_radius: float = 0.25, min_size: int = K.MIN_CLUSTER_SIZE,
                      prominence: float = 2.0) -> DataFrame:
    """``cluster_incidents`` by the density hierarchy of the bins: clusters may differ in density,
    and no share of the rows has to be chosen."""
    rows, placed, bins = _binned(df, cell, by, bin_radius)
    return _with_labels(
        rows, placed, density_clusters(bins, by, min_size, prominence), cell, by)


def _binned(df: DataFrame, cell: str, by: Sequence[str], bin_radius: float
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' codes, their distinct tuples with place and bin, and the bins' rows."""
    columns = cyclic_columns(df)
    rows = df.select(
        *by, cell, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    points = checkpointed(embedding(code_counts(rows, columns, by), columns, by))
    i, j = L.nearest_cell(F.col("embed_x"), F.col("embed_y"), bin_radius)
    placed = points.withColumn("i", i).withColumn("j", j)
    return rows, placed, placed.groupBy(*by, "i", "j").agg(F.sum("n").alias("n"))


def _with_labels(rows: DataFrame, placed: DataFrame, regions: DataFrame, cell: str,
                 by: Sequence[str]) -> DataFrame:
    columns = cyclic_columns(rows)
    known = placed.join(regions.drop("n"), [*by, "i", "j"]).select(
        *by, *columns, "embed_x", "embed_y", "cluster")
    return rows.join(known, [*by, *columns]).select(*by, cell, "embed_x", "embed_y", "cluster")


def hotspot_regions(counts: DataFrame, cell: str, min_cell: int,
                    min_size: int = K.MIN_CLUSTER_SIZE) -> DataFrame:
    """The same over map cells: (cell, n_crimes) -> region of adjacent cells with at least
    ``min_cell`` incidents."""
    level = L.id_part(F.col(cell), 1)
    placed = counts.select(
        level.alias("res"), L.id_part(F.col(cell), 2).alias("i"),
        L.id_part(F.col(cell), 3).alias("j"), F.col("n_crimes").alias("n"),
    )
    regions = dense_regions(placed.select("i", "j", "n"), F.col("n") >= min_cell, min_size)
    return placed.select("res", "i", "j").join(regions, ["i", "j"]).select(
        L.cell_id(F.col("res"), F.col("i"), F.col("j")).alias(cell), F.col("n").alias("n_crimes"),
        "cluster",
    )
