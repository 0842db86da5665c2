"""Density hierarchy of lattice bins: peaks, the levels at which they meet, clusters from them.

Bins of at least some count fall into connected parts. As the count sinks, a part is born at a
peak and dies where it meets one with a higher peak. That tree holds the regions of all
densities at once, so a thin cluster needs no threshold that a thick one sets.

A bin's rank is (n, -i, -j): ranks have no ties and name the bin. Every bin climbs to its
steepest neighbour, so the tree is one of peaks only; the levels at which the basins of two
peaks touch are kept, never pairs of bins. Rounds merge all parts whose best way out leads
upwards, cut by checkpoints, and run when the functions are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L
from hexlytics.session import checkpointed


def _rank() -> Column:
    return F.struct(F.col("n").cast("bigint").alias("n"), (-F.col("i")).alias("i"),
                    (-F.col("j")).alias("j"))


def _places(df: DataFrame, by: Sequence[str], *names: str) -> DataFrame:
    """Messages of each bin to itself and its six neighbours (``ni``, ``nj``)."""
    return L.ring_cells(
        df.select(*by, *names, (-F.col("rank.i")).alias("i"), (-F.col("rank.j")).alias("j")),
        "rank", "i", "j", 1)


def _own() -> Column:
    return (F.col("ni") == F.col("i")) & (F.col("nj") == F.col("j"))


def _followed(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, at, to, least) -> the end of each chain and the least of ``least`` on the way.

    An end points to itself. Steps double their reach; the further side has one row per ``at``,
    so a target many rows share is split, not gathered.
    """
    state = checkpointed(steps)
    while True:
        ahead = state.select(*by, F.col("at").alias("to"), F.col("to").alias("_to"),
                             F.col("least").alias("_least"))
        moved = checkpointed(state.join(ahead, [*by, "to"]).select(
            *by, "at", F.col("_to").alias("to"), F.least("least", "_least").alias("least"),
            (F.col("_to") != F.col("to")).alias("_moved")))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state


def basins(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, n) -> (by, rank, peak): the peak that each bin climbs to, as its rank."""
    heard = _places(counts.select(*by, _rank().alias("rank")), by, "rank")
    steps = heard.groupBy(*by, "ni", "nj").agg(
        F.max(F.when(_own(), F.col("rank"))).alias("at"), F.max("rank").alias("to")
    ).where(F.col("at").isNotNull())
    climbed = _followed(
        steps.select(*by, "at", "to", F.lit(None).cast("bigint").alias("least")), by)
    return climbed.select(*by, F.col("at").alias("rank"), F.col("to").alias("peak"))


def passes(based: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, level): the highest level at which the basins of two peaks touch, both ways."""
    told = _places(based, by, "rank", "peak")
    side = F.struct(F.col("peak"), F.col("rank.n").alias("n"))
    met = told.groupBy(*by, "ni", "nj").agg(
        F.max(F.when(_own(), side)).alias("own"), F.collect_list(side).alias("near")  # seven
    ).where(F.col("own").isNotNull())
    pairs = met.select(*by, "own", F.explode("near").alias("other")).where(
        F.col("own.peak") != F.col("other.peak"))
    return pairs.groupBy(*by, F.col("own.peak").alias("a"), F.col("other.peak").alias("b")).agg(
        F.max(F.least("own.n", "other.n")).alias("level"))


def _renamed(df: DataFrame, column: str, ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """``column`` replaced by the end of its chain, with the chain's ``_least``."""
    new = ends.select(
        *by, F.col("at").alias(column), F.col("to").alias("_new"), F.col("least").alias("_least"))
    return df.join(new, [*by, column], "left").withColumn(
        column, F.coalesce("_new", column)).drop("_new")


def merge_tree(based: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, at, to, level, mass) of every peak that meets a higher one: ``level`` is where it
    does, ``to`` a part it touches there, ``mass`` the rows of its part above that level.

    Highest peaks of connected bins have no row. A round merges every part whose best pass
    leads to a higher peak; the lowest part always has one, and parts that wait do so for a
    lower one that goes now.
    """
    links = checkpointed(passes(based, by))
    # ``least``: the lowest pass between a bin and the peak of its part.
    parts = checkpointed(based.select(
        *by, "rank", F.col("peak").alias("part"), F.lit(None).cast("bigint").alias("least")))
    done = []
    while True:
        best = links.groupBy(*by, "a").agg(F.max(F.struct("level", "b")).alias("best"))
        hooks = checkpointed(best.where(F.col("best.b") > F.col("a")).select(
            *by, F.col("a").alias("at"), F.col("best.b").alias("to"),
            F.col("best.level").alias("level")))
        if hooks.isEmpty() and done:
            return reduce(DataFrame.unionByName, done)
        within = parts.join(
            hooks.select(*by, F.col("at").alias("part"), "level"), [*by, "part"]
        ).where(F.least("rank.n", "least") > F.col("level"))
        mass = within.groupBy(*by, F.col("part").alias("at")).agg(F.sum("rank.n").alias("mass"))
        done.append(checkpointed(hooks.join(mass, [*by, "at"], "left").fillna(0, ["mass"])))
        stay = hooks.select(*by, F.col("to").alias("at")).distinct().join(
            hooks, [*by, "at"], "left_anti").select(*by, "at", F.col("at").alias("to"))
        ends = _followed(hooks.select(*by, "at", "to", F.col("level").alias("least")).unionByName(
            stay.withColumn("least", F.lit(None).cast("bigint"))), by)
        parts = checkpointed(_renamed(parts, "part", ends, by).select(
            *by, "rank", "part", F.least("least", "_least").alias("least")))
        moved = links
        for side in ("a", "b"):
            moved = _renamed(moved, side, ends, by).drop("_least")
        links = checkpointed(moved.where(F.col("a") != F.col("b")).groupBy(*by, "a", "b").agg(
            F.max("level").alias("level")))


def density_clusters(counts: DataFrame, by: Sequence[str] = (),
                     min_size: int = K.MIN_CLUSTER_SIZE, prominence: float = 2.0) -> DataFrame:
    """(by, i, j, n) -> (by, i, j, n, cluster): clusters of unequal density, -1 for noise.

    A peak counts when its part has ``min_size`` rows above the level where it meets a higher
    one and it is ``prominence`` times as high as that level, or if it meets none. Its cluster
    are the connected bins around it above the highest level at which it meets another peak
    that counts; what lies lower, and clusters of fewer than ``min_size`` rows, is noise. A
    cluster is named by its peak. Counts are one row per bin and not null; with no rows there
    are none.
    """
    based = checkpointed(basins(counts, by))
    tree = merge_tree(based, by)
    counts_as = (F.col("mass") >= min_size) & (F.col("at.n") >= F.col("level") * F.lit(prominence))
    judged = checkpointed(
        based.select(*by, F.col("peak").alias("at")).distinct().join(tree, [*by, "at"], "left")
        .withColumn("kept", F.col("to").isNull() | counts_as))
    known = _followed(judged.select(
        *by, "at", F.when(F.col("kept"), F.col("at")).otherwise(F.col("to")).alias("to"),
        F.when(~F.col("kept"), F.col("level")).alias("least")), by)
    met = judged.where(F.col("kept") & F.col("to").isNotNull()).select(*by, "at", "to", "level")
    joined = met.select(*by, F.col("to").alias("at"), "level").join(
        known.drop("least"), [*by, "at"])
    floors = met.select(*by, F.col("at").alias("cluster"), "level").unionByName(
        joined.select(*by, F.col("to").alias("cluster"), "level")
    ).groupBy(*by, "cluster").agg(F.max("level").alias("floor"))
    placed = based.join(
        known.select(*by, F.col("at").alias("peak"), F.col("to").alias("cluster"), "least"),
        [*by, "peak"]).join(floors, [*by, "cluster"], "left")
    floor = F.coalesce("floor", F.lit(-1))
    inside = (F.col("rank.n") > floor) & (F.coalesce("least", "rank.n") > floor)
    sizes = placed.where(inside).groupBy(*by, "cluster").agg(F.sum("rank.n").alias("size"))
    name = -F.col("cluster.i") * F.lit(1 << 32) + (-F.col("cluster.j") + F.lit(1 << 31))
    return placed.join(sizes, [*by, "cluster"], "left").select(
        *by, (-F.col("rank.i")).alias("i"), (-F.col("rank.j")).alias("j"),
        F.col("rank.n").alias("n"),
        F.when(inside & (F.col("size") >= min_size), name).otherwise(F.lit(-1).cast("bigint"))
        .alias("cluster"))
