"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to the smallest neighbour; both halves are one aggregation and
one join. Rounds are checkpointed and stop when nothing changes. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexlytics.session import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to the least of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Repeated edges do no harm here; the other half removes them.
    return both.join(_least(both), "u").where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a digest of them all; equal for equal sets of distinct edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of (a, b) edges with the smallest node it reaches.

    Runs jobs when called. Nodes need an order; nodes without edges do not appear.
    """
    at = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                      .where("u <> v").distinct())
    before = _mark(at)
    for _ in range(most_rounds):
        at = checkpointed(_small(_large(at)))
        last, before = before, _mark(at)
        if last == before:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    leaves = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
