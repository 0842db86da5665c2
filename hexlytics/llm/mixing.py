"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies. Documents are laid end to end
in order of size, each as long as its expected copies; one random offset shifts the line, and a
document is emitted once per whole number it crosses. Because the line is sorted by size, the
words taken differ from the target by less than about one document.

Only column operations run here. Cases: null text has size 0; the null source is a source of its
own, last in order; a source without words has target 0 and takes nothing; repeated rows are rows
of their own; an empty table gives an empty result; further columns are kept by ``mix``.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hexlytics.llm.order import running_within
from hexlytics.llm.tables import source_key, word_count
from hexlytics.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20


def offset(seed: int = SEED) -> float:
    """The one random start in [0, 1)."""
    return random.Random(seed).random()


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """(_key, source_size, target) from rows of (_key, size).

    Sources in order of their key weigh ``weights``, repeating. They share ``share`` of all words;
    a source stops at ``most`` times its size and the rest is shared anew by weight. With sources
    ordered by ``cap / weight``, the level of the others is (what is left) / (weights left); the
    first source above that level ends the filling.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_key = W.orderBy("_key")
    everything = W.partitionBy()
    per = sized.groupBy("_key").agg(F.sum("size").alias("source_size")).select(
        "_key", "source_size", (F.col("source_size") * F.lit(float(most))).alias("_cap"),
        F.get(cycle, ((F.row_number().over(by_key) - 1) % len(weights)).cast("int")).alias("_w"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("_budget"),
    )
    rising = W.orderBy(F.col("_cap") / F.col("_w"), "_key")
    level = (
        F.col("_budget")
        - F.coalesce(F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("_w").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    filled = per.withColumn("_level", level).withColumn(
        "_open", F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_cap") / F.col("_w"))
    )
    last = F.min_by("_level", "_open").over(everything)
    return filled.select("_key", "source_size", F.coalesce(
        F.least(F.col("_cap"), F.col("_w") * last), F.col("_cap")).alias("target"))


def copies(sized: DataFrame, per_source: DataFrame, tie: Sequence[str], seed: int = SEED
           ) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows of (_key, size, ...)."""
    ranked = running_within(sized, "_key", ["size", *tie], F.lit(1).cast("long"), "_before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = lambda k: F.floor(F.col("_before") * rate + k * rate + F.lit(offset(seed)))
    return ranked.join(per_source, "_key").withColumn("copies", at(1) - at(0)).drop("_before")


def mixture(docs: DataFrame, seed: int = SEED, **weighting) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    Runs jobs when called: words are counted once and kept, as they are needed for the targets,
    for the cut points of the order, and for the order itself.
    """
    sized = checkpointed(docs.select(
        "doc_id", source_key(F.col("source")).alias("_key"),
        word_count(F.col("text")).alias("size")))
    per_source = targets(sized, **weighting)
    return copies(sized, per_source, ["doc_id"], seed).select(
        "doc_id", "_key", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: int = SEED, **weighting) -> DataFrame:
    """The documents themselves, each as many times as the mixture takes it.

    Rows alike in doc_id, source and size share their copies evenly, the first ones one more.
    """
    chosen = mixture(docs, seed, **weighting).groupBy("doc_id", "_key", "size").agg(
        F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")
    ).select(F.struct(F.col("doc_id").alias("d"), F.col("_key").alias("k"),
                      F.col("size").alias("s")).alias("_id"), "_all", "_rows")
    rows = docs.select(F.struct("*").alias("_row"), F.struct(
        F.col("doc_id").alias("d"), source_key(F.col("source")).alias("k"),
        word_count(F.col("text")).alias("s")).alias("_id"))
    joined = rows.join(chosen, rows["_id"].eqNullSafe(chosen["_id"])).drop(chosen["_id"])
    nth = F.row_number().over(W.partitionBy("_id").orderBy("_rows"))
    extra = (nth <= F.col("_all") % F.col("_rows")).cast("long")
    times = F.floor(F.col("_all") / F.col("_rows")) + extra
    return joined.withColumn("_times", times).where("_times > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    ).select("_row.*")
