"""Kendall concordance of a table of (x, y) pairs of any size, exact and without a pair join.

A large table is reduced first: pairs get numbers that rise in (x, y) order and in (y, x) order, and
both are cut into parts of about four times the root of the table's size. Two rows of one part of the
first order meet in that part's task, others of one part of the second order in that one's; only
there rows are multiplied by bits, so no such copy is shuffled. All else is settled by the counts per
pair of parts, a table of at most a seventh of the rows. Small tables are taken by slices:

Pairs get their place in (x, y) order. For each bit of the place, rows that agree in all higher bits
form a block, whose rows without the bit lie left of those with it; any two places part at exactly
one bit. So on each level, a row of the right half counts the weight of the left half with a smaller
y less that with a larger one: running sums by y within blocks, taken over slices, of which no
task sees more than its own. What is left over are pairs of equal x, which the order counts as
concordant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hexlytics.operators.ordered import running_sum, sliced
from hexlytics.session import checkpointed

_WIDE = "decimal(38,0)"


def placed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``place``, 0 upwards in (x, y) order."""
    keyed = pairs.select("*", F.struct("x", "y").alias("_xy"), F.lit(1).cast("bigint").alias("_one"))
    return running_sum(sliced(keyed, [], "_xy"), [], "_xy", "_one", "place").drop("_xy", "_one", "_slice")


def halves(pairs: DataFrame, levels: int) -> DataFrame:
    """(level, block, y, left, right): weights of the two halves of each block per value of y."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    rows = pairs.select("place", "y", "weight", level).select(
        "level", "y", "weight", F.expr("shiftright(place, level + 1)").alias("block"),
        F.expr("shiftright(place, level) & 1").alias("half"))
    slices = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal keys share a range, so the sums need no second shuffle.
    spread = rows.repartitionByRange(slices, "level", "block", "y")
    return checkpointed(spread.groupBy("level", "block", "y").agg(
        F.sum(F.when(F.col("half") == 0, F.col("weight")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("half") == 1, F.col("weight")).otherwise(0)).alias("right"),
    ).withColumn("_slice", F.spark_partition_id()))


def numbered(pairs: DataFrame, slices: int) -> DataFrame:
    """(first, second, weight), stored: numbers that rise in (x, y) and in (y, x) order, with gaps."""
    def along(rows: DataFrame, *order: str) -> DataFrame:
        # Unique keys, so a task that runs twice gives its rows the same numbers.
        return rows.repartitionByRange(slices, *order).sortWithinPartitions(*order)

    first = along(pairs.select("x", "y", "weight"), "x", "y").select(
        F.monotonically_increasing_id().alias("first"), "x", "y", "weight")
    return checkpointed(along(first, "y", "x").select(
        "first", F.monotonically_increasing_id().alias("second"), "weight"))


def within_parts(rows: DataFrame, number: str, value: Column, bits: int, slices: int, kind: str) -> DataFrame:
    """Concordant minus discordant weight, as ``s``, of rows whose numbers differ in the lowest
    ``bits`` only; equal values count nothing. Rows of a part are multiplied in its task."""
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    parts = rows.select(F.shiftright(number, bits).alias("part"), F.col(number).alias("number"),
                        value.alias("value"), "weight").repartition(slices, "part")
    cut = parts.select("*", level).select(
        "part", "level", "value", F.expr("shiftright(number, level + 1)").alias("block"),
        *[F.when(F.expr("shiftright(number, level) & 1") == half, F.col("weight")).otherwise(0).alias(name)
          for half, name in enumerate(("left", "right"))])
    by = ["part", "level", "block"]
    values = W.partitionBy(*by).orderBy("value")
    below = F.coalesce(F.sum("left").over(values.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("left").over(values.rangeBetween(W.unboundedPreceding, W.currentRow))
    wide = lambda c: F.col(c).cast(kind)
    met = cut.select(*by, "left", "right", (below + upto).alias("reached")).groupBy(*by).agg(
        F.sum(wide("right") * wide("reached")).alias("s"), F.sum("left").alias("left"), F.sum("right").alias("right"))
    return met.agg(F.sum((F.col("s") - wide("left") * wide("right")).cast(_WIDE)).alias("s"))


def tied(pairs: DataFrame, axis: str) -> DataFrame:
    """Weight, as ``s``, of the pairs that agree on ``axis``."""
    wide = lambda c: F.col(c).cast(_WIDE)
    return pairs.groupBy(axis).agg(
        F.sum("weight").alias("w"), F.sum(wide("weight") * wide("weight")).alias("ww")
    ).agg(F.sum((wide("w") * wide("w") - F.col("ww")) / 2).alias("s"))


def signed_pairs(pairs: DataFrame, at_once: int = 1 << 20) -> int:
    """Concordant minus discordant pairs of (x, y, weight), each (x, y) at most once. Runs jobs when
    called, and reads ``pairs`` several times. Tables of more than ``at_once`` rows are reduced."""
    n, total = pairs.agg(F.count(F.lit(1)), F.sum(F.col("weight").cast(_WIDE))).first()
    if n < 2:
        return 0
    return (_reduced if n > at_once else _by_slices)(pairs, n, int(total), at_once)


def _reduced(pairs: DataFrame, n: int, total: int, at_once: int) -> int:
    bits = (n - 1).bit_length() // 2 + 2
    slices = max(1, n >> bits + 1)
    rows = numbered(pairs, slices)
    part = lambda c: F.shiftright(c, bits)
    kind = "bigint" if total * total < 1 << 62 else _WIDE
    counted = [within_parts(rows, "first", F.col("second"), bits, slices, kind),
               within_parts(rows, "second", part("first"), bits, slices, kind), tied(pairs, "x"), tied(pairs, "y")]
    same_first, same_second, tied_x, tied_y = (int(c.first()["s"] or 0) for c in counted)
    cells = checkpointed(rows.groupBy(part("first").alias("x"), part("second").alias("y")).agg(
        F.sum("weight").alias("weight")))
    # Both orders count pairs that agree on x or y as concordant.
    return same_first + same_second + signed_pairs(cells, at_once) - tied_x - tied_y


def _by_slices(pairs: DataFrame, n: int, total: int, at_once: int) -> int:
    cut = halves(placed(pairs), (n - 1).bit_length())
    by = ["level", "block"]
    below = running_sum(cut, by, "y", "left", "below")
    wide = lambda c: F.col(c).cast(_WIDE)
    reached = below.agg(F.sum(wide("right") * (2 * wide("below") + wide("left"))).alias("s"))
    totals = cut.groupBy(*by).agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    against = totals.agg(F.sum(wide("left") * wide("right")).alias("s"))
    parts = reached.unionByName(against).unionByName(tied(pairs, "x")).collect()
    return int(parts[0]["s"] or 0) - int(parts[1]["s"] or 0) - int(parts[2]["s"] or 0)
