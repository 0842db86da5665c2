"""Cell aggregates: daily and monthly counts, rates, ring pooling, rolling sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window as W, functions as F

from hexlytics import constants as K, schemas as S
from hexlytics.functions import lattice as L, rates as R
from hexlytics.functions.features import arrest_flag

FINEST = f"h3_r{L.FINEST}"
_BLOCK_BITS = 4  # lattice lines of a block, as a power of two


def _flag(df: DataFrame):
    name = S.first_present(df, K.ARREST_NAMES)
    return arrest_flag(df, name) if name else F.lit(0).cast("bigint")


def daily_counts(df: DataFrame, cell: str) -> DataFrame:
    """(cell, date) -> n_crimes, n_arrests at one level; rows without a cell are left out."""
    return (
        df.where(F.col(cell).isNotNull())
        .groupBy(F.col(cell).alias("cell"), "date")
        .agg(F.count(F.lit(1)).alias("n_crimes"), F.sum(_flag(df)).alias("n_arrests"))
    )


def daily_levels(silver: DataFrame, levels: Sequence[int] = tuple(K.RESOLUTIONS)) -> DataFrame:
    """Daily counts at every level: ``res, i, j, date, n_crimes, n_arrests``.

    Incidents are scanned and hashed once, at the finest level, from one id column. Coarser
    levels are sums over the much smaller daily table, since a parent follows from its child.
    """
    finest = daily_counts(silver, FINEST).select(
        L.id_part(F.col("cell"), 2).alias("_i"), L.id_part(F.col("cell"), 3).alias("_j"),
        "date", "n_crimes", "n_arrests",
    )
    per_level = F.array(
        *[
            F.struct(
                F.lit(r).alias("res"), F.col(f"i{r}").alias("i"), F.col(f"j{r}").alias("j")
            )
            for r in levels
        ]
    )
    return (
        L.with_levels(finest)
        .select(F.inline(per_level), "date", "n_crimes", "n_arrests")
        .groupBy("res", "i", "j", "date")
        .agg(F.sum("n_crimes").alias("n_crimes"), F.sum("n_arrests").alias("n_arrests"))
    )


def with_month_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date")).withColumn("month", F.month("date"))


def month_priors(daily: DataFrame, by: Sequence[str] = ("res", "year", "month")) -> DataFrame:
    """Arrests over incidents of each (level, month), 0 without incidents."""
    return daily.groupBy(*by).agg(
        R.raw_rate(F.sum("n_arrests"), F.sum("n_crimes")).alias("prior")
    )


def with_prior(df: DataFrame, priors: DataFrame, by: Sequence[str] = ("res", "year", "month")
               ) -> DataFrame:
    """The prior table has one row per level and calendar month, which bounds the broadcast.

    Every dated row has a prior. The inner join lets both sides share one scan and shuffle.
    """
    return df.join(F.broadcast(priors), list(by))


def with_rates(df: DataFrame, alpha: float = K.PRIOR_WEIGHT) -> DataFrame:
    """raw_rate, low_conf, smoothed_rate, ci_low, ci_high from counts and ``prior``."""
    n, k = F.col("n_crimes"), F.col("n_arrests")
    low, high = R.wilson(k, n)
    return df.select(
        "*",
        R.raw_rate(k, n).alias("raw_rate"),
        (n < K.LOW_CONFIDENCE_BELOW).alias("low_conf"),
        R.smoothed(k, n, F.col("prior"), alpha).alias("smoothed_rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def pooled_counts(daily: DataFrame, pool_k: int = 1) -> DataFrame:
    """Add ``pooled_n``, ``pooled_k``: same-day counts over the cell and its ring.

    A cell's ring is a run of cells on each of 2k + 1 lattice lines. Rows go to blocks of lines (to
    the next block as well if their ring reaches it) in the only shuffle; there each row sends its
    counts to its lines, equal places add up, and a place takes from those up to k before and behind
    it. A window partition is one lattice line of one level and day, and holds few cells.
    """
    if pool_k < 1:
        none = F.lit(0).cast("bigint")
        return daily.withColumn("pooled_n", none).withColumn("pooled_k", none)
    reach = range(-pool_k, pool_k + 1)
    block = lambda at: F.shiftright(at, _BLOCK_BITS)
    first = block(F.col("i") - pool_k)
    blocks = F.array(*[first + n for n in range(2 + (2 * pool_k >> _BLOCK_BITS))])
    # Without it, Spark sees that i is not null and filters below the counts, which the priors share.
    holds = lambda condition: F.coalesce(condition, F.lit(False))
    rows = daily.where(F.col("n_crimes").isNotNull()).select(
        "res", "date", "i", "j", "n_crimes", "n_arrests", F.explode(blocks).alias("_block"),
    ).where(holds(F.col("_block") <= block(F.col("i") + pool_k))).repartition("res", "date", "_block")
    sent = rows.select("*", F.explode(F.array(*[F.lit(a) for a in reach])).alias("_a")).withColumn(
        "_line", F.col("i") - F.col("_a")).where(holds(block(F.col("_line")) == F.col("_block")))
    names = {"n_crimes": "pooled_n", "n_arrests": "pooled_k"}
    own = F.col("_a") == 0

    def told(name: str, d: int):
        """What a place tells the one ``d`` before it: the lines whose run reaches that far."""
        near = F.col("_a").between(max(-pool_k, d - pool_k), min(pool_k, d + pool_k))
        return F.coalesce(F.sum(F.when(near, F.col(name))), F.lit(0)).alias(f"_{name}_{d}")

    # The same cell-day in several rows counts in each sum and gives one row.
    places = sent.groupBy("res", "date", "_block", "_line", "j").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in names],
        *[told(c, d) for c in names for d in reach])
    line = W.partitionBy("res", "date", "_block", "_line").orderBy("j")

    def heard(name: str, d: int, rows: int):
        there, said = F.lead("j", rows).over(line), F.lead(f"_{name}_{d}", rows).over(line)
        return F.coalesce(F.when(there == F.col("j") + d, said), F.lit(0))

    # Places differ by 1 at least, so one that lies ``d`` away is at most ``d`` rows away.
    steps = [(sign * d, sign * m) for sign in (-1, 1) for d in range(1, pool_k + 1) for m in range(1, d + 1)]
    return places.select(
        "res", F.col("_line").alias("i"), "j", "date", *names,
        *[reduce(add, [F.col(f"_{c}_0"), *[heard(c, *step) for step in steps]]).alias(out)
          for c, out in names.items()],
    ).where(F.col("n_crimes").isNotNull() & F.col("j").isNotNull())


def with_pooled_rates(df: DataFrame, alpha: float = K.PRIOR_WEIGHT) -> DataFrame:
    n, k, prior = F.col("pooled_n"), F.col("pooled_k"), F.col("prior")
    return df.select(
        "*",
        F.coalesce(R.safe_rate(k, n), prior).alias("pooled_rate"),
        F.when(n > 0, R.smoothed(k, n, prior, alpha)).otherwise(F.col("smoothed_rate"))
        .alias("pooled_smoothed"),
    )


def monthly_counts(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum daily counts over calendar months: ``month_start`` and the counts."""
    return (
        daily.groupBy(*keys, F.trunc("date", "month").alias("month_start"))
        .agg(F.sum("n_crimes").alias("n_crimes"), F.sum("n_arrests").alias("n_arrests"))
    )


def daily_profile(silver: DataFrame, res: int = 9) -> DataFrame:
    """(cell, date) -> incidents with an id, arrests, distinct streets, top type, arrest rate.

    Each incident contributes to two tallies, one per street and one per type. Both are summed
    per distinct value before any cell-day is assembled.
    """
    cell = F.col(f"h3_r{res}")
    street = S.column_or(silver, K.STREET_NAMES, F.lit(None).cast("string"))
    offense = S.column_or(silver, K.TYPE_NAMES, F.lit(None).cast("string"))
    tallies = F.array(
        F.struct(F.lit("street").alias("kind"), street.cast("string").alias("value"),
                 F.lit(0).alias("counted"), F.lit(0).alias("arrested")),
        F.struct(F.lit("type").alias("kind"), offense.cast("string").alias("value"),
                 F.when(S.id_column(silver).isNotNull(), 1).otherwise(0).alias("counted"),
                 _flag(silver).cast("int").alias("arrested")),
    )
    values = (
        silver.where(cell.isNotNull())
        .select(cell.alias("cell"), "date", F.inline(tallies))
        .groupBy("cell", "date", "kind", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("counted").alias("counted"),
            F.sum("arrested").alias("arrested"),
        )
    )
    known = F.col("value").isNotNull()
    best = F.min(
        F.when((F.col("kind") == "type") & known, F.struct((-F.col("n")).alias("r"), "value"))
    )
    return (
        values.groupBy("cell", "date")
        .agg(
            F.sum("counted").alias("n_crimes"),
            F.sum("arrested").alias("n_arrests"),
            F.count_if((F.col("kind") == "street") & known).alias("unique_streets"),
            best.getField("value").alias("top_crime_type"),
        )
        .withColumn("arrest_rate", R.safe_rate(F.col("n_arrests"), F.col("n_crimes")))
    )


def with_rolling(daily: DataFrame, windows: Sequence[int] = tuple(K.ROLLING_DAYS),
                 across_months: bool = False) -> DataFrame:
    """Sums over the last w calendar days of a cell, restarting each month by default.

    A window partition is one cell and month: at most 31 rows (all days of a cell otherwise).
    """
    keys = ["cell"] if across_months else ["cell", F.year("date"), F.month("date")]
    per_cell = W.partitionBy(*keys).orderBy(F.unix_date("date"))
    return daily.select(
        "*",
        *[
            F.sum("n_crimes").over(per_cell.rangeBetween(-(w - 1), 0)).alias(f"rolling_n_{w}")
            for w in windows
        ],
    )


def dense_days(daily: DataFrame, cell: str = "cell") -> DataFrame:
    """Every day between a cell's first and last in each month, missing days as 0 incidents."""
    keyed = with_month_keys(daily)
    spans = keyed.groupBy(cell, "year", "month").agg(
        F.min("date").alias("a"), F.max("date").alias("b")
    )
    days = spans.select(cell, F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily.select(cell, "date", "n_crimes"), [cell, "date"], "left").fillna(
        0, subset=["n_crimes"]
    )


def with_parents(cells: DataFrame, *kept: str, levels: Sequence[int] = tuple(K.RESOLUTIONS)) -> DataFrame:
    """(kept, child_res, parent_res, parent, child) of each cell (res, i, j) below the first level: a
    parent follows from its child, so no row moves."""
    ups = {r: L.cell_id(r - 1, *L.parent(F.col("i"), F.col("j"), r)) for r in levels[1:]}
    of_level = lambda columns: F.coalesce(*[F.when(F.col("res") == r, c) for r, c in columns.items()])
    res = F.col("res").cast("int")
    return cells.where(F.col("res").isin(*ups)).select(
        *kept, res.alias("child_res"), (res - 1).alias("parent_res"), of_level(ups).alias("parent"),
        L.cell_id(res, F.col("i"), F.col("j")).alias("child"))


def drill_map(daily: DataFrame, levels: Sequence[int] = tuple(K.RESOLUTIONS)) -> DataFrame:
    """Parent and child ids of each observed cell, for neighbouring levels."""
    return with_parents(daily.select("res", "i", "j").distinct(), levels=levels)


def children_of(mapping: DataFrame, parents) -> DataFrame:
    """Children of one parent id, or of every parent in a frame with a ``parent`` column."""
    if isinstance(parents, str):
        return mapping.where(F.col("parent") == parents).select("parent", "child")
    return mapping.join(parents.select("parent").distinct(), "parent", "left_semi").select(
        "parent", "child"
    )


def distinct_cells(silver: DataFrame) -> DataFrame:
    """Exact number of cells per level, from the distinct finest cells."""
    finest = silver.where(F.col(FINEST).isNotNull()).select(FINEST).distinct().select(
        L.id_part(F.col(FINEST), 2).alias("_i"), L.id_part(F.col(FINEST), 3).alias("_j")
    )
    per_level = F.array(
        *[
            F.struct(F.lit(r).alias("res"), F.col(f"i{r}").alias("i"), F.col(f"j{r}").alias("j"))
            for r in K.RESOLUTIONS
        ]
    )
    return (
        L.with_levels(finest).select(F.inline(per_level)).distinct()
        .groupBy("res").agg(F.count(F.lit(1)).alias("cells"))
    )
