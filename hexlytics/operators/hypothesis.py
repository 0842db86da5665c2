"""Hypothesis tests from distributed moments and ranks.

Samples come in long form, one row per observation: (sample, value). A test returns one row per
result. Python is used only for the tail probability of those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions import distributions as D
from hexlytics.functions.rates import safe_rate
from hexlytics.operators.closedtest import hommel
from hexlytics.operators.concordance import signed_pairs
from hexlytics.operators.onerow import beside
from hexlytics.operators.ordered import (
    ranked, running_max, running_min_from_top, running_sum, sliced, value_counts, value_ranks,
)
from hexlytics.session import checkpointed


def samples(df: DataFrame, group: str, value: str, groups: Sequence, dropna: bool = True
            ) -> DataFrame:
    """Long samples of the listed groups."""
    out = df.where(F.col(group).isin(list(groups))).select(
        F.col(group).alias("sample"), F.col(value).cast("double").alias("value")
    )
    return out.where(F.col("value").isNotNull() & ~F.isnan("value")) if dropna else out


def _present(data: DataFrame) -> DataFrame:
    return data.where(F.col("value").isNotNull() & ~F.isnan("value"))


# ------------------------------------------------------------------------------- normality

def _moments(data: DataFrame) -> DataFrame:
    """(sample, rows, n, mean, skew, kurt): one row per sample, one scan."""
    valid = F.when(~F.isnan("value"), F.col("value"))
    return data.groupBy("sample").agg(
        F.count(valid).alias("n"), F.avg(valid).alias("mean"),
        F.skewness(valid).alias("skew"), F.kurtosis(valid).alias("kurt"),
    )


def _k_squared(moments: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    b1, b2 = F.col("skew"), F.col("kurt") + 3.0
    beta = (
        3.0 * (n * n + 27.0 * n - 70.0) * (n + 1.0) * (n + 3.0)
        / ((n - 2.0) * (n + 5.0) * (n + 7.0) * (n + 9.0))
    )
    w2 = F.sqrt(2.0 * (beta - 1.0)) - 1.0
    y = b1 * F.sqrt((n + 1.0) * (n + 3.0) / (6.0 * (n - 2.0)))
    scaled = F.when(y == 0.0, 1.0).otherwise(y) / F.sqrt(2.0 / (w2 - 1.0))
    z_skew = F.log(scaled + F.sqrt(scaled * scaled + 1.0)) / F.sqrt(0.5 * F.log(w2))

    spread = 24.0 * n * (n - 2.0) * (n - 3.0) / (
        (n + 1.0) * (n + 1.0) * (n + 3.0) * (n + 5.0)
    )
    x = (b2 - 3.0 * (n - 1.0) / (n + 1.0)) / F.sqrt(spread)
    third = (
        6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7.0) * (n + 9.0))
        * F.sqrt(6.0 * (n + 3.0) * (n + 5.0) / (n * (n - 2.0) * (n - 3.0)))
    )
    a = 6.0 + 8.0 / third * (2.0 / third + F.sqrt(1.0 + 4.0 / (third * third)))
    base = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    root = F.signum(base) * F.cbrt((1.0 - 2.0 / a) / F.abs(base))
    z_kurt = (1.0 - 2.0 / (9.0 * a) - root) / F.sqrt(2.0 / (9.0 * a))

    return (
        moments.where(F.col("n") > 0)
        .select("sample", "n", F.when(n > 7, z_skew).alias("zs"), F.when(n > 7, z_kurt).alias("zk"))
        .select("sample", "n", (F.col("zs") ** 2 + F.col("zk") ** 2).alias("statistic"))
        .select(
            "sample", F.lit("dagostino").alias("method"), "n", "statistic",
            F.exp(-F.col("statistic") / 2.0).alias("p_value"),
        )
    )


def dagostino(data: DataFrame) -> DataFrame:
    """K-squared from skewness and kurtosis, per sample."""
    return _k_squared(_moments(data))


# --- fixed values: polynomial coefficients of Royston's algorithm AS R94 -----------------------
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_SCALE = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SCALE = [-0.4803, -0.082676, 0.0030302]


_RUN = 4096  # ranks of one value that are handled at once


def shapiro(data: DataFrame) -> DataFrame:
    """W per sample. Expected order scores are joined to values by rank, so a sample of any
    size is spread over many tasks. Runs a job when called (ranks)."""
    sizes = _moments(data).where(F.col("n") > 0).select("sample", F.col("n").alias("size"), "mean")
    return _w(_present(data), sizes)


def _w(data: DataFrame, sizes: DataFrame) -> DataFrame:
    """W of the samples in ``sizes`` (sample, size, mean)."""
    counts = value_counts(data.join(sizes.select("sample"), "sample", "left_semi"),
                          ["sample"], "value")
    placed = ranked(counts, ["sample"], "value").join(sizes, "sample")
    # The ranks of a value, in runs of bounded length.
    first, last = F.col("before") + 1, F.col("before") + F.col("n")
    runs = placed.withColumn("_from", F.explode(F.sequence(first, last, F.lit(_RUN).cast("long"))))
    numbered = runs.withColumn("rank", F.explode(F.sequence(
        "_from", F.least(F.col("_from") + (_RUN - 1), last))))
    scored = D.with_normal_quantile(
        numbered, (F.col("rank") - 0.375) / (F.col("size") + 0.25), "m")
    from_top = F.col("size") - F.col("rank")
    inner = (F.col("rank") > 2) & (from_top >= 2)

    def outer(column: str, rank_condition: Column) -> Column:
        return F.max(F.when(rank_condition, F.col(column)))

    sums = scored.groupBy("sample").agg(
        F.first("size").alias("n"),
        F.sum(F.col("m") ** 2).alias("mm"),
        F.sum((F.col("value") - F.col("mean")) ** 2).alias("ss"),
        F.coalesce(F.sum(F.when(inner, F.col("m") * (F.col("value") - F.col("mean")))), F.lit(0.0))
        .alias("mx"),
        outer("m", from_top == 0).alias("m_last"),
        outer("m", from_top == 1).alias("m_next"),
        (outer("value", from_top == 0) - outer("value", F.col("rank") == 1)).alias("x_last"),
        (outer("value", from_top == 1) - outer("value", F.col("rank") == 2)).alias("x_next"),
    )
    n = F.col("n").cast("double")
    rsn = 1.0 / F.sqrt(n)
    last = F.when(n == 3, F.lit(0.5**0.5)).otherwise(
        F.col("m_last") / F.sqrt("mm") + D.polynomial(rsn, LAST_WEIGHT)
    )
    second = F.when(
        n > 5, F.col("m_next") / F.sqrt("mm") + D.polynomial(rsn, NEXT_WEIGHT)
    )
    a1, a2 = F.col("a_last"), F.col("a_next")
    phi = F.when(
        n > 5,
        (F.col("mm") - 2 * F.col("m_last") ** 2 - 2 * F.col("m_next") ** 2)
        / (1.0 - 2 * a1**2 - 2 * a2**2),
    ).otherwise(F.try_divide(F.col("mm") - 2 * F.col("m_last") ** 2, 1.0 - 2 * a1**2))
    next_weight = F.when(n > 5, a2).when(n > 3, F.col("m_next") / F.sqrt("phi")).otherwise(0.0)
    middle = F.when(n > 3, F.col("mx") / F.sqrt("phi")).otherwise(0.0)
    w = (a1 * F.col("x_last") + next_weight * F.col("x_next") + middle) ** 2 / F.col("ss")

    stat = F.col("statistic")
    y = F.log(1.0 - stat)
    gamma = D.polynomial(n, SMALL_GAMMA)
    log_n = F.log(n)
    z_small = (-F.log(gamma - y) - D.polynomial(n, SMALL_MEAN)) / F.exp(D.polynomial(n, SMALL_SCALE))
    z_large = (y - D.polynomial(log_n, LARGE_MEAN)) / F.exp(D.polynomial(log_n, LARGE_SCALE))
    p_three = F.greatest(
        F.lit(0.0), 6.0 / F.pi() * (F.asin(F.sqrt(stat)) - F.asin(F.sqrt(F.lit(0.75))))
    )
    return (
        sums.withColumn("a_last", last).withColumn("a_next", second)
        .withColumn("phi", phi)
        .withColumn("statistic", F.when(F.col("ss") > 0, F.least(F.lit(1.0), w)).otherwise(1.0))
        .withColumn("z", F.when(n <= 11, F.when(y < gamma, z_small)).otherwise(z_large))
        .select(
            "sample", F.lit("shapiro").alias("method"), "n", "statistic",
            F.when(F.col("ss") == 0, 1.0)
            .when(n == 3, p_three)
            .when((n <= 11) & (y >= gamma), 1e-99)
            .otherwise(D.upper_normal("z")).alias("p_value"),
        )
    )


def normality(data: DataFrame, method: str = "auto", limit: int = K.SHAPIRO_LIMIT) -> DataFrame:
    """Per sample: Shapiro-Wilk up to ``limit`` values, else D'Agostino-Pearson; or the one named.

    ``method`` in the result tells which one was used. A sample without a single value fails the
    query. Unless D'Agostino-Pearson is asked for, jobs run when called: one scan for sizes and
    moments, one for the values of the samples that are ranked.
    """
    if method not in ("auto", "shapiro", "dagostino"):
        raise ValueError(f"Unsupported method: {method}")
    moments = _moments(data)
    if method == "dagostino":
        result = _k_squared(moments)
    else:
        moments = checkpointed(moments)
        chosen = F.col("n") > 0 if method == "shapiro" else F.col("n").between(1, limit)
        result = _w(_present(data), moments.where(chosen).select(
            "sample", F.col("n").alias("size"), "mean"))
        if method == "auto":
            result = result.unionByName(_k_squared(moments.where(F.col("n") > limit)))
    none = F.raise_error(F.lit("Sample has no non-null values for normality test."))
    return moments.select("sample", F.col("n").alias("_n")).join(
        result.drop("n"), "sample", "left"
    ).select(
        "sample", "method",
        F.when(F.col("_n") > 0, F.col("_n")).otherwise(none.cast("bigint")).alias("n"),
        "statistic", "p_value",
    )


# ------------------------------------------------------------------------- variance, means

def levene(data: DataFrame, center: str = "median", trim: float = 0.05) -> DataFrame:
    """Equality of variances over all samples present (two in the usual call). Runs jobs when
    called (ranks, and the means of the samples)."""
    if center == "mean":
        counted = (
            _present(data).groupBy("sample", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        kept = counted
    elif center in ("median", "trimmed"):
        counted = value_ranks(_present(data), ["sample"], "value")
        totals = counted.groupBy("sample").agg(F.sum("n").alias("size"))
        kept = counted.join(totals, "sample")
        if center == "trimmed":
            cut = F.floor(F.col("size") * F.lit(trim))
            first = F.greatest(F.col("before"), cut)
            last = F.least(F.col("before") + F.col("n"), F.col("size") - cut)
            kept = kept.withColumn("n", last - first).where(F.col("n") > 0)
    else:
        raise ValueError(f"Unsupported center: {center}")

    if center == "median":
        low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
        through = F.col("before") + F.col("n")

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("before") < rank) & (rank <= through), F.col("value")))

        centres = kept.groupBy("sample").agg(((at(low) + at(high)) / 2.0).alias("centre"))
    else:
        centres = kept.groupBy("sample").agg(
            (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("centre")
        )
    # Centres and means have one row per sample; all values are read twice, never joined to
    # each other.
    away = kept.join(centres, "sample").select(
        "sample", "n", F.abs(F.col("value") - F.col("centre")).alias("z")
    )
    means = checkpointed(away.groupBy("sample").agg(
        F.sum("n").alias("ni"), (F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("zi")
    ))
    within = away.join(means, "sample").agg(
        F.sum(F.col("n") * (F.col("z") - F.col("zi")) ** 2).alias("w"))
    grand = means.agg((F.sum(F.col("ni") * F.col("zi")) / F.sum("ni")).alias("g")).scalar()
    between = means.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("ni").cast("double").alias("total"),
        F.sum(F.col("ni") * (F.col("zi") - grand) ** 2).alias("b"),
    )
    k, total = F.col("k"), F.col("total")
    return (
        beside(between, within)
        .select(
            F.lit(center).alias("center"),
            F.try_divide((total - k) * F.col("b"), (k - 1) * F.col("w")).alias("statistic"),
            (k - 1).alias("df1"), (total - k).alias("df2"),
        )
        .withColumn("p_value", D.f_p_value("statistic", "df1", "df2"))
    )


def _two_moments(data: DataFrame, first, second) -> DataFrame:
    """One row with n, mean and sample variance of both samples; one pass, no shuffle of rows."""
    aggs = []
    for tag, name in (("1", first), ("2", second)):
        value = F.when(F.col("sample") == F.lit(name), F.col("value"))
        aggs += [
            F.count(value).cast("double").alias(f"n{tag}"),
            F.avg(value).alias(f"m{tag}"),
            F.var_samp(value).alias(f"v{tag}"),
        ]
    return _present(data).agg(*aggs)


def _d() -> Column:
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2.0)
    gap = F.col("m1") - F.col("m2")
    return F.when(pooled != 0, gap / pooled).otherwise(F.lit(float("nan")))


def cohens_d(data: DataFrame, first, second) -> DataFrame:
    return _two_moments(data, first, second).select(_d().alias("effect_size_d"))


def welch(data: DataFrame, first, second) -> DataFrame:
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    spread = e1 + e2
    return (
        _two_moments(data, first, second)
        .select(
            F.lit("Welch t-test").alias("test"),
            F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(spread)).alias("t_stat"),
            F.try_divide(
                spread * spread,
                e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1),
            ).alias("df"),
            _d().alias("effect_size_d"),
        )
        .select("test", "t_stat", "df", D.t_p_value("t_stat", "df").alias("p_value"),
                "effect_size_d")
    )


def two_proportions(df: DataFrame, success1: str, total1: str, success2: str, total2: str
                    ) -> DataFrame:
    """Pooled z, difference and unpooled 95% interval for each row of counts."""
    s1, n1, s2, n2 = (F.col(c).cast("double") for c in (success1, total1, success2, total2))
    p1, p2 = F.try_divide(s1, n1), F.try_divide(s2, n2)
    pooled = F.try_divide(s1 + s2, n1 + n2)
    diff = p1 - p2
    reach = F.lit(K.WILSON_Z) * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return (
        df.withColumn(
            "z_stat",
            F.try_divide(diff, F.sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2))),
        )
        .withColumn("diff", diff)
        .withColumn("ci_low", diff - reach)
        .withColumn("ci_high", diff + reach)
        .withColumn("p_value", D.z_p_value("z_stat"))
    )


# ----------------------------------------------------------------------------------- ranks

P_METHODS = ("auto", "exact", "asymptotic")


def _check_method(method: str) -> None:
    if method not in P_METHODS:
        raise ValueError(f"Unsupported method: {method}")


def mann_whitney(data: DataFrame, first, second, method: str = "auto") -> DataFrame:
    """U of the first sample, two-sided. Runs a job when called (ranks).

    ``exact`` counts all orders; it needs values without ties and n1 * n2 of at most
    ``distributions.EXACT_TABLE``, and fails beyond. ``asymptotic`` is the tie-corrected normal
    approximation with continuity correction. ``auto`` is exact when one sample has at most 8
    values, no value repeats and the table fits, else asymptotic.
    """
    _check_method(method)
    n_first = F.count(F.when(F.col("sample") == F.lit(first), 1))
    counts = (
        _present(data).where(F.col("sample").isin([first, second])).groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), n_first.alias("n_first"))
    )
    placed = running_sum(sliced(counts, [], "value"), [], "value", "n", "before")
    mid = F.col("before") + (F.col("n") + 1) / 2.0
    t = F.col("n").cast("double")
    n1, n2, u1 = F.col("n1"), F.col("n2"), F.col("u_stat")
    size = n1 + n2
    high = F.greatest(u1, n1 * n2 - u1)
    spread = F.sqrt(
        n1 * n2 / 12.0 * (size + 1.0 - F.try_divide(F.col("ties"), size * (size - 1.0)))
    )
    exact = {
        "auto": ((n1 <= 8) | (n2 <= 8)) & (F.col("ties") == 0) & (n1 * n2 < D.EXACT_TABLE),
        "exact": F.when(F.col("ties") == 0, True).otherwise(
            F.raise_error(F.lit("exact U needs values without ties")).cast("boolean")),
        "asymptotic": F.lit(False),
    }[method]
    return (
        placed.agg(
            F.sum("n_first").cast("double").alias("n1"),
            (F.sum("n") - F.sum("n_first")).cast("double").alias("n2"),
            F.sum(F.col("n_first") * mid).alias("r1"),
            F.sum(t * t * t - t).alias("ties"),
        )
        .withColumn("u_stat", F.col("r1") - n1 * (n1 + 1) / 2.0)
        .withColumn("u_high", high)
        .withColumn("z", F.try_divide(F.col("u_high") - n1 * n2 / 2.0 - 0.5, spread))
        .withColumn("p_exact", D.rank_sum_p_value(
            F.when(exact, F.col("u_high")), n1, n2))
        .select(
            F.lit("Mann-Whitney U").alias("test"), "u_stat",
            F.when(exact, F.col("p_exact"))
            .otherwise(F.least(F.lit(1.0), 2.0 * D.upper_normal("z"))).alias("p_value"),
        )
    )


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.select(a.alias("x"), b.alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )


def _with_t(df: DataFrame, name: str) -> DataFrame:
    """p-value of a correlation; NaN, as the correlation is, when a column is constant."""
    r, freedom = F.col("r"), F.col("n") - 2.0
    t = F.when(F.isnan(r) | (freedom <= 0.0), F.lit(None).cast("double")).when(
        F.abs(r) >= 1.0, F.lit(float("inf"))
    ).otherwise(r * F.sqrt(F.greatest(freedom, F.lit(0.0)) / ((1.0 - r) * (1.0 + r))))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    not_a_number = F.lit(float("nan"))
    df = df.withColumn(
        "r", F.when(F.col("r").isNull() | F.isnan("r"), not_a_number).otherwise(bounded))
    return df.withColumn("_t", t).withColumn("_df", freedom).select(
        F.lit(name).alias("test"), F.col("n").cast("bigint").alias("n"),
        r.alias("statistic"),
        # Two points lie on a line always.
        F.when(F.isnan(r), r).when(F.col("_df") <= 0.0, 1.0)
        .otherwise(D.t_p_value("_t", "_df")).alias("p_value"),
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    one = _complete(df, x, y).agg(
        F.covar_pop("x", "y").alias("xy"), F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"), F.count(F.lit(1)).cast("double").alias("n"),
    ).select("n", F.try_divide(F.col("xy"), F.col("sx") * F.col("sy")).alias("r"))
    return _with_t(one, "pearson_r")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation. Runs jobs when called: the distinct pairs are pinned, so that the
    values that ranks are joined by are evaluated once."""
    pairs = checkpointed(
        _complete(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight")))
    joined, size = pairs, None
    for axis in ("x", "y"):
        counts = pairs.groupBy(axis).agg(F.sum("weight").alias("n"))
        ranks = running_sum(sliced(counts, [], axis), [], axis, "n", "before")
        mid = (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"rank_{axis}")
        joined = joined.join(ranks.select(axis, mid), axis)
        size = ranks.agg(F.max(F.col("before") + F.col("n")).cast("double"))
    # Both rank columns have mean (size + 1) / 2; sums are taken about it.
    middle = (size.scalar() + 1.0) / 2.0
    centred = joined.select(
        F.col("weight").cast("double").alias("w"),
        (F.col("rank_x") - middle).alias("a"), (F.col("rank_y") - middle).alias("b"),
    )
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    one = centred.agg(
        F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"),
        F.sum(w * b * b).alias("bb"), F.sum(w).alias("n"),
    ).select("n", F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("r"))
    return _with_t(one, "spearman_rho")


def kendall(df: DataFrame, x: str, y: str, method: str = "auto") -> DataFrame:
    """Tau-b. The pair counts are found by an iterative job, so this call runs Spark jobs.

    ``exact`` counts all orders; it needs columns without ties and fails where its table exceeds
    ``distributions.EXACT_TABLE``. ``auto`` is exact without ties for at most 33 pairs, or where
    at most one pair is discordant (or concordant), else the normal approximation.
    """
    _check_method(method)
    pairs = checkpointed(
        _complete(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight")))
    signed = signed_pairs(pairs)

    def ties(axis: str) -> DataFrame:
        t = F.col("t").cast("double")
        return pairs.groupBy(axis).agg(F.sum("weight").alias("t")).agg(
            F.sum(t).alias(f"n_{axis}"),
            F.sum(t * (t - 1) / 2).alias(f"tie_{axis}"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"c_{axis}"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v_{axis}"),
            F.max("t").alias(f"top_{axis}"),
        )

    n = F.col("n_x")
    m = n * (n - 1)
    s = F.lit(float(signed))
    spread = (
        (m * (2 * n + 5) - F.col("v_x") - F.col("v_y")) / 18.0
        + F.try_divide(2 * F.col("tie_x") * F.col("tie_y"), m)
        + F.try_divide(F.col("c_x") * F.col("c_y"), 9.0 * m * (n - 2))
    )
    all_pairs = m / 2.0
    tau = F.try_divide(
        s, F.sqrt(all_pairs - F.col("tie_x")) * F.sqrt(all_pairs - F.col("tie_y"))
    )
    discordant = (all_pairs - s) / 2.0
    few = (n <= 33) | (F.least(discordant, all_pairs - discordant) <= 1)
    untied = (F.col("top_x") == 1) & (F.col("top_y") == 1)
    exact = {
        "auto": few & untied,
        "exact": F.when(untied, True).otherwise(
            F.raise_error(F.lit("exact tau needs columns without ties")).cast("boolean")),
        "asymptotic": F.lit(False),
    }[method]
    return (
        beside(ties("x"), ties("y"))
        .withColumn("statistic", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tau)))
        .withColumn("z", F.try_divide(s, F.sqrt(spread)))
        .withColumn("p_exact", D.inversions_p_value(F.when(exact, discordant), n))
        .select(
            F.lit("kendall_tau").alias("test"), n.cast("bigint").alias("n"), "statistic",
            F.when(exact, F.col("p_exact")).otherwise(D.z_p_value("z")).alias("p_value"),
        )
    )


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    return pearson(df, x, y).unionByName(spearman(df, x, y)).unionByName(kendall(df, x, y))


# ---------------------------------------------------------------------------- multiplicity

FDR_METHODS = (
    "bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by",
    "fdr_tsbh", "fdr_tsbky", "fdr_gbs", "hommel",
)


def adjust_p_values(df: DataFrame, p: str = "p_value", alpha: float = 0.05,
                    method: str = "fdr_bh") -> DataFrame:
    """Add ``q_value`` and ``rejected``. The family is the whole frame; ranks come from
    distinct p-values, so a family of any size is adjusted without one sorting task. Runs jobs
    when called (the frame is pinned and its p-values are ranked)."""
    if method not in FDR_METHODS:
        raise ValueError(f"Unsupported method: {method}")
    # Pinned: the values that q-values are joined by are evaluated once.
    df = checkpointed(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").cast("double").alias("m"))
    m = size.scalar()
    value = F.col(p)

    def any_of(tests: Column) -> Column:
        """Chance of a p-value this small in that many independent tests."""
        return F.when(value >= 1.0, 1.0).otherwise(-F.expm1(tests * F.log1p(-value)))

    if method == "bonferroni":
        table = counts.withColumn("_q", value * m)
    elif method == "sidak":
        table = counts.withColumn("_q", any_of(m))
    else:
        cut = running_sum(sliced(counts, [], p), [], p, "_n", "_before")
        first, last = F.col("_before") + 1, F.col("_before") + F.col("_n")
        # An own slice table for the running minimum or maximum, cut by the same checkpoint.
        if method == "holm":
            table = running_max(cut, p, value * (m - first + 1), "_q")
        elif method == "holm-sidak":
            table = running_max(cut, p, any_of(m - first + 1), "_q")
        elif method == "fdr_gbs":
            odds = F.when(value < 1.0, value / (1.0 - value)).otherwise(F.lit(float("inf")))
            table = running_max(cut, p, odds * (m - first + 1) / first, "_q")
        elif method == "hommel":
            table = cut.withColumn("_q", hommel(cut, p, last, int(size.first()["m"] or 0)))
        elif method == "simes-hochberg":
            table = running_min_from_top(cut, p, value * (m - last + 1), "_q")
        else:
            scale = m
            if method == "fdr_by":
                scale = m * size.select(D.harmonic(F.col("m"))).scalar()
            table = running_min_from_top(cut, p, value * scale / last, "_q")
    if method in ("fdr_tsbh", "fdr_tsbky"):
        # The first stage counts rejections; the second takes the rest as the true nulls.
        factor = 1.0 + alpha if method == "fdr_tsbky" else 1.0
        first_stage = table.agg(
            F.sum(F.when(F.col("_q") <= alpha / factor, F.col("_n")).otherwise(0)).cast("double")
        ).scalar()
        nulls = F.when((first_stage == 0) | (first_stage == m), m).otherwise(m - first_stage)
        table = table.withColumn(
            "_q", F.least(F.lit(1.0), F.col("_q")) * nulls / m * F.lit(factor)
        )
    q = F.least(F.lit(1.0), F.col("_q"))
    return df.join(table.select(p, q.alias("q_value")), p, "left").withColumn(
        "rejected", F.col("q_value") <= F.lit(alpha)
    )


# --------------------------------------------------------------------------------- reports

def report(result: DataFrame, question: str, null: str, alternative: str, test: str,
           statistic: str, p_value: str, effect_size: str | None = None,
           notes: str | None = None) -> DataFrame:
    """One common record per test."""
    effect = F.col(effect_size).cast("double") if effect_size else F.lit(None).cast("double")
    return result.select(
        F.lit(question).alias("question"), F.lit(null).alias("H0"),
        F.lit(alternative).alias("H1"), F.lit(test).alias("test"),
        F.col(statistic).cast("double").alias("statistic"),
        F.col(p_value).cast("double").alias("p_value"),
        effect.alias("effect_size"), F.lit(notes).cast("string").alias("notes"),
    )


def arrest_rate(df: DataFrame, arrests: str = "n_arrests", incidents: str = "n_crimes"
                ) -> DataFrame:
    """Add ``arrest_rate``, null where there are no incidents."""
    return df.withColumn("arrest_rate", safe_rate(F.col(arrests), F.col(incidents)))
