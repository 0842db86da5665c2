"""Cell tables: daily with rates and pooling, monthly, rolling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L, rates as R
from hexlytics.operators import cells as C

KEYS = ("res", "year", "month")


def gold_daily(silver: DataFrame, levels: Sequence[int] = tuple(K.RESOLUTIONS),
               alpha: float = K.PRIOR_WEIGHT, pool_k: int = 1) -> DataFrame:
    """All levels and months at once: counts, smoothed rate, interval, ring-pooled rate."""
    daily = C.daily_levels(silver, levels)
    priors = C.month_priors(C.with_month_keys(daily))
    pooled = C.with_month_keys(C.pooled_counts(daily, pool_k))
    rated = C.with_pooled_rates(C.with_rates(C.with_prior(pooled, priors), alpha), alpha)
    return rated.select(
        *KEYS, L.cell_id(F.col("res"), F.col("i"), F.col("j")).alias("cell"), "date",
        "n_crimes", "n_arrests", "raw_rate", "low_conf", "smoothed_rate", "ci_low", "ci_high",
        "pooled_n", "pooled_k", "pooled_rate", "pooled_smoothed",
    )


def gold_monthly(daily: DataFrame, alpha: float = K.PRIOR_WEIGHT) -> DataFrame:
    """Counts and rates per cell and month from the daily table, smoothed with the month's prior."""
    monthly = daily.groupBy(*KEYS, "cell").agg(
        F.sum("n_crimes").alias("n_crimes"), F.sum("n_arrests").alias("n_arrests"))
    n, k = F.col("n_crimes"), F.col("n_arrests")
    return C.with_prior(monthly, C.month_priors(daily)).select(
        *KEYS, "cell", "n_crimes", "n_arrests", R.raw_rate(k, n).alias("raw_rate"),
        R.smoothed(k, n, F.col("prior"), alpha).alias("smoothed_rate"),
    )


def gold_rolling(silver: DataFrame, res: int = 9, across_months: bool = False) -> DataFrame:
    """Daily profile of one level with 7, 14 and 30-day sums."""
    rolled = C.with_rolling(C.daily_profile(silver, res), across_months=across_months)
    return C.with_month_keys(rolled).withColumn("res", F.lit(res))


def rolled_across(rolling: DataFrame) -> DataFrame:
    """``gold_rolling`` with sums over month ends, from the table with sums inside months: its rows
    are the daily profile already."""
    sums = [f"rolling_n_{w}" for w in K.ROLLING_DAYS]
    return C.with_month_keys(C.with_rolling(rolling.drop(*sums, "year", "month"), across_months=True))
