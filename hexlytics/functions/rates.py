"""Rate columns over (n incidents, k arrests)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hexlytics import constants as K


def safe_rate(k: Column, n: Column) -> Column:
    """k / n, null when n is 0."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def raw_rate(k: Column, n: Column) -> Column:
    return F.coalesce(safe_rate(k, n), F.lit(0.0))


def smoothed(k: Column, n: Column, prior: Column, alpha: float = K.PRIOR_WEIGHT) -> Column:
    """Rate pulled toward the prior by ``alpha`` pseudo-incidents."""
    return F.when(n > 0, (F.lit(alpha) * prior + k) / (F.lit(alpha) + n)).otherwise(prior)


def wilson(k: Column, n: Column, z: float = K.WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval, kept within [0, 1]; (0, 0) without incidents."""
    size = n.cast("double")
    p = F.try_divide(k.cast("double"), size)
    z2 = z * z
    scale = F.lit(1.0) + F.try_divide(F.lit(z2), size)
    middle = p + F.try_divide(F.lit(z2), size * 2.0)
    reach = F.lit(z) * F.sqrt(
        F.try_divide(p * (1.0 - p), size) + F.try_divide(F.lit(z2), size * size * 4.0)
    )
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle - reach) / scale))
    high = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle + reach) / scale))
    some = n > 0
    return F.when(some, low).otherwise(0.0), F.when(some, high).otherwise(0.0)
