"""Tail probabilities for result rows (one row per test), as Arrow-batched pandas UDFs; normal
quantiles and harmonic numbers, which are needed for all rows, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


_MOST_TERMS = 1_000_000
_LARGE = 1e5  # from here on a beta tail is a gamma tail to twelve digits


def _fraction(numerators, first: float, c: float) -> float:
    """Continued fraction (modified Lentz) from its first denominator and the ratio before it;
    an unfinished one is an error, not a value."""
    tiny = 1e-300
    d = 1.0 / (first if abs(first) > tiny else tiny)
    value = d
    for numerator, denominator in numerators:
        d = denominator + numerator * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = denominator + numerator / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"continued fraction still changes after {_MOST_TERMS} terms")


def _beta_terms(a: float, b: float, x: float):
    for m in range(1, _MOST_TERMS):
        yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0


def _log_gamma_rise(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a), without cancellation where a is large."""
    if a < 100.0:
        return math.lgamma(a + b) - math.lgamma(a)

    def correction(z: float) -> float:  # of Stirling's formula
        return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3) + 1.0 / (1260.0 * z**5)

    return ((a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
            + correction(a + b) - correction(a))


def gamma_upper(b: float, y: float) -> float:
    """Regularised Q(b, y)."""
    if y <= 0.0:
        return 1.0
    front = math.exp(b * math.log(y) - y - math.lgamma(b))
    if y >= b + 1.0:
        terms = ((-k * (k - b), y - b + 2.0 * k + 1.0) for k in range(1, _MOST_TERMS))
        return front * _fraction(terms, y - b + 1.0, math.inf)
    term = total = 1.0 / b
    for k in range(1, _MOST_TERMS):
        term *= y / (b + k)
        total += term
        if term < total * 1e-17:
            return 1.0 - front * total
    raise ArithmeticError(f"series still changes after {_MOST_TERMS} terms")


def incomplete_beta(a: float, b: float, x: float, y: float) -> float:
    """Regularised I_x(a, b); ``y`` is 1 - x, given apart because it may be tiny."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    if a >= _LARGE and a >= 1000.0 * b:
        return gamma_upper(b, -(a + (b - 1.0) / 2.0) * log_x)
    if b >= _LARGE and b >= 1000.0 * a:
        return 1.0 - incomplete_beta(b, a, y, x)
    if x >= (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_lower(b, a, y, x)
    return _beta_lower(a, b, x, y)


def _beta_lower(a: float, b: float, x: float, y: float) -> float:
    large, small = max(a, b), min(a, b)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(
        _log_gamma_rise(large, small) - math.lgamma(small) + a * log_x + b * log_y)
    return front * _fraction(_beta_terms(a, b, x), 1.0 - (a + b) * x / (a + 1.0), 1.0) / a


def student_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def fisher_upper(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    total = d2 + d1 * f
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / total, d1 * f / total)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


EXACT_TABLE = 2_000_000  # entries of the largest exact table that is built


def rank_sum_upper(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties: coefficients of the Gaussian binomial, in whole numbers."""
    small, large = sorted((int(n1), int(n2)))
    size = small * large + 1
    if size > EXACT_TABLE:
        raise ValueError(f"exact U needs {size} entries, more than {EXACT_TABLE}")
    ways = np.zeros(size, dtype=object)
    ways[0] = 1
    for part in range(1, small + 1):
        shift = large + part
        if shift < size:
            ways[shift:] = ways[shift:] - ways[:-shift].copy()
        for start in range(min(part, size)):
            ways[start::part] = np.cumsum(ways[start::part])
    upper = sum(ways[int(math.ceil(u)):].tolist())
    return upper / math.comb(small + large, small)


def inversions_two_sided(discordant: int, n: int) -> float:
    """Two-sided chance of a discordance count this far out, over all orders of n items."""
    top = n * (n - 1) // 2
    edge = min(discordant, top - discordant)
    if edge <= 1:
        # One order has no discordant pair, n - 1 orders have one.
        return min(1.0, math.exp(math.log(2.0) + edge * math.log(n) - math.lgamma(n + 1)))
    if n * (edge + 1) > EXACT_TABLE:
        raise ValueError(f"exact tau needs {n * (edge + 1)} entries, more than {EXACT_TABLE}")
    ways = [1]
    for item in range(2, n + 1):
        grown, window = [], 0
        for k in range(min(edge, item * (item - 1) // 2) + 1):
            window += ways[k] if k < len(ways) else 0
            window -= ways[k - item] if k >= item else 0
            grown.append(window)
        ways = grown
    return min(1.0, 2 * sum(ways[:edge + 1]) / math.factorial(n))


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    out = []
    for values in zip(*columns):
        missing = any(v is None or v != v for v in values)
        out.append(None if missing else float(fn(*values)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(student_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(fisher_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return _rowwise(lambda v: min(1.0, 2.0 * normal_upper(abs(v))), z)


@F.pandas_udf(T.DoubleType())
def upper_normal(z: pd.Series) -> pd.Series:
    return _rowwise(normal_upper, z)


@F.pandas_udf(T.DoubleType())
def rank_sum_p_value(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _rowwise(lambda a, b, c: min(1.0, 2.0 * rank_sum_upper(a, b, c)), u, n1, n2)


@F.pandas_udf(T.DoubleType())
def inversions_p_value(discordant: pd.Series, n: pd.Series) -> pd.Series:
    return _rowwise(lambda d, m: inversions_two_sided(int(d), int(m)), discordant, n)


# --- fixed values: coefficients of the normal quantile (Wichura, algorithm AS 241) ------------
CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
NEAR_TAIL = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
FAR_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's scheme, lowest power first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def with_normal_quantile(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the normal quantile of ``p``, 0 < p < 1, by column arithmetic only."""
    q, r = F.col("_q"), F.col("_r")

    def ratio(x: Column, parts) -> Column:
        return polynomial(x, parts[0]) / polynomial(x, parts[1])

    tail = F.when(r <= 5.0, ratio(r - 1.6, NEAR_TAIL)).otherwise(ratio(r - 5.0, FAR_TAIL))
    value = F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, CENTRE)).otherwise(
        F.signum(q) * tail)
    return (
        df.withColumn("_p", p).withColumn("_q", F.col("_p") - 0.5)
        .withColumn("_r", F.sqrt(-F.log(F.least("_p", 1.0 - F.col("_p")))))
        .withColumn(out, value).drop("_p", "_q", "_r")
    )


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n for a whole number n >= 1, in closed form."""
    z = n + 10.0
    far = (F.log(z) + 0.57721566490153286 + 1.0 / (2.0 * z) - 1.0 / (12.0 * z * z)
           + 1.0 / (120.0 * z * z * z * z) - 1.0 / (252.0 * z * z * z * z * z * z))
    for k in range(1, 11):
        far = far - 1.0 / (n + float(k))
    return far
