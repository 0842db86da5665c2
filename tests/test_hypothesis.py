"""Statistics against published values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hexlytics.functions import distributions as D
from hexlytics.operators import hypothesis as H
from hexlytics.operators import closedtest, concordance as C
from hexlytics.operators.concordance import signed_pairs
from hexlytics.operators.ordered import running_sum, sliced, value_ranks

# Weights of eleven men (Shapiro and Wilk, 1965).
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
# Pulse-wave style example with three groups of ten.
LEVENE_A = [8.88, 9.12, 9.04, 8.98, 9.00, 9.08, 9.01, 8.85, 9.06, 8.99]
LEVENE_B = [8.88, 8.95, 9.29, 9.44, 9.15, 9.58, 8.36, 9.18, 8.67, 9.05]
LEVENE_C = [8.95, 9.12, 8.95, 8.85, 9.03, 8.84, 9.07, 8.98, 8.86, 8.98]


def long(spark, **groups):
    rows = [(name, float(v) if v is not None else None) for name, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "sample string, value double")


def pairs(spark, xs, ys):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")


def test_tail_probabilities():
    assert D.student_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.student_two_sided(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert D.fisher_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.normal_upper(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert D.student_two_sided(math.inf, 5) == 0.0


def test_shapiro_published_value(spark):
    r = H.normality(long(spark, men=WEIGHTS), "shapiro").first()
    assert r["statistic"] == pytest.approx(0.7888147, abs=2e-6)
    assert r["p_value"] == pytest.approx(0.0067038, abs=2e-5)


def test_shapiro_small_and_constant_samples(spark):
    got = {r["sample"]: r for r in H.shapiro(long(
        spark, three=[1, 2, 4], four=[1, 2, 3, 9], same=[5, 5, 5, 5])).collect()}
    # For three values W follows from the spacing alone.
    assert got["three"]["statistic"] == pytest.approx(0.9642857, abs=1e-6)
    assert got["three"]["p_value"] == pytest.approx(0.6368868, abs=1e-6)
    assert 0 < got["four"]["p_value"] < 1
    assert (got["same"]["statistic"], got["same"]["p_value"]) == (1.0, 1.0)


def test_dagostino_published_value(spark):
    r = H.normality(long(spark, men=WEIGHTS), "dagostino").first()
    assert r["statistic"] == pytest.approx(13.034263121192582, abs=1e-9)
    assert r["p_value"] == pytest.approx(math.exp(-r["statistic"] / 2))


def test_normality_chooses_by_size_and_rejects_empty_samples(spark):
    rng = random.Random(1)
    data = long(spark, big=[rng.gauss(0, 1) for _ in range(5001)], small=WEIGHTS)
    got = {r["sample"]: r["method"] for r in H.normality(data).collect()}
    assert got == {"big": "dagostino", "small": "shapiro"}
    with pytest.raises(PySparkException, match="no non-null values"):
        H.normality(long(spark, none=[None, None])).collect()
    with pytest.raises(ValueError):
        H.normality(data, "other")


def test_levene_published_value(spark):
    data = long(spark, a=LEVENE_A, b=LEVENE_B, c=LEVENE_C)
    r = H.levene(data).first()
    assert r["p_value"] == pytest.approx(0.002431505967249681, rel=1e-6)
    assert (r["df1"], r["df2"]) == (2.0, 27.0)


@pytest.mark.parametrize("center", ["median", "mean", "trimmed"])
def test_levene_against_brute_force(spark, center):
    rng = random.Random(5)
    groups = {"a": [rng.randrange(20) for _ in range(41)], "b": [rng.randrange(35) for _ in range(60)]}

    def centred(vs):
        vs = sorted(vs)
        if center == "trimmed":
            cut = int(0.05 * len(vs))
            vs = vs[cut:len(vs) - cut]
        mid = (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2 if center == "median" else sum(vs) / len(vs)
        return [abs(v - mid) for v in vs]

    z = {g: centred(vs) for g, vs in groups.items()}
    n = sum(map(len, z.values()))
    overall = sum(map(sum, z.values())) / n
    means = {g: sum(v) / len(v) for g, v in z.items()}
    between = sum(len(v) * (means[g] - overall) ** 2 for g, v in z.items())
    within = sum((x - means[g]) ** 2 for g, v in z.items() for x in v)
    got = H.levene(long(spark, **groups), center).first()["statistic"]
    assert got == pytest.approx((n - 2) * between / within)


def test_two_sample_moments(spark):
    a, b = [30.02, 29.99, 30.11, 29.97, 30.01, 29.99], [29.89, 29.93, 29.72, 29.98, 30.02, 29.98]
    # A worked textbook example of the unequal-variance test.
    r = H.welch(long(spark, a=[*a, None], b=b), "a", "b").first()
    assert r["t_stat"] == pytest.approx(1.959, abs=1e-3)
    assert r["df"] == pytest.approx(7.031, abs=1e-3)
    assert r["p_value"] == pytest.approx(0.09077, abs=1e-4)
    same = H.cohens_d(long(spark, a=[1, 1], b=[1, 1]), "a", "b").first()["effect_size_d"]
    assert math.isnan(same)


def test_mann_whitney_exact_and_asymptotic(spark):
    males, females = [19, 22, 16, 29, 24], [20, 11, 17, 12]
    r = H.mann_whitney(long(spark, m=males, f=females), "m", "f").first()
    assert (r["u_stat"], r["p_value"]) == (17.0, pytest.approx(1 / 9))
    tied = H.mann_whitney(long(spark, m=[1, 2, 2, 3], f=[2, 4, 5]), "m", "f").first()
    # U by pairs; ties count a half.
    assert tied["u_stat"] == sum((a > b) + 0.5 * (a == b) for a in (1, 2, 2, 3) for b in (2, 4, 5))


def test_rank_sum_distribution_by_enumeration():
    for n1, n2 in ((3, 4), (2, 6), (5, 3)):
        us = []
        for first in itertools.combinations(range(1, n1 + n2 + 1), n1):
            us.append(sum(first) - n1 * (n1 + 1) // 2)
        for u in range(n1 * n2 + 1):
            want = sum(x >= u for x in us) / len(us)
            assert D.rank_sum_upper(u, n1, n2) == pytest.approx(want)


def test_two_proportions(spark):
    df = spark.createDataFrame([(5, 83, 12, 99)], "a int, b int, c int, d int")
    r = H.two_proportions(df, "a", "b", "c", "d").first()
    assert r["p_value"] == pytest.approx(0.159, abs=5e-4)
    assert r["diff"] == pytest.approx(5 / 83 - 12 / 99)
    assert (r["ci_low"] + r["ci_high"]) / 2 == pytest.approx(r["diff"])


def test_correlations_published_values(spark):
    s = H.spearman(pairs(spark, [1, 2, 3, 4, 5], [5, 6, 7, 8, 7]), "x", "y").first()
    assert s["statistic"] == pytest.approx(0.82078268, abs=1e-8)
    assert s["p_value"] == pytest.approx(0.08858701, abs=1e-8)
    k = H.kendall(pairs(spark, [12, 2, 1, 12, 2], [1, 4, 7, 1, 0]), "x", "y").first()
    assert k["statistic"] == pytest.approx(-0.4714045, abs=1e-7)
    assert k["p_value"] == pytest.approx(0.2827454599, abs=1e-9)


def test_kendall_exact_p_value_by_enumeration(spark):
    xs, ys = [1, 2, 3, 4, 5], [2, 1, 4, 5, 3]
    inversions = [sum(p[a] > p[b] for a in range(5) for b in range(a + 1, 5))
                  for p in itertools.permutations(range(5))]
    mine = sum(ys[a] > ys[b] for a in range(5) for b in range(a + 1, 5))
    want = min(1.0, 2 * sum(i <= min(mine, 10 - mine) for i in inversions) / len(inversions))
    r = H.kendall(pairs(spark, xs, ys), "x", "y").first()
    assert r["p_value"] == pytest.approx(want)


def test_nulls_are_left_out_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 1.0), (3.0, 1.0), (4.0, 5.0),
                                (float("nan"), 1.0)], "x double, y double")
    assert H.pearson(df, "x", "y").first()["n"] == 3


def brute(rows):
    total = 0
    for (x1, y1, w1), (x2, y2, w2) in itertools.combinations(rows, 2):
        total += ((x1 < x2) - (x1 > x2)) * ((y1 < y2) - (y1 > y2)) * w1 * w2
    return total


@pytest.mark.parametrize("shape", ["even", "hot both", "two", "none"])
def test_concordance_by_bits(spark, shape):
    rng = random.Random(13)
    cells = {(rng.randrange(90), rng.randrange(90)) for _ in range(350)}
    if shape in ("hot x", "hot both"):
        cells |= {(45, y) for y in range(-150, 150)}
    if shape in ("hot y", "hot both"):
        cells |= {(x, 30) for x in range(-150, 150)}
    cells = {"two": {(1, 1), (2, 0)}, "none": set()}.get(shape, cells)
    rows = [(float(x), float(y), rng.randrange(1, 4)) for x, y in cells]
    df = spark.createDataFrame(rows, "x double, y double, weight long")
    assert signed_pairs(df) == brute(rows)


@pytest.mark.parametrize("shape", ["even", "hot both", "heavy"])
def test_concordance_of_a_reduced_table(spark, shape):
    rng = random.Random(29)
    cells = {(rng.randrange(40), rng.randrange(60)) for _ in range(500)}
    if shape == "hot both":
        cells |= {(20, y) for y in range(-60, 60)} | {(x, 30) for x in range(-60, 60)}
    most = 1 << 31 if shape == "heavy" else 4  # heavy: products beyond 64 bits
    rows = [(float(x), float(y), rng.randrange(1, most)) for x, y in cells]
    df = spark.createDataFrame(rows, "x double, y double, weight long")
    assert signed_pairs(df, 60) == brute(rows)


def test_a_large_concordance_multiplies_rows_inside_tasks_only(spark):
    rows = spark.range(1000).selectExpr("id as first", "999 - id as second", "1L as weight")
    within = C.within_parts(rows, "first", F.col("second"), 6, 4, "bigint")
    plan = within._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hash") == 1
    assert plan.index("Generate") < plan.index("Exchange hash")
    assert within.first()["s"] == -(15 * 64 * 63 + 40 * 39) // 2


def test_concordance_stays_in_the_jvm_and_its_tasks_are_slices(spark):
    df = spark.range(1000).selectExpr("double(id) as x", "double(id % 37) as y", "1L as weight")
    cut = C.halves(C.placed(df), 10)
    plan = C.placed(df)._jdf.queryExecution().executedPlan().toString() + cut._jdf.queryExecution(
        ).executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_running_sums_and_ranks_per_group(spark):
    rng = random.Random(17)
    rows = [(rng.choice("ab"), float(rng.randrange(30))) for _ in range(400)]
    ranked = value_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    for r in ranked:
        mine = [v for g, v in rows if g == r["g"]]
        below = sum(v < r["v"] for v in mine)
        same = mine.count(r["v"])
        assert (r["before"], r["n"], r["mid_rank"]) == (below, same, below + (same + 1) / 2)
    values = spark.range(100).select(F.col("id").alias("v"), F.lit(2).alias("w"))
    out = running_sum(sliced(values, [], "v"), [], "v", "w", "before")
    assert all(r["before"] == 2 * r["v"] for r in out.collect())


def adjusted(spark, ps, method):
    df = spark.createDataFrame(list(enumerate(ps)), "n int, p_value double")
    out = H.adjust_p_values(df, method=method).orderBy("n").collect()
    return [r["q_value"] for r in out], [r["rejected"] for r in out]


def test_adjusted_p_values(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 1.0, 0.04]
    m, order = len(ps), sorted(ps)
    bh = [min(min(1, order[j] * m / (j + 1)) for j in range(m) if order[j] >= p) for p in ps]
    holm = [max(min(1, order[j] * (m - j)) for j in range(m) if j <= order.index(p)) for p in ps]
    hoch = [min(min(1, order[j] * (m - j)) for j in range(m) if order[j] >= p) for p in ps]
    harmonic = sum(1 / k for k in range(1, m + 1))
    by = [min(min(1, order[j] * m * harmonic / (j + 1)) for j in range(m) if order[j] >= p) for p in ps]
    for method, want in (
        ("fdr_bh", bh), ("holm", holm), ("simes-hochberg", hoch), ("fdr_by", by),
        ("bonferroni", [min(1, p * m) for p in ps]),
        ("sidak", [1 - (1 - p) ** m for p in ps]),
        ("holm-sidak", [max(1 - (1 - order[j]) ** (m - j) for j in range(m) if j <= order.index(p))
                        for p in ps]),
    ):
        q, rejected = adjusted(spark, ps, method)
        assert q == pytest.approx(want), method
        assert rejected == [x <= 0.05 for x in q]
    rejected = sum(q <= 0.05 for q in bh)
    assert 0 < rejected < m
    q, _ = adjusted(spark, ps, "fdr_tsbh")
    assert q == pytest.approx([min(1, x * (m - rejected) / m) for x in bh])
    q, _ = adjusted(spark, [0.5, 0.9], "fdr_tsbky")
    assert q == pytest.approx([0.945, 0.945])
    q, _ = adjusted(spark, ps, "fdr_gbs")
    odds = [(m - j) / (j + 1) * p / (1 - p) if p < 1 else math.inf for j, p in enumerate(order)]
    assert q == pytest.approx([min(1, max(odds[:order.index(p) + 1])) for p in ps])
    for some in (ps, [0.2], [0.0, 0.0, 1.0], [0.02] * 4 + [0.9], []):
        q, _ = adjusted(spark, some, "hommel")
        assert q == pytest.approx(closed_simes(some)), some
    with pytest.raises(ValueError):
        adjusted(spark, ps, "other")


def closed_simes(ps):
    """The largest Simes value of all sets that hold a p-value."""
    out = []
    for k, p in enumerate(ps):
        rest, best = ps[:k] + ps[k + 1:], 0.0
        for size in range(len(rest) + 1):
            for some in itertools.combinations(rest, size):
                s = sorted([p, *some])
                best = max(best, min(len(s) * v / (j + 1) for j, v in enumerate(s)))
        out.append(min(1.0, best))
    return out


def test_closed_test_of_random_p_values():
    rng = random.Random(5)
    for n in (1, 2, 5, 9):
        for _ in range(15):
            ps = [round(rng.random() ** rng.choice([1, 3]), 2) for _ in range(n)]
            order = sorted(ps)
            last = {p: k + 1 for k, p in enumerate(order)}
            hull = closedtest.lower_hull([last[p] for p in sorted(last)], sorted(last))
            got = closedtest.adjusted(np.array(ps), n, hull)
            assert got == pytest.approx(closed_simes(ps)), ps


def test_report_and_samples(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", 3.0)], "g string, v double")
    assert H.samples(df, "g", "v", ["a", "b"]).count() == 2
    assert H.samples(df, "g", "v", ["a", "b"], dropna=False).count() == 3
    r = H.report(H.pearson(pairs(spark, [1, 2, 3], [1, 2, 4]), "x", "y"), "q", "h0", "h1", "Pearson",
                 "statistic", "p_value", notes="n").first()
    assert (r["question"], r["effect_size"], r["notes"]) == ("q", None, "n")


# ------------------------------------------------------------------ inputs that broke it once

@pytest.mark.parametrize("df", [1e8, 1e12, 1e15])
@pytest.mark.parametrize("t", [0.01, 1.0, 2.0, 5.0, 12.0])
def test_student_tail_meets_the_normal_one(df, t):
    # The gap of the two is of the order t**4 / df.
    assert D.student_two_sided(t, df) == pytest.approx(
        2 * D.normal_upper(t), rel=max(1e-9, 10 * t**4 / df))


@pytest.mark.parametrize("df", [2.0, 3.0, 30.0, 99_998.0, 100_002.0, 250_000.0])
def test_student_tail_against_its_integral(df):
    for t in (0.3, 1.7, 4.0):
        steps = 20_000
        log_front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        if df > 1e4:  # the gamma ratio by its expansion
            log_front = -0.5 * math.log(2 * math.pi) - 1 / (4 * df)
        inside = sum(math.exp(log_front - (df + 1) / 2 * math.log1p((t * (k + 0.5) / steps) ** 2 / df))
                     for k in range(steps)) * t / steps
        assert D.student_two_sided(t, df) == pytest.approx(1 - 2 * inside, abs=2e-9)


def test_fisher_tail_of_large_and_small_parts():
    assert D.fisher_upper(4.0, 1.0, 1e12) == pytest.approx(D.student_two_sided(2.0, 1e12), rel=1e-9)
    assert D.fisher_upper(1.0, 1e6, 1e6) == pytest.approx(0.5, abs=1e-9)
    assert D.fisher_upper(0.5, 10.0, 1e9) + D.fisher_upper(2.0, 1e9, 10.0) == pytest.approx(1.0)


def test_an_unfinished_fraction_is_an_error(monkeypatch):
    monkeypatch.setattr(D, "_MOST_TERMS", 3)
    with pytest.raises(ArithmeticError):
        D.incomplete_beta(500.0, 400.0, 0.5, 0.5)


def _pairs(spark, n, y="x * x + 1"):
    return spark.range(n).selectExpr("CAST(id AS DOUBLE) AS x").selectExpr("x", f"{y} AS y")


@pytest.mark.parametrize("n", [2, 5, 171, 300, 1_000_000])
def test_kendall_of_monotone_columns(spark, n):
    r = H.kendall(_pairs(spark, n), "x", "y").first()
    assert r["statistic"] == pytest.approx(1.0)
    expected = 2 / math.factorial(n) if n < 150 else 0.0
    assert r["p_value"] == pytest.approx(min(1.0, expected), rel=1e-9, abs=1e-290)


def test_kendall_with_one_discordant_pair(spark):
    rows = [(float(k), float(k)) for k in range(200)]
    rows[10], rows[11] = (10.0, 11.0), (11.0, 10.0)
    r = H.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert 0.0 <= r["p_value"] < 1e-300


def test_methods_of_rank_tests(spark):
    rows = [("a", float(k)) for k in range(7)] + [("b", k + 0.5) for k in range(3, 12)]
    df = spark.createDataFrame(rows, "sample string, value double")
    p = {m: H.mann_whitney(df, "a", "b", m).first()["p_value"] for m in H.P_METHODS}
    assert p["auto"] == p["exact"] != p["asymptotic"] and abs(p["exact"] - p["asymptotic"]) < 0.05
    tied = df.unionByName(df)
    assert H.mann_whitney(tied, "a", "b").first()["p_value"] == H.mann_whitney(
        tied, "a", "b", "asymptotic").first()["p_value"]
    with pytest.raises(PySparkException):
        H.mann_whitney(tied, "a", "b", "exact").collect()
    with pytest.raises(ValueError):
        H.mann_whitney(df, "a", "b", "guess")
    with pytest.raises(ValueError):
        D.rank_sum_upper(5, 3000, 3000)
    many = _pairs(spark, 40, "CAST((CAST(id AS INT) * 7) % 41 AS DOUBLE)".replace("id", "x"))
    few = {m: H.kendall(many, "x", "y", m).first()["p_value"] for m in H.P_METHODS}
    assert few["auto"] == few["asymptotic"] and abs(few["exact"] - few["asymptotic"]) < 0.02


@pytest.mark.parametrize("fn", [H.pearson, H.spearman])
def test_correlation_of_a_constant_and_of_two_rows(spark, fn):
    flat = fn(_pairs(spark, 50, "5.0D"), "x", "y").first()
    assert math.isnan(flat["statistic"]) and math.isnan(flat["p_value"])
    two = fn(_pairs(spark, 2), "x", "y").first()
    assert two["statistic"] == pytest.approx(1.0) and two["p_value"] == 1.0


def test_levene_far_from_zero(spark):
    rng = random.Random(5)
    rows = [(s, rng.gauss(0, 1 + 3 * (s == "b"))) for s in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "sample string, value double")
    near = H.levene(df).first()["statistic"]
    # Whole powers of two keep the values exact.
    far = df.withColumn("value", F.round(F.col("value") * 1024) / 1024 + 2.0**40)
    assert H.levene(far).first()["statistic"] == pytest.approx(near, rel=1e-2) and near > 50


def test_levene_of_a_large_spread_and_a_small_difference(spark):
    rows = [(s, c + d) for s, d in (("a", 1e-3), ("b", 2e-3)) for c in (-1e8, 1e8) for _ in range(3)]
    df = spark.createDataFrame(rows, "sample string, value double")
    z = {s: [abs(v - sum(x for t, x in rows if t == s) / 6) for t, v in rows if t == s] for s in "ab"}
    grand = sum(map(sum, z.values())) / 12
    between = sum(6 * (sum(v) / 6 - grand) ** 2 for v in z.values())
    got = H.levene(df, "mean").first()["statistic"]
    assert got is None or got >= 0.0 and between >= 0.0


def test_q_values_of_an_input_that_differs_at_each_evaluation(spark):
    rows = spark.range(4000).select(
        "id", (F.lit(0.3) + F.rand() * 1e-15 + F.col("id") % 7 / 100.0).alias("p_value"))
    out = H.adjust_p_values(rows)
    assert out.count() == 4000 and out.where("q_value is null").count() == 0


def test_harmonic_numbers(spark):
    rows = spark.range(1, 400).select("id", D.harmonic(F.col("id").cast("double")).alias("h"))
    total = 0.0
    for r in rows.orderBy("id").collect():
        total += 1 / r["id"]
        assert r["h"] == pytest.approx(total, rel=1e-10)


def test_normal_quantile_of_columns(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-30, 1e-11, 1e-5, 0.02, 0.075, 0.3, 0.5, 0.6, 0.93, 0.99, 1 - 1e-9]
    df = D.with_normal_quantile(spark.createDataFrame([(x,) for x in p], "p double"), F.col("p"), "z")
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-11, abs=1e-12)


def test_shapiro_of_many_equal_values(spark):
    df = spark.range(10_000_000).select(
        F.lit("s").alias("sample"), F.when(F.col("id") < 10, F.col("id").cast("double"))
        .otherwise(3.0).alias("value"))
    r = H.shapiro(df).first()
    assert r["n"] == 10_000_000 and 0.0 < r["statistic"] < 0.01 and r["p_value"] < 1e-6


def test_the_bound_of_normality_is_an_argument(spark):
    rng = random.Random(9)
    rows = [(s, rng.gauss(0, 1)) for s, n in (("small", 30), ("large", 60)) for _ in range(n)]
    df = spark.createDataFrame(rows, "sample string, value double")
    for limit, large in ((60, "shapiro"), (59, "dagostino")):
        got = {r["sample"]: r["method"] for r in H.normality(df, limit=limit).collect()}
        assert got == {"small": "shapiro", "large": large}
