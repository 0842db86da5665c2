"""Hypothesis tests over events, incidents and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics.operators import hypothesis as H
from workload import stored as ST
from workload.fixture import table
from workload.oracle import integral, sql, two_sided_normal, two_sided_student
from workload.registry import query, r6, rounded


def event_samples(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    return H.samples(table(spark, sf_dir, "events"), "event_type", "value", groups)


PAIR = ("click", "view")
_S = "(SELECT event_type AS sample, value FROM events WHERE event_type IN ('click', 'view'))"


@query("""SELECT event_type AS sample, value FROM events
    WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL""")
def group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir, "click", "purchase")


def _dagostino(rows: str) -> str:
    """K-squared per sample from central moments."""
    return f"""SELECT sample, n, zs * zs + zk * zk AS k2 FROM (
      SELECT sample, n,
        ln(y / alpha + sqrt(y * y / (alpha * alpha) + 1)) / sqrt(0.5 * ln(w2)) AS zs,
        (1 - 2 / (9 * a) - sign(den) * pow((1 - 2 / a) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk
      FROM (SELECT *, sqrt(2 / (w2 - 1)) AS alpha, 1 + x * sqrt(2 / (a - 4)) AS den FROM (
        SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2,
          6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM (
          SELECT sample, n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
            3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
            (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
            6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
          FROM (SELECT sample, CAST(count(*) AS DOUBLE) AS n, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS g1,
              avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) AS b2
            FROM (SELECT sample, value, avg(value) OVER (PARTITION BY sample) AS mu FROM {rows}) GROUP BY sample)))))"""


_ALL = "(SELECT event_type AS sample, value FROM events)"


@query(f"""SELECT sample, 'dagostino' AS method, CAST(n AS BIGINT) AS n, {r6('k2', 'statistic')},
    {r6('exp(-k2 / 2)', 'p_value')} FROM ({_dagostino(_ALL)})""")
def normality_dagostino(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "signup", "purchase", "error"]
    return rounded(H.normality(event_samples(spark, sf_dir, *kinds), "dagostino"))


# --- fixed values: coefficients of the normal quantile (Wichura, algorithm AS 241) --------------
_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
_TAIL = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)


def _poly(coefficients: list[float], x: str) -> str:
    text = f"CAST('{coefficients[-1]!r}' AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + CAST('{c!r}' AS DOUBLE))"
    return text


def _quantile(q: str, r: str) -> str:
    """Normal quantile from q = p - 0.5 and r = sqrt(-ln(min(p, 1 - p))), down to p = 1e-11."""
    c = f"(0.180625 - {q} * {q})"
    centre = f"{q} * {_poly(_CENTRE[0], c)} / {_poly(_CENTRE[1], c)}"
    t = f"({r} - 1.6)"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * {_poly(_TAIL[0], t)}"
            f" / {_poly(_TAIL[1], t)} END")


_W = f"""WITH scored AS (SELECT *, {_quantile('q', 'r')} AS m FROM (
    SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM (
      SELECT sample, value, k, n, (k - 0.375) / (n + 0.25) AS p FROM (
        SELECT user_id AS sample, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k,
          CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS n FROM events)))),
  sums AS (SELECT *, ml / sqrt(mm) + {_poly(H.LAST_WEIGHT, '(1 / sqrt(n))')} AS al,
      mn / sqrt(mm) + {_poly(H.NEXT_WEIGHT, '(1 / sqrt(n))')} AS an FROM (
    SELECT sample, n, sum(m * m) AS mm, max(CASE WHEN k = n THEN m END) AS ml, max(CASE WHEN k = n - 1 THEN m END) AS mn
    FROM scored GROUP BY sample, n)),
  weighted AS (SELECT s.sample, s.n, s.value, CASE WHEN s.k = s.n THEN al WHEN s.k = 1 THEN -al
      WHEN s.k = s.n - 1 THEN an WHEN s.k = 2 THEN -an
      ELSE s.m / sqrt((mm - 2 * ml * ml - 2 * mn * mn) / (1 - 2 * al * al - 2 * an * an)) END AS a
    FROM scored s JOIN sums u USING (sample)),
  found AS (SELECT sample, n, pow(sum(a * value), 2) / sum(pow(value - mu, 2)) AS w FROM (
    SELECT *, avg(value) OVER (PARTITION BY sample) AS mu FROM weighted) GROUP BY sample, n),
  z AS (SELECT *, (ln(1 - w) - ({_poly(H.LARGE_MEAN, 'ln(n)')})) / exp({_poly(H.LARGE_SCALE, 'ln(n)')}) AS z FROM found)
  SELECT sample, 'shapiro' AS method, CAST(n AS BIGINT) AS n, {r6('w', 'statistic')},
    {r6("greatest(0.0, 0.5 - sign(z) * " + integral("exp(-xx * xx / 2) / sqrt(2 * pi())", "0", "least(abs(z), 12)", 2000) + ")", 'p_value')}
  FROM z"""


# All users have between 12 and 5000 events, so all rows take the same branch.
@query(_W)
def normality_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro-Wilk or D'Agostino by sample size, for every user's values."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample"), "value"
    )
    return rounded(H.normality(rows, "auto"))


def _levene(center: str, rows: str = _S) -> str:
    """F statistic over (sample, value) with the centre of each sample."""
    return f"""SELECT (n - k) / (k - 1) * between_sum / within_sum AS f, k - 1 AS d1, n - k AS d2 FROM (
      SELECT sum(ni * (zi - zall) * (zi - zall)) AS between_sum, sum(wi) AS within_sum,
        CAST(sum(ni) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k FROM (
        SELECT sample, count(*) AS ni, avg(z) AS zi, any_value(zall) AS zall, sum((z - zbar) * (z - zbar)) AS wi
        FROM (SELECT sample, z, avg(z) OVER (PARTITION BY sample) AS zbar, avg(z) OVER () AS zall FROM (
          SELECT sample, abs(value - {center}(value) OVER (PARTITION BY sample)) AS z FROM {rows}))
        GROUP BY sample))"""


_TRIMMED = f"""(SELECT sample, value FROM (SELECT sample, value,
    row_number() OVER (PARTITION BY sample ORDER BY value) AS r, count(*) OVER (PARTITION BY sample) AS n FROM {_S})
    WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05))"""

# With d1 = 1 the F tail is the two-sided t tail of its root.


def _levene_query(name: str, body: str) -> str:
    return f"""SELECT '{name}' AS center, {r6('f', 'statistic')}, d1 AS df1, d2 AS df2,
      {r6(two_sided_student('sqrt(f)', 'd2'), 'p_value')} FROM ({body})"""


@query(_levene_query("median", _levene("median")))
def levene_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.levene(event_samples(spark, sf_dir, *PAIR)))


@query(_levene_query("mean", _levene("avg")))
def levene_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.levene(event_samples(spark, sf_dir, *PAIR), "mean"))


@query(_levene_query("trimmed", _levene("avg", _TRIMMED)))
def levene_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.levene(event_samples(spark, sf_dir, *PAIR), "trimmed"))


_MOMENTS = """SELECT CAST(count(*) FILTER (WHERE sample = 'click') AS DOUBLE) AS n1,
    CAST(count(*) FILTER (WHERE sample = 'view') AS DOUBLE) AS n2,
    avg(value) FILTER (WHERE sample = 'click') AS m1, avg(value) FILTER (WHERE sample = 'view') AS m2,
    var_samp(value) FILTER (WHERE sample = 'click') AS v1, var_samp(value) FILTER (WHERE sample = 'view') AS v2
  FROM """ + _S


@query(f"SELECT {r6('(m1 - m2) / sqrt((v1 + v2) / 2)', 'effect_size_d')} FROM ({_MOMENTS})")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.cohens_d(event_samples(spark, sf_dir, *PAIR), *PAIR))


_WELCH = f"""SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2)
    / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df,
    (m1 - m2) / sqrt((v1 + v2) / 2) AS d FROM ({_MOMENTS})"""


@query(f"""SELECT 'Welch t-test' AS test, {r6('t', 't_stat')}, {r6('df')},
    {r6(two_sided_student('t', 'df'), 'p_value')}, {r6('d', 'effect_size_d')} FROM ({_WELCH})""")
def welch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.welch(event_samples(spark, sf_dir, *PAIR), *PAIR))


@query(f"""SELECT 'Do clicks and views differ in value?' AS question, 'equal means' AS "H0",
    'unequal means' AS "H1", 'Welch t-test' AS test, {r6('t', 'statistic')},
    {r6(two_sided_student('t', 'df'), 'p_value')}, {r6('d', 'effect_size')},
    CAST(NULL AS VARCHAR) AS notes FROM ({_WELCH})""")
def welch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = H.welch(event_samples(spark, sf_dir, *PAIR), *PAIR)
    return rounded(H.report(
        result, "Do clicks and views differ in value?", "equal means", "unequal means",
        "Welch t-test", "t_stat", "p_value", "effect_size_d",
    ))


_MIDRANKS = """SELECT sample, avg(r) OVER (PARTITION BY value) AS mid, count(*) OVER (PARTITION BY value) AS t
  FROM (SELECT sample, value, row_number() OVER (ORDER BY value) AS r FROM """ + _S + ")"
_U = f"""SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, ties FROM (
    SELECT sum(mid) FILTER (WHERE sample = 'click') AS r1,
      CAST(count(*) FILTER (WHERE sample = 'click') AS DOUBLE) AS n1,
      CAST(count(*) FILTER (WHERE sample = 'view') AS DOUBLE) AS n2,
      sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ({_MIDRANKS}))"""


@query(f"""SELECT 'Mann-Whitney U' AS test, {r6('u', 'u_stat')},
    {r6(f"least(1.0, {two_sided_normal('z')})", 'p_value')}
  FROM (SELECT u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
      / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ({_U}))""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.mann_whitney(event_samples(spark, sf_dir, *PAIR), *PAIR))


@query(_levene_query("median", _levene("median", f"(SELECT sample, value + 1e9 AS value FROM {_S})")))
def levene_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spread far from zero."""
    rows = event_samples(spark, sf_dir, *PAIR)
    return rounded(H.levene(rows.withColumn("value", F.col("value") + F.lit(1e9))))


_DISTRICTS = """SELECT a.district_id AS district, a.s AS s1, a.t AS t1, b.s AS s2, b.t AS t2 FROM (
    SELECT district_id, CAST(sum(hit) AS BIGINT) AS s, count(*) AS t FROM l2 GROUP BY district_id) a
  JOIN (SELECT district_id, CAST(sum(hit) AS BIGINT) AS s, count(*) AS t FROM l2 GROUP BY district_id) b
    ON b.district_id = a.district_id + 1"""


@query(sql(f"""SELECT district, s1, t1, s2, t2, {r6('z', 'z_stat')}, {r6('p1 - p2', 'diff')},
    {r6('p1 - p2 - se', 'ci_low')}, {r6('p1 - p2 + se', 'ci_high')},
    {r6("least(1.0, 2 * (" + integral("exp(-xx * xx / 2) / sqrt(2 * pi())", "abs(z)", "abs(z) + 12") + "))", 'p_value')}
  FROM (SELECT *, (p1 - p2) / sqrt(p * (1 - p) * (1.0 / t1 + 1.0 / t2)) AS z,
      1.96 * sqrt(p1 * (1 - p1) / t1 + p2 * (1 - p2) / t2) AS se
    FROM (SELECT *, s1 / CAST(t1 AS DOUBLE) AS p1, s2 / CAST(t2 AS DOUBLE) AS p2,
      (s1 + s2) / CAST(t1 + t2 AS DOUBLE) AS p FROM ({_DISTRICTS})))""", "l2"))
def district_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrest share of each district against the next one."""
    totals = ST.silver_rows(spark, sf_dir).groupBy("district_id").agg(
        F.sum(F.when(F.col("arrest_made"), 1).otherwise(0)).alias("s"),
        F.count(F.lit(1)).alias("t"),
    )
    first = totals.select(F.col("district_id").alias("district"), F.col("s").alias("s1"),
                          F.col("t").alias("t1"))
    second = totals.select((F.col("district_id") - 1).alias("district"), F.col("s").alias("s2"),
                           F.col("t").alias("t2"))
    pairs = first.join(second, "district")
    return rounded(H.two_proportions(pairs, "s1", "t1", "s2", "t2"))


def _correlation(name: str, r: str, n: str, rows: str) -> str:
    t = f"(({r}) * sqrt((({n}) - 2) / (1 - ({r}) * ({r}))))"
    return f"""SELECT '{name}' AS test, CAST(n AS BIGINT) AS n, {r6('r', 'statistic')},
      {r6(two_sided_student('t', '(n - 2)'), 'p_value')}
      FROM (SELECT n, r, {t.replace(f'({r})', 'r').replace(f'({n})', 'n')} AS t FROM (
        SELECT {r} AS r, CAST({n} AS DOUBLE) AS n FROM {rows}))"""


_PEARSON = _correlation("pearson_r", "corr(l_quantity, l_tax)", "count(*)", "lineitem")


@query(_PEARSON)
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax"))


def _midranks(x: str, y: str) -> str:
    return f"""(SELECT avg(rx) OVER (PARTITION BY {x}) AS x, avg(ry) OVER (PARTITION BY {y}) AS y FROM (
      SELECT {x}, {y}, row_number() OVER (ORDER BY {x}) AS rx, row_number() OVER (ORDER BY {y}) AS ry FROM lineitem))"""


@query(_correlation("spearman_rho", "corr(x, y)", "count(*)", _midranks("l_quantity", "l_discount")))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"))


def _kendall(x: str, y: str) -> str:
    """Signed pairs from running balances on the full grid of values."""
    return f"""WITH c AS (SELECT {x} AS x, {y} AS y, count(*) AS w FROM lineitem GROUP BY ALL),
  grid AS (SELECT a.x, b.y, coalesce(c.w, 0) AS w FROM (SELECT DISTINCT x FROM c) a
    CROSS JOIN (SELECT DISTINCT y FROM c) b LEFT JOIN c ON c.x = a.x AND c.y = b.y),
  along AS (SELECT x, y, w, sum(w) OVER (PARTITION BY x ORDER BY y) AS upto, sum(w) OVER (PARTITION BY x) AS total FROM grid),
  below AS (SELECT x, y, w, sum((upto - w) - (total - upto)) OVER (PARTITION BY y ORDER BY x) - ((upto - w) - (total - upto)) AS balance FROM along),
  signed AS (SELECT CAST(sum(w * balance) AS DOUBLE) AS s FROM below),
  tx AS (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(t * (t - 1) / 2) AS tie, sum(t * (t - 1) * (t - 2)) AS cube, sum(t * (t - 1) * (2 * t + 5)) AS v
    FROM (SELECT CAST(sum(w) AS DOUBLE) AS t FROM c GROUP BY x)),
  ty AS (SELECT sum(t * (t - 1) / 2) AS tie, sum(t * (t - 1) * (t - 2)) AS cube, sum(t * (t - 1) * (2 * t + 5)) AS v
    FROM (SELECT CAST(sum(w) AS DOUBLE) AS t FROM c GROUP BY y)),
  parts AS (SELECT s, n, s / (sqrt(n * (n - 1) / 2 - tx.tie) * sqrt(n * (n - 1) / 2 - ty.tie)) AS tau,
      s / sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + 2 * tx.tie * ty.tie / (n * (n - 1))
        + tx.cube * ty.cube / (9 * n * (n - 1) * (n - 2))) AS z FROM signed, tx, ty)
  SELECT 'kendall_tau' AS test, CAST(n AS BIGINT) AS n, {r6('tau', 'statistic')},
    {r6(two_sided_normal('z'), 'p_value')} FROM parts"""


@query(_kendall("l_quantity", "l_extendedprice"))
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""SELECT 'kendall_tau' AS test, count(*) AS n, CAST(1 AS DOUBLE) AS statistic,
    CAST(0 AS DOUBLE) AS p_value FROM events""")
def kendall_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's number against a strictly rising function of it."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("x"), (F.col("event_id") * F.col("event_id") + 3).alias("y"))
    return rounded(H.kendall(rows, "x", "y"))


@query("""SELECT unnest(['pearson_r', 'spearman_rho']) AS test, n, CAST(NULL AS DOUBLE) AS statistic,
    CAST(NULL AS DOUBLE) AS p_value FROM (SELECT count(*) AS n FROM lineitem)""")
def correlation_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column against a constant one has no correlation; NaN is shown as null."""
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    both = H.pearson(rows, "l_quantity", "one").unionByName(H.spearman(rows, "l_quantity", "one"))
    return both.select("test", "n", *[F.nullif(F.col(c), F.lit(float("nan"))).alias(c)
                                      for c in ("statistic", "p_value")])


_TABLE = " UNION ALL ".join(f"SELECT * FROM ({text})" for text in (
    _correlation("pearson_r", "corr(l_discount, l_tax)", "count(*)", "lineitem"),
    _correlation("spearman_rho", "corr(x, y)", "count(*)", _midranks("l_discount", "l_tax")),
    _kendall("l_discount", "l_tax"),
))


@query(_TABLE)
def correlation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.correlations(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax"))


_USERS = f"""(SELECT sample, exp(-k2 / 2) AS p_value FROM ({_dagostino(
    "(SELECT user_id AS sample, value FROM events)")}) WHERE n > 7)"""
_M = "CAST(count(*) OVER () AS DOUBLE)"
_FIRST = "rank() OVER (ORDER BY p_value)"
_LAST = "(count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _adjusted(raw: str, running: str) -> str:
    return f"""SELECT sample, {r6('p_value')}, {r6('q', 'q_value')}, q <= 0.05 AS rejected FROM (
      SELECT sample, p_value, least(1.0, {running}) AS q FROM (
        SELECT sample, p_value, {raw} AS q FROM {_USERS}))"""


_FROM_TOP = "min(q) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FROM_LOW = "max(q) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _user_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), "value")
    return H.dagostino(rows).where("n > 7").select("sample", "p_value")


def _adjust(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    adjusted = H.adjust_p_values(_user_p_values(spark, sf_dir), method=method)
    return rounded(adjusted.select("sample", "p_value", "q_value", "rejected"))


@query(_adjusted(f"p_value * {_M} / {_LAST}", _FROM_TOP))
def fdr_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "fdr_bh")


@query(_adjusted(
    f"p_value * {_M} * (SELECT sum(1.0 / g) FROM range(1, 1 + (SELECT count(*) FROM {_USERS})) r(g)) / {_LAST}",
    _FROM_TOP))
def fdr_benjamini_yekutieli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "fdr_by")


def _two_stage(factor: float) -> str:
    bh = f"""SELECT sample, p_value, least(1.0, {_FROM_TOP}) AS q FROM (
      SELECT sample, p_value, p_value * {_M} / {_LAST} AS q FROM {_USERS})"""
    return f"""WITH bh AS ({bh}), first AS (SELECT CAST(count(*) AS DOUBLE) AS m,
        CAST(count(*) FILTER (WHERE q <= 0.05 / {factor}) AS DOUBLE) AS r FROM bh)
      SELECT sample, {r6('p_value')}, {r6('q', 'q_value')}, q <= 0.05 AS rejected FROM (
        SELECT sample, p_value, least(1.0, q * CASE WHEN r = 0 OR r = m THEN 1.0 ELSE (m - r) / m END * {factor}) AS q
        FROM bh, first)"""


@query(_two_stage(1.0))
def fdr_two_stage_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "fdr_tsbh")


@query(_two_stage(1.05))
def fdr_two_stage_bky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "fdr_tsbky")


@query(_adjusted(f"p_value / (1 - p_value) * ({_M} - {_FIRST} + 1) / {_FIRST}", _FROM_LOW))
def fdr_gavrilov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "fdr_gbs")


@query(f"""WITH p AS (SELECT sample, p_value, row_number() OVER (ORDER BY p_value) AS r, {_M} AS m FROM {_USERS}),
  simes AS (SELECT i, min(CAST(i AS DOUBLE) * p_value / (r - m + i)) AS c
    FROM (SELECT unnest(range(1, CAST(max(m) AS BIGINT) + 1)) AS i FROM p) s JOIN p ON r > m - i GROUP BY i),
  adjusted AS (SELECT sample, p_value, max(least(c, i * p_value)) AS q FROM p, simes GROUP BY sample, p_value)
  SELECT sample, {r6('p_value')}, {r6('least(1.0, q)', 'q_value')}, q <= 0.05 AS rejected FROM adjusted""")
def hommel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "hommel")


@query(_adjusted(f"p_value * ({_M} - {_FIRST} + 1)", _FROM_LOW))
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "holm")


@query(_adjusted(f"1 - pow(1 - p_value, {_M} - {_FIRST} + 1)", _FROM_LOW))
def holm_sidak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "holm-sidak")


@query(_adjusted(f"p_value * ({_M} - {_LAST} + 1)", _FROM_TOP))
def simes_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "simes-hochberg")


@query(_adjusted(f"p_value * {_M}", "q"))
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "bonferroni")


@query(_adjusted(f"1 - pow(1 - p_value, {_M})", "q"))
def sidak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjust(spark, sf_dir, "sidak")


@query(sql(f"""SELECT date, cell, {r6('n_arrests / CAST(nullif(n_crimes, 0) AS DOUBLE)', 'arrest_rate')}
    FROM daily WHERE res = 7""", "daily"))
def safe_arrest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.arrest_rate(ST.gold_rows(spark, sf_dir, 7))
    return rounded(rows.select("date", "cell", "arrest_rate"))
