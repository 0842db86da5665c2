"""Lattice geometry, cell aggregates and drill maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L, subtree as U
from hexlytics.operators import cells as C, sketches as K_
from hexlytics.plans.gold import gold_daily, gold_rolling
from hexlytics.sources import layers as T
from workload import stored as ST
from workload.oracle import (
    _cube, _num, _parent, centre, offsets, pooled, rolling, sql,
)
from workload.registry import query, r6, rounded


def _turned(res: int) -> str:
    """Plane coordinates in the axes of a level."""
    angle = -math.atan2(math.sqrt(3.0), 5.0) if (10 - res) % 2 else 0.0
    c, s = _num(math.cos(angle)), _num(math.sin(angle))
    return f"(SELECT id, px * {c} + py * {s} AS tx, py * {c} - px * {s} AS ty FROM plane)"


@query(sql("SELECT id, i, j FROM (" + _cube(
    _turned(7), "tx", "ty", K.FINEST_RADIUS_KM * math.sqrt(7.0) ** 3, "i", "j") + ")", "plane"))
def direct_cells_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement at one level directly, not by way of the finest."""
    rows = ST.bronze_rows(spark, sf_dir).select("id", "latitude", "longitude")
    return L.locate(rows, "i", "j", res=7).select("id", "i", "j")


@query(sql(f"""SELECT DISTINCT d.cell, concat_ws(':', 8, d.i + o.di, d.j + o.dj) AS neighbour
    FROM daily d CROSS JOIN {offsets(2)} WHERE d.res = 8""", "daily"))
def rings_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ST.cells_of(ST.gold_rows(spark, sf_dir, 8)).distinct()
    return L.ring_cells(cells, "res", "i", "j", 2).select(
        L.cell_id(F.col("res"), F.col("i"), F.col("j")).alias("cell"),
        L.cell_id(F.col("res"), F.col("ni"), F.col("nj")).alias("neighbour"),
    )


@query(sql(f"SELECT res, cell, {r6('lat')}, {r6('lon')} FROM centres", "centres"))
def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ST.gold_rows(spark, sf_dir).select("res", "cell").distinct()
    return rounded(L.id_centre(cells, "cell"))


def _corner(res: int, part: str) -> str:
    size = K.FINEST_RADIUS_KM * math.sqrt(7.0) ** (10 - res)
    turn = -math.atan2(math.sqrt(3.0), 5.0) if (10 - res) % 2 else 0.0
    angle = f"(radians(30 + 60 * (v % 6)) + {_num(turn)})"
    if part == "lat":
        return f"lat + {_num(size)} * sin({angle}) / {_num(K.KM_PER_LAT)}"
    return f"lon + {_num(size)} * cos({angle}) / {_num(K.KM_PER_LON)}"


@query(sql(f"""SELECT cell, CAST(v AS INT) AS vertex, {r6(_corner(9, 'lat'), 'lat')}, {r6(_corner(9, 'lon'), 'lon')}
    FROM centres CROSS JOIN range(7) r(v) WHERE res = 9""", "centres"))
def cell_boundaries_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ST.gold_rows(spark, sf_dir, 9).select("cell").distinct()
    return rounded(L.boundary_points(cells, "cell", 9))


_POINT = (
    f"'[' || CAST(CAST({_corner(8, 'lon')} AS DECIMAL(9,6)) AS VARCHAR) || ',' || "
    f"CAST(CAST({_corner(8, 'lat')} AS DECIMAL(9,6)) AS VARCHAR) || ']'"
)
_FEATURES_R8 = f"""SELECT cell, '{{"type":"Feature","id":"' || cell || '","properties":{{"h3_id":"' || cell ||
    '"}},"geometry":{{"type":"Polygon","coordinates":[[' || string_agg({_POINT}, ',' ORDER BY v) || ']]}}}}' AS feature
  FROM centres CROSS JOIN range(7) r(v) WHERE res = 8 GROUP BY cell"""


@query(sql(_FEATURES_R8, "centres"))
def geojson_features_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ST.gold_rows(spark, sf_dir, 8).select("cell").distinct()
    return L.geojson_features(cells, "cell", 8)


_PARENT_R8 = f"concat_ws(':', 7, {_parent(8, 'i', 'j')[0]}, {_parent(8, 'i', 'j')[1]})"


@query(sql(f"""SELECT parent,
      '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY cell) || ']}}' AS collection
    FROM ({_FEATURES_R8}) JOIN (SELECT DISTINCT cell, {_PARENT_R8} AS parent FROM daily WHERE res = 8) USING (cell)
    GROUP BY parent""", "daily", "centres"))
def geojson_map_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells, one collection per parent cell."""
    cells = ST.gold_rows(spark, sf_dir, 8).select("cell").distinct()
    return L.feature_collections(cells, "cell", 8)


_MAP = " UNION ALL ".join(
    f"""SELECT DISTINCT {r} AS child_res, {r - 1} AS parent_res,
      concat_ws(':', {r - 1}, {_parent(r, 'i', 'j')[0]}, {_parent(r, 'i', 'j')[1]}) AS parent, cell AS child
    FROM daily WHERE res = {r}""" for r in (7, 8, 9, 10)
)


@query(sql(_MAP, "daily"))
def drill_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drill_map(ST.cells_of(ST.gold_rows(spark, sf_dir)))


@query(sql(f"SELECT parent, child FROM ({_MAP}) WHERE parent_res = 8", "daily"))
def drill_pair_8_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_drill_map(spark, ST.drill_path(spark, sf_dir), 8, 9)


@query(sql(f"""SELECT parent, child FROM ({_MAP}) WHERE parent_res = 7 AND parent IN (
      SELECT cell FROM daily WHERE res = 7 GROUP BY cell HAVING sum(n_crimes) >= 50)""", "daily"))
def children_of_busy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = (
        ST.gold_rows(spark, sf_dir, 7).groupBy("cell").agg(F.sum("n_crimes").alias("n"))
        .where("n >= 50").select(F.col("cell").alias("parent"))
    )
    mapping = T.read_drill_map(spark, ST.drill_path(spark, sf_dir), 7, 8)
    return C.children_of(mapping, busy)


@query(sql("""SELECT h3_r9 AS cell, CAST(count(*) AS BIGINT) AS n_crimes FROM l2 WHERE h3_r9 IS NOT NULL AND h3_r6 = (
      SELECT cell FROM daily WHERE res = 6 GROUP BY cell ORDER BY sum(n_crimes) DESC, cell LIMIT 1)
    GROUP BY ALL""", "l2", "daily"))
def cells_below_busiest_r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels down from the busiest coarse cell, as one key range of the clustered table."""
    busiest = (
        ST.gold_rows(spark, sf_dir, 6).groupBy("cell").agg(F.sum("n_crimes").alias("n"))
        .orderBy(F.desc("n"), "cell").first()
    )
    rows = spark.read.parquet(ST.clustered_path(spark, sf_dir))
    if busiest is None:
        return rows.limit(0).select("cell", "n_crimes")
    return U.below(rows, busiest["cell"]).groupBy("cell").agg(F.sum("n_crimes").alias("n_crimes"))


@query(sql(f"SELECT parent, child FROM ({_MAP}) WHERE parent = '6:0:0'", "daily"))
def children_of_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = T.read_drill_map(spark, ST.drill_path(spark, sf_dir), 6, 7)
    return C.children_of(mapping, "6:0:0")


@query(sql("SELECT res, count(*) AS cells FROM cell_list GROUP BY res", "cell_list"))
def distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_cells(ST.silver_rows(spark, sf_dir))


@query(sql("SELECT cell, date, n_crimes, n_arrests FROM daily WHERE res = 9", "daily"))
def daily_counts_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.daily_counts(ST.silver_rows(spark, sf_dir), "h3_r9")


@query(sql("SELECT res, i, j, date, n_crimes, n_arrests FROM daily", "daily"))
def daily_counts_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.daily_levels(ST.silver_rows(spark, sf_dir))


@query(sql("""SELECT cell, CAST(date_trunc('month', date) AS DATE) AS month_start,
      CAST(sum(n_crimes) AS BIGINT) AS n_crimes, CAST(sum(n_arrests) AS BIGINT) AS n_arrests
    FROM daily WHERE res = 9 GROUP BY ALL""", "daily"))
def monthly_counts_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.monthly_counts(C.daily_counts(ST.silver_rows(spark, sf_dir), "h3_r9"), ["cell"])


_RATED = ", ".join(r6(c) for c in ("raw_rate", "smoothed_rate", "ci_low", "ci_high"))


@query(sql(f"""SELECT cell, date, n_crimes, n_arrests, low_conf, {r6('prior')}, {_RATED}
    FROM rated WHERE res = 7""", "rated"))
def daily_rates_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level on its own: counts, month prior, rates and interval."""
    daily = C.with_month_keys(C.daily_counts(ST.silver_rows(spark, sf_dir), "h3_r7"))
    by = ("year", "month")
    rated = C.with_rates(C.with_prior(daily, C.month_priors(daily, by), by))
    return rounded(rated.drop("year", "month"))


_POOLED = f"pooled_n, pooled_k, {r6('pooled_rate')}, {r6('pooled_smoothed')}"
_GOLD = f"SELECT res, year, month, cell, date, n_crimes, n_arrests, low_conf, {_RATED}, {_POOLED} FROM "


@query(sql(_GOLD + "gold", "gold"))
def gold_daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gold_daily(ST.silver_rows(spark, sf_dir)))


@query(sql(_GOLD + f"({pooled(2)})", "rated"))
def gold_daily_ring2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gold_daily(ST.silver_rows(spark, sf_dir), pool_k=2))


@query(sql(f"""SELECT res, year, month, cell, date, n_crimes, n_arrests, low_conf, {_RATED},
    0 AS pooled_n, 0 AS pooled_k, {r6('prior', 'pooled_rate')}, {r6('smoothed_rate', 'pooled_smoothed')}
  FROM rated""", "rated"))
def gold_daily_unpooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gold_daily(ST.silver_rows(spark, sf_dir), pool_k=0))


@query(sql(f"""SELECT res, year, month, cell, n_crimes, n_arrests,
    {r6('n_arrests / CAST(n_crimes AS DOUBLE)', 'raw_rate')},
    {r6('(5.0 * prior + n_arrests) / (5.0 + n_crimes)', 'smoothed_rate')} FROM monthly""", "monthly"))
def gold_monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored monthly table, summed from the stored daily one."""
    return rounded(T.read_layer(spark, ST.monthly_path(spark, sf_dir), strict=True))


_PROFILE = f"cell, date, n_crimes, n_arrests, unique_streets, top_crime_type, {r6('arrest_rate')}"


@query(sql(f"""SELECT {_PROFILE} FROM (
    SELECT *, n_arrests / CAST(n_crimes AS DOUBLE) AS arrest_rate FROM profile)""", "profile"))
def daily_profile_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.daily_profile(ST.silver_rows(spark, sf_dir), 9))


_ROLL = "rolling_n_7, rolling_n_14, rolling_n_30"


@query(sql(f"SELECT 9 AS res, year, month, {_PROFILE}, {_ROLL} FROM ({rolling('cell, year, month')})",
           "profile"))
def gold_rolling_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read_layer(spark, ST.rolling_path(spark, sf_dir), strict=True)
    return rounded(rows)


@query(sql(f"SELECT 9 AS res, year, month, {_PROFILE}, {_ROLL} FROM ({rolling('cell')})", "profile"))
def gold_rolling_across_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gold_rolling(ST.silver_rows(spark, sf_dir), 9, across_months=True))


@query(sql("""SELECT d.cell, d.day AS date, coalesce(n.n_crimes, 0) AS n_crimes FROM (
      SELECT cell, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day
      FROM daily WHERE res = 8 GROUP BY cell, year(date), month(date)) d
    LEFT JOIN (SELECT * FROM daily WHERE res = 8) n ON n.cell = d.cell AND n.date = d.day""", "daily"))
def dense_days_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense_days(C.daily_counts(ST.silver_rows(spark, sf_dir), "h3_r8"))


@query(sql(f"""SELECT h3_id, {r6('lat')}, {r6('lon')} FROM (
      SELECT * FROM ({centre("(SELECT DISTINCT 7 AS res, i7 AS i, j7 AS j, h3_r7 AS h3_id FROM l2)")}))""",
    "l2"))
def silver_cell_centres_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ST.silver_rows(spark, sf_dir).select(F.col("h3_r7").alias("h3_id")).distinct()
    return rounded(L.id_centre(cells, "h3_id"))


@query(sql("SELECT res, count(*) AS cells, true AS within FROM cell_list GROUP BY res", "cell_list"))
def distinct_cells_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cells from sketches by month, merged over all months, beside the exact number: within
    four deviations of it."""
    rows = ST.silver_rows(spark, sf_dir)
    guess = K_.estimated(K_.merged(K_.cell_sketches(rows), ["res"]), "guess")
    off = F.abs(F.col("guess") - F.col("cells")) / F.col("cells")
    return C.distinct_cells(rows).join(guess, "res").select(
        "res", "cells", (off <= 4 * K_.DEVIATION).alias("within"))


@query(sql("""SELECT cell, CAST(date_trunc('month', date) AS DATE) AS month_start,
    count(DISTINCT street_norm) AS unique_streets
  FROM (SELECT h3_r8 AS cell, date, street_norm FROM l2 WHERE h3_r8 IS NOT NULL) GROUP BY ALL""", "l2"))
def monthly_streets_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct streets of parent cells and months, from sketches by finer cell and day. A sketch of
    so few streets (at most some hundred) is exact."""
    days = K_.street_sketches(ST.silver_rows(spark, sf_dir), 9)
    months = K_.merged(days, ["cell", F.trunc("date", "month").alias("month_start")])
    return K_.estimated(K_.parents_of(months, 9), "unique_streets")
