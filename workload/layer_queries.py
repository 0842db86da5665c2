"""Raw files, bronze, silver and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics import constants as K, schemas as S
from hexlytics.functions import features as X, lattice as L
from hexlytics.operators import cleaning as C
from hexlytics.plans.bronze import bronze, typed
from hexlytics.plans.gold import gold_daily
from hexlytics.plans.silver import canonical, silver
from hexlytics.session import scratch_path
from hexlytics.sources import layers as T, raw as R
from workload import stored as ST
from workload.fixture import raw_incidents, table
from workload.oracle import sql
from workload.registry import query, r6, rounded

_RAW_NAMES = ", ".join(S.RAW_SCHEMA.names)


@query(sql(f"SELECT {_RAW_NAMES} FROM raw", "raw"))
def raw_yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.raw_rows(spark, sf_dir)


@query(sql("""SELECT id, date, primary_type,
    CASE WHEN id LIKE 'E%' THEN domestic END AS domestic FROM raw""", "raw"))
def raw_monthly_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).select("id", "date", "domestic", "primary_type")
    of_events = F.col("id").startswith("E")
    first, second = scratch_path(spark, "monthly-a"), scratch_path(spark, "monthly-b")
    rows.where(of_events).write.options(**R.CSV).csv(first)
    # The other source has its columns in another order and lacks one; a third path is absent.
    rows.where(~of_events).select("primary_type", "id", "date").write.options(**R.CSV).csv(second)
    paths = [first, scratch_path(spark, "monthly-absent"), second]
    return R.read_monthly_raw(spark, paths).select("id", "date", "primary_type", "domestic")


@query(sql(f"""SELECT {', '.join(
    f"CASE WHEN tag = 'E' THEN {c} END AS {c}" if c in ('case_number', 'location') else c
    for c in S.RAW_SCHEMA.names)} FROM (SELECT *, left(id, 1) AS tag FROM raw)""", "raw"))
def raw_shuffled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files of two kinds: the second has its columns turned round, lacks two of them and
    has one of its own."""
    path = scratch_path(spark, "raw-shuffled")
    rows = raw_incidents(spark, sf_dir)
    of_events = F.col("id").startswith("E")
    turned = [c for c in reversed(S.RAW_SCHEMA.names) if c not in ("case_number", "location")]
    R.write_raw_by_year(rows.where(of_events), f"{path}/first")
    R.write_raw_by_year(
        rows.where(~of_events).select(F.lit("own").alias("remark"), *turned), f"{path}/second")
    return R.read_raw(spark, [f"{path}/first", f"{path}/second"])


_SPAN = """SELECT min(a) AS a, max(b) AS b FROM (
    SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders
    UNION ALL SELECT min(ts), max(ts) FROM events)"""
_WORK = f"""SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month, CAST(m AS DATE) AS starts,
    CAST(m + INTERVAL 1 MONTH AS DATE) AS ends
  FROM (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m
    FROM ({_SPAN}))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d")).unionByName(
        table(spark, sf_dir, "events").select(F.col("ts").alias("d"))
    )
    return dates.agg(F.min("d").alias("a"), F.max("d").alias("b"))


@query(_WORK)
def month_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.month_work_list(_spans(spark, sf_dir), "a", "b")


@query(sql(f"""SELECT w.* FROM ({_WORK}) w
    WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.year = w.year AND l1.month = w.month)
      AND NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderstatus = 'P' AND year(o_orderdate) = w.year)""",
    "l1"))
def pending_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = T.partitions(ST.bronze_rows(spark, sf_dir), "year", "month")
    years = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.year("o_orderdate").alias("year")
    )
    return R.pending_months(R.month_work_list(_spans(spark, sf_dir), "a", "b"), done, years.distinct())


_BRONZE = [name for _, name, _ in K.RAW_COLUMNS] + ["datetime", "year", "month"]


@query(sql(f"SELECT {', '.join(_BRONZE)} FROM l1", "l1"))
def bronze_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze(ST.raw_rows(spark, sf_dir))


@query(sql("""SELECT * FROM (
    SELECT 'arrest_made' AS column, count(*) FILTER (WHERE r.arrest IS NOT NULL AND t.arrest_made IS NULL) AS failures FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'is_domestic', count(*) FILTER (WHERE r.domestic IS NOT NULL AND t.is_domestic IS NULL) FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'beat_id', count(*) FILTER (WHERE r.beat IS NOT NULL AND t.beat_id IS NULL) FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'district_id', count(*) FILTER (WHERE r.district IS NOT NULL AND t.district_id IS NULL) FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'ward_id', count(*) FILTER (WHERE r.ward IS NOT NULL AND t.ward_id IS NULL) FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'community_area_id', count(*) FILTER (WHERE r.community_area IS NOT NULL AND t.community_area_id IS NULL) FROM raw r JOIN typed t USING (id)
    UNION ALL SELECT 'x_coordinate', 0 UNION ALL SELECT 'y_coordinate', 0 UNION ALL SELECT 'incident_year', 0
    UNION ALL SELECT 'latitude', 0
    UNION ALL SELECT 'longitude', count(*) FILTER (WHERE longitude = 'abc') FROM raw)""", "typed"))
def cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cast_failures(C.known_columns(C.standard_names(ST.raw_rows(spark, sf_dir))))


@query(sql(f"""SELECT *, total_rows - kept_rows AS dropped_rows,
    {r6('100.0 * (total_rows - kept_rows) / total_rows', 'dropped_percent')}
  FROM (SELECT (SELECT count(*) FROM typed) AS total_rows,
    (SELECT count(*) FROM typed WHERE datetime IS NULL) AS null_datetime,
    (SELECT count(*) FROM typed WHERE latitude IS NULL OR longitude IS NULL) AS null_coordinates,
    (SELECT count(*) FROM l1) AS kept_rows)""", "typed", "l1"))
def load_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.load_quality(typed(ST.raw_rows(spark, sf_dir))))


_FILLS = [*K.TEXT_FILL_COLUMNS, *K.ID_FILL_COLUMNS]


@query(sql(f"""SELECT count(*) AS rows_in,
    count(*) FILTER (WHERE bad) AS dropped_critical,
    {', '.join(f"count(*) FILTER (WHERE NOT bad AND {c} IS NULL) AS filled_{c}" for c in _FILLS)}
  FROM (SELECT *, datetime IS NULL OR latitude IS NULL OR longitude IS NULL AS bad FROM typed)""",
    "typed"))
def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_report(typed(ST.raw_rows(spark, sf_dir)))


@query(sql("""SELECT year, month, count(*) AS incidents, count(DISTINCT id) AS ids FROM l1
    WHERE year >= 1998 GROUP BY year, month""", "l1"))
def bronze_from_start_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read_layer(spark, ST.bronze_path(spark, sf_dir), start_year=1998)
    return rows.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_distinct("id").alias("ids")
    )


@query(sql("SELECT year, month, mode_beat_id, mode_district_id, mode_ward_id, "
           "mode_community_area_id FROM month_modes", "month_modes"))
def month_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.month_modes(ST.bronze_rows(spark, sf_dir), K.ID_FILL_COLUMNS)


_SILVER = [f.name for f in S.SILVER_SCHEMA]


@query(sql("SELECT " + ", ".join(
    r6(c) if c in S.CYCLIC_COLUMNS or c in ("latitude", "longitude") else c for c in _SILVER
) + " FROM l2", "l2"))
def silver_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(silver(ST.bronze_rows(spark, sf_dir)))


@query(sql("SELECT id, date, h3_r9, crime_category FROM l2 WHERE year = 1998 AND month IN (2, 5, 11)",
           "l2"))
def silver_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read_layer(spark, ST.silver_path(spark, sf_dir), 1998, {11, 2, 5}, strict=True)
    return rows.select("id", "date", "h3_r9", "crime_category")


@query(sql("""SELECT datetime, primary_type, crime_category, street_norm, block_address, arrest_made,
    community_area_id, district_id, ward_id, h3_r6, h3_r7, h3_r8, h3_r9, h3_r10, month FROM view""",
    "view"))
def serving_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.serving_view(ST.silver_rows(spark, sf_dir))


@query(sql("SELECT id, h3_r9, CAST(coalesce(h3_r9, '') AS VARCHAR) AS h3, street_norm FROM l2", "l2"))
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame without the usual cell column takes it from a fallback name."""
    rows = ST.silver_rows(spark, sf_dir)
    loose = rows.select(
        "id", "datetime", F.col("h3_r9").alias("h3"), "street_norm",
        F.col("hour_sin").cast("string").alias("hour_sin"),
    )
    return canonical(loose).select("id", "h3_r9", "h3", "street_norm")


@query(sql("SELECT id, street_norm FROM (SELECT id, " + (
    "regexp_replace(regexp_replace(regexp_replace(upper(coalesce(block, '')),"
    " '^\\d{3,4}XX\\s+', ''), '^\\d+\\s+', ''), '^\\s+|\\s+$', '', 'g')"
) + " AS street_norm FROM raw)", "raw"))
def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.raw_rows(spark, sf_dir).select("id", X.street_name(F.col("block")).alias("street_norm"))


@query(sql("""SELECT block, string_agg(CASE WHEN k > 1 AND regexp_matches(substr(block, k - 1, 1), '[A-Za-z]')
      THEN lower(substr(block, k, 1)) ELSE upper(substr(block, k, 1)) END, '' ORDER BY k) AS title
    FROM (SELECT block, unnest(range(1, length(block) + 1)) AS k FROM (
      SELECT DISTINCT block FROM raw WHERE block IS NOT NULL)) GROUP BY block""", "raw"))
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ST.raw_rows(spark, sf_dir).where("block IS NOT NULL").select("block").distinct()
    return blocks.select("block", X.title_case(F.col("block")).alias("title"))


@query(sql("""SELECT r.id, c.res, c.label, c.size FROM (
      SELECT id, CAST(unnest([6, 7, 8, 9, 10]) AS INT) AS res FROM l1) r
    JOIN (VALUES """ + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in K.RESOLUTION_GUIDE) + """)
      AS c(res, label, size) ON c.res = r.res""", "l1"))
def resolution_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hexlytics.operators.context import resolution_guide

    levels = F.explode(F.array(*[F.lit(r) for r in K.RESOLUTIONS])).alias("res")
    rows = ST.bronze_rows(spark, sf_dir).select("id", levels)
    return resolution_guide(rows).select("id", "res", "label", "size")


@query(sql(f"""SELECT res, year, month, cell, date, n_crimes, n_arrests, {r6('smoothed_rate')},
    {r6('pooled_smoothed')} FROM gold""", "gold"))
def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the gold table, rebuild its last years in place, read all of it."""
    path = scratch_path(spark, "gold-rebuild")
    rows = gold_daily(ST.silver_rows(spark, sf_dir))
    T.write_gold(rows, path)
    rebuilt = gold_daily(ST.silver_rows(spark, sf_dir).where(F.col("year") >= 2001))
    T.write_gold(rebuilt, path)
    out = T.read_layer(spark, path, strict=True)
    return rounded(out.select("res", "year", "month", "cell", "date", "n_crimes", "n_arrests",
                              "smoothed_rate", "pooled_smoothed"))


@query(sql(f"""SELECT cell AS h3_r8, date, n_crimes, {r6('ci_low')}, {r6('ci_high')} FROM gold
    WHERE res = 8 AND year = 1999 AND month IN (1, 2, 3)""", "gold"))
def gold_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read_gold(spark, ST.gold_path(spark, sf_dir), 8, 1999, [1, 2, 3])
    return rounded(rows.select("h3_r8", "date", "n_crimes", "ci_low", "ci_high"))


@query(sql("SELECT id, h3_r6, h3_r7, h3_r8, h3_r9, h3_r10 FROM l2", "l2"))
def cell_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ST.bronze_rows(spark, sf_dir).select("id", "latitude", "longitude")
    return L.assign_cells(rows).drop("latitude", "longitude")
