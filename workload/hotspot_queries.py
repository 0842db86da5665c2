"""Serving queries over the whole period: context, focus, drill, key figures, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics import constants as K
from hexlytics.operators import cells as C, context as X, profiles as P
from hexlytics.plans.hotspots import Drill, HotspotView
from hexlytics.sources import layers as T
from workload import stored as ST
from workload.cell_queries import _MAP
from workload.oracle import context, hotspots, share, sql, summary, top
from workload.registry import query, r6, rounded

THEFTS = ("THEFT", "BATTERY")
IS_THEFT = "primary_type IN ('THEFT', 'BATTERY')"
IS_PROPERTY = "crime_category = 'Property'"
PARENT = "7:0:0"
CHILDREN = f"(SELECT child FROM ({_MAP}) WHERE parent = '{PARENT}')"


def serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.serving_view(ST.silver_rows(spark, sf_dir))


def view(spark: SparkSession, sf_dir: str, res: int, drill: bool = False, **choice) -> HotspotView:
    scope = None
    if drill:
        mapping = T.read_drill_map(spark, ST.drill_path(spark, sf_dir), res - 1, res)
        scope = Drill(res - 1, PARENT, C.children_of(mapping, PARENT))
    return HotspotView(
        serving(spark, sf_dir), ST.gold_rows(spark, sf_dir, res), res, drill=scope, **choice
    )


# ------------------------------------------------------------------------- per-cell frames

_SUMMARY = (
    f"h3_id, n_crimes, n_arrests, {r6('low_conf_share')}, {r6('smoothed_rate')},"
    f" {r6('pooled_smoothed')}, {r6('lat')}, {r6('lon')}"
)


@query(sql(f"SELECT {_SUMMARY} FROM ({summary(8)})", "gold", "centres"))
def period_summary_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.period_summary(ST.gold_rows(spark, sf_dir, 8)))


@query(sql(f"SELECT {_SUMMARY} FROM ({summary(7, weighted=False)})", "gold", "centres"))
def period_summary_plain_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.period_summary(ST.gold_rows(spark, sf_dir, 7), weighted=False))


@query(sql(f"""SELECT h3_id, n_crimes, common_crime, signature_street, {r6('focus_share')} FROM (
      SELECT s.h3_id, s.n_crimes, k.common_crime, k.signature_street, f.focus_share
      FROM ({summary(9, weighted=False)}) s LEFT JOIN ({context('view', 'h3_r9')}) k USING (h3_id)
      LEFT JOIN ({share('h3_r9', IS_THEFT, None)}) f USING (h3_id))
    ORDER BY n_crimes DESC, h3_id LIMIT 10""", "gold", "centres", "view"))
def top_summary_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten busiest cells with plain means and an unrounded share."""
    rows = serving(spark, sf_dir)
    plain = X.period_summary(ST.gold_rows(spark, sf_dir, 9), weighted=False)
    shared = X.focus_share(rows, "h3_r9", F.col("primary_type").isin(*THEFTS), digits=None)
    joined = plain.join(X.build_context(rows, "h3_r9"), "h3_id", "left").join(shared, "h3_id", "left")
    out = joined.select("h3_id", "n_crimes", "common_crime", "signature_street", "focus_share")
    return rounded(out.orderBy(F.col("n_crimes").desc(), "h3_id").limit(10))


@query(sql(top("view", "h3_r8", "street_norm", "signature_street").replace("h3_r8 AS h3_id", "h3_r8"),
           "view"))
def top_street_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_value(serving(spark, sf_dir), "h3_r8", "street_norm", "signature_street")


_CONTEXT = (
    "h3_id, common_crime, common_crime_count, signature_street, signature_street_count,"
    " signature_block, signature_block_count, district_id, district_id_count, ward_id,"
    " ward_id_count, community_area_id, community_area_id_count"
)


@query(sql(f"SELECT {_CONTEXT} FROM ({context('view', 'h3_r8')})", "view"))
def cell_context_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.build_context(serving(spark, sf_dir), "h3_r8")


_SHARE = f"h3_id, incident_total, focus_count, {r6('focus_share')}"


@query(sql(f"SELECT {_SHARE} FROM ({share('h3_r9', IS_THEFT)})", "view"))
def focus_share_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 9, types=THEFTS).share())


@query(sql(f"SELECT {_SHARE} FROM ({share('h3_r7', None)})", "view"))
def focus_share_without_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 7).share())


@query(sql(f"""SELECT h3_r8 AS h3_id, count(*) AS selection_n_crimes FROM view
    WHERE {IS_PROPERTY} GROUP BY h3_r8""", "view"))
def selected_counts_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 8, categories=("Property",)).selected_counts()


_HOTSPOT = _SUMMARY + f""", common_crime, signature_street, signature_block, district_id, ward_id,
    community_area_id, incident_total, focus_count, {r6('focus_share')}, selection_n_crimes"""
_HOTSPOT_COLUMNS = [
    "h3_id", "n_crimes", "n_arrests", "low_conf_share", "smoothed_rate", "pooled_smoothed", "lat",
    "lon", "common_crime", "signature_street", "signature_block", "district_id", "ward_id",
    "community_area_id", "incident_total", "focus_count", "focus_share", "selection_n_crimes",
]
_NEEDS = ("gold", "centres", "view")


def _hotspot_sql(res: int, focus: str | None, scope: str | None = None) -> str:
    return sql(f"SELECT {_HOTSPOT} FROM ({hotspots(res, focus, scope)})", *_NEEDS)


@query(_hotspot_sql(8, None))
def hotspots_all_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 8).summary().select(*_HOTSPOT_COLUMNS))


@query(_hotspot_sql(8, IS_THEFT))
def hotspots_by_type_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 8, types=THEFTS).summary().select(*_HOTSPOT_COLUMNS))


@query(_hotspot_sql(7, IS_PROPERTY))
def hotspots_by_category_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = view(spark, sf_dir, 7, categories=("Property",))
    return rounded(chosen.summary().select(*_HOTSPOT_COLUMNS))


@query(_hotspot_sql(8, None))
def hotspots_unmatched_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category no row has is no focus at all."""
    chosen = view(spark, sf_dir, 8, categories=("Traffic",))
    return rounded(chosen.summary().select(*_HOTSPOT_COLUMNS))


@query(_hotspot_sql(8, IS_THEFT, CHILDREN))
def hotspots_drilled_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = view(spark, sf_dir, 8, drill=True, types=THEFTS)
    return rounded(chosen.summary().select(*_HOTSPOT_COLUMNS))


def _map_sql(res: int, focus: str | None) -> str:
    return f"SELECT * FROM ({hotspots(res, focus)}) ORDER BY n_crimes DESC, h3_id LIMIT 600"


@query(sql(f"SELECT {_HOTSPOT} FROM ({_map_sql(9, IS_THEFT)})", *_NEEDS))
def map_cells_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 9, types=THEFTS).map_cells().select(*_HOTSPOT_COLUMNS))


def _density_sql(res: int) -> str:
    return sql(f"""SELECT {r6('ratio', 'density_ratio')}, {res} >= 10 AND ratio < 0.2 AS too_sparse
      FROM (SELECT avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END) AS ratio FROM (
        SELECT cell, sum(n_crimes) AS n FROM daily WHERE res = {res} GROUP BY cell))""", "daily")


@query(_density_sql(10))
def density_r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.density(X.period_summary(ST.gold_rows(spark, sf_dir, 10)), 10))


@query(_density_sql(7))
def density_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.density(X.period_summary(ST.gold_rows(spark, sf_dir, 7)), 7))


@query(sql(f"""SELECT CAST(0 AS DOUBLE) AS low, {r6('high')} FROM (
    SELECT greatest(quantile_cont(n, 0.9), 0.6 * max(n), 1.0) AS high FROM (
      SELECT CAST(sum(n_crimes) AS DOUBLE) AS n FROM daily WHERE res = 8 GROUP BY cell))""", "daily"))
def colour_range_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.colour_range(X.period_summary(ST.gold_rows(spark, sf_dir, 8)), "n_crimes"))


@query(sql(f"""SELECT CAST(0 AS DOUBLE) AS low, {r6('high')} FROM (
    SELECT greatest(max(pooled_smoothed), 0.1) AS high FROM ({summary(8)}))""", "gold", "centres"))
def colour_range_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary8 = X.period_summary(ST.gold_rows(spark, sf_dir, 8))
    return rounded(X.colour_range(summary8, "pooled_smoothed"))


@query(sql(f"""SELECT {r6('avg(lat)', 'lat')}, {r6('avg(lon)', 'lon')} FROM centres
    WHERE res = 8 AND cell IN {CHILDREN}""", "centres", "daily"))
def scope_centre_drilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = view(spark, sf_dir, 8, drill=True)
    return rounded(X.scope_centre(chosen.summary(), PARENT))


# ------------------------------------------------------------------------------ row scopes

_ROWS = "datetime, primary_type, street_norm, district_id, h3_r8"
_ROW_COLUMNS = ["datetime", "primary_type", "street_norm", "district_id", "h3_r8"]


@query(sql(f"SELECT {_ROWS} FROM view WHERE {IS_THEFT} AND h3_r8 IN {CHILDREN}", "view", "daily"))
def scoped_rows_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 8, drill=True, types=THEFTS).rows().select(*_ROW_COLUMNS)


@query(sql(f"SELECT {_ROWS} FROM view WHERE h3_r8 IN {CHILDREN}", "view", "daily"))
def scoped_rows_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection without rows leaves all rows of the drilled cells."""
    return view(spark, sf_dir, 8, drill=True, types=("HOMICIDE",)).rows().select(*_ROW_COLUMNS)


@query(sql(f"SELECT {_ROWS} FROM view WHERE {IS_PROPERTY}", "view"))
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 8, categories=("Property",)).rows().select(*_ROW_COLUMNS)


@query(sql(f"SELECT DISTINCT primary_type FROM view WHERE {IS_PROPERTY}", "view"))
def focus_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 8, categories=("Property",)).focus_types()


# ------------------------------------------------------------------------------ key figures

def _daily(rows: str) -> str:
    return f"""SELECT CAST(datetime AS DATE) AS date, count(*) AS incidents,
      CAST(sum(hit) AS BIGINT) AS arrests FROM {rows} GROUP BY ALL"""


def _kpi_sql(cells: str, rows: str, focus: bool) -> str:
    lead = (
        """SELECT max(coalesce(focus_count, 0)) AS busiest_cell_count,
          arg_min(h3_id, (-coalesce(focus_count, 0), h3_id)) AS leading_cell,
          avg(focus_share) AS average_focus_share,
          arg_min(focus_share, (-coalesce(focus_count, 0), h3_id)) AS leading_share"""
        if focus else
        """SELECT max(n_crimes) AS busiest_cell_count, arg_min(h3_id, (-n_crimes, h3_id)) AS leading_cell,
          CAST(NULL AS DOUBLE) AS average_focus_share, CAST(NULL AS DOUBLE) AS leading_share"""
    )
    return f"""WITH days AS ({_daily(rows)}),
      early AS (SELECT avg(incidents) AS i, avg(arrests) AS a FROM (SELECT * FROM days ORDER BY date LIMIT 7)),
      late AS (SELECT avg(incidents) AS i, avg(arrests) AS a FROM (SELECT * FROM days ORDER BY date DESC LIMIT 7)),
      lead AS ({lead} FROM ({cells}))
    SELECT (SELECT count(*) FROM {rows}) AS total_incidents, busiest_cell_count, leading_cell,
      {r6('average_focus_share')}, {r6('leading_share')},
      (SELECT CAST(sum(arrests) AS BIGINT) FROM days) AS total_arrests,
      {r6('late.i - early.i', 'incident_trend')}, {r6('late.a - early.a', 'arrest_trend')},
      {r6('leading_share - average_focus_share', 'leading_delta')}
    FROM lead, early, late"""


@query(sql(_kpi_sql(hotspots(7, None), "view", False), *_NEEDS))
def kpis_all_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 7).kpis())


@query(sql(_kpi_sql(hotspots(9, IS_THEFT), f"(SELECT * FROM view WHERE {IS_THEFT})", True), *_NEEDS))
def kpis_focus_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 9, types=THEFTS).kpis())


@query(sql(_kpi_sql(
    hotspots(8, IS_PROPERTY, CHILDREN),
    f"(SELECT * FROM view WHERE {IS_PROPERTY} AND h3_r8 IN {CHILDREN})", True), *_NEEDS, "daily"))
def kpis_drilled_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, 8, drill=True, categories=("Property",)).kpis())


_PERCENT = "CAST(CAST(round_even(coalesce(focus_share, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


@query(sql(f"""SELECT h3_id, signature_block, n_crimes, selection_n_crimes, common_crime, district_id,
      ward_id, {_PERCENT} AS focus_share FROM (SELECT h3_id,
        coalesce(signature_block, 'UNKNOWN') AS signature_block, n_crimes, selection_n_crimes,
        coalesce(common_crime, 'UNKNOWN') AS common_crime, district_id, ward_id, focus_share
      FROM ({hotspots(9, IS_THEFT)}) ORDER BY selection_n_crimes DESC, h3_id LIMIT 20)""", *_NEEDS))
def signature_streets_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 9, types=THEFTS).signature_streets()


@query(sql(f"""SELECT h3_id, n_crimes, '- ' || CASE WHEN place IS NOT NULL THEN 'around **' || place || '**'
        WHEN district_id IS NOT NULL THEN 'in District ' || CAST(district_id AS VARCHAR) ELSE 'in this area' END
      || ' we saw **' || CAST(n_crimes AS VARCHAR) || ' incidents**; most common offense: **'
      || coalesce(nullif(common_crime, 'UNKNOWN'), 'mixed offenses') || '**'
      || CASE WHEN focus_share <> 0 THEN ' (selected crimes share ' || {_PERCENT} || ')' ELSE '' END || '.' AS line
    FROM (SELECT *, coalesce(nullif(signature_block, 'UNKNOWN'), nullif(signature_street, 'UNKNOWN')) AS place
      FROM ({hotspots(9, IS_THEFT)}) ORDER BY n_crimes DESC, h3_id LIMIT 3)""", *_NEEDS))
def narrative_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, 9, types=THEFTS).narrative()


# ---------------------------------------------------------------------------------- labels

def _title(column: str) -> str:
    return f"""array_to_string(list_transform(range(1, length({column}) + 1), lambda k:
      CASE WHEN k > 1 AND regexp_matches(substr({column}, k - 1, 1), '[A-Za-z]')
        THEN lower(substr({column}, k, 1)) ELSE upper(substr({column}, k, 1)) END), '')"""


def _label_sql(res: int, fallback: str) -> str:
    cell = f"h3_r{res}"
    modes = {
        "b": top(f"(SELECT * FROM view WHERE block_address <> 'UNKNOWN')", cell, "block_address", "v"),
        "s": top(f"(SELECT * FROM view WHERE street_norm NOT IN ('UNKNOWN', ''))", cell, "street_norm", "v"),
        "d": top("view", cell, "district_id", "v"),
        "c": top("view", cell, "community_area_id", "v"),
        "w": top("view", cell, "ward_id", "v"),
    }
    joins = " ".join(f"LEFT JOIN ({q}) {a} USING (h3_id)" for a, q in modes.items())
    fine = f"{_title('trim(b.v)')}, {_title('s.v')}, " if res >= 9 else ""
    return sql(f"""SELECT h3_id, coalesce({fine}printf('District %02d', d.v), printf('Community Area %02d', c.v),
      printf('Ward %02d', w.v), '{fallback} hotspot') AS label
      FROM (SELECT DISTINCT {cell} AS h3_id FROM view) {joins}""", "view")


@query(_label_sql(9, "Street-scale"))
def area_labels_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.area_labels(serving(spark, sf_dir), 9)


@query(_label_sql(7, "District-scale"))
def area_labels_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.area_labels(serving(spark, sf_dir), 7)


# -------------------------------------------------------------------------------- profiles

@query(sql(_daily("view"), "view"))
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_series(serving(spark, sf_dir))


@query(sql("""SELECT date, CAST(sum(n_crimes) AS BIGINT) AS incidents, CAST(sum(n_arrests) AS BIGINT) AS arrests
    FROM daily WHERE res = 9 GROUP BY date""", "daily"))
def daily_series_from_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_from_gold(ST.gold_rows(spark, sf_dir, 9))


_COUNTS = "count(*) AS incidents, CAST(sum(hit) AS BIGINT) AS arrests"


@query(sql(f"SELECT CAST(hour(datetime) AS INT) AS hour, {_COUNTS} FROM view GROUP BY ALL", "view"))
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hourly(serving(spark, sf_dir))


@query(sql(f"""SELECT CAST(hour(datetime) AS INT) AS hour, {_COUNTS} FROM view
    WHERE dayname(datetime) = 'Friday' GROUP BY ALL""", "view"))
def hourly_profile_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hourly(serving(spark, sf_dir), "Friday")


_WEEK = ", ".join(f"({k}, '{d}')" for k, d in enumerate(K.WEEKDAYS))


def _week_sql(rows: str) -> str:
    return f"""SELECT w.position, w.dow, c.incidents, coalesce(c.arrests, 0) AS arrests
      FROM (VALUES {_WEEK}) AS w(position, dow) LEFT JOIN (
        SELECT dayname(datetime) AS dow, {_COUNTS} FROM {rows} GROUP BY ALL) c USING (dow)"""


@query(sql(_week_sql("view"), "view"))
def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.weekdays(serving(spark, sf_dir))


@query(sql(_week_sql("(SELECT * FROM view WHERE dayname(datetime) = 'Sunday')"), "view"))
def weekday_profile_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without rows stay in the report."""
    return P.weekdays(P.on_weekday(serving(spark, sf_dir), "Sunday"))


@query(sql("""SELECT CAST(datetime AS DATE) AS date, coalesce(t.primary_type, 'Other') AS type_bucket,
      count(*) AS incidents FROM view v LEFT JOIN (SELECT primary_type FROM view WHERE primary_type IS NOT NULL
        GROUP BY primary_type ORDER BY count(*) DESC, primary_type LIMIT 5) t USING (primary_type)
    GROUP BY ALL""", "view"))
def offense_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offense_mix(serving(spark, sf_dir))


@query(sql("""SELECT 'Arrests' AS category, CAST(sum(hit) AS BIGINT) AS count FROM view
    UNION ALL SELECT 'No arrest', CAST(greatest(count(*) - sum(hit), 0) AS BIGINT) FROM view""", "view"))
def arrest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.arrest_outcome(serving(spark, sf_dir))


_BY_TYPE = f"""SELECT primary_type, {_COUNTS} FROM view WHERE primary_type IS NOT NULL
    GROUP BY primary_type ORDER BY incidents DESC, primary_type LIMIT 12"""


@query(sql(f"""SELECT primary_type, 'incidents' AS metric, incidents AS count FROM ({_BY_TYPE})
    UNION ALL SELECT primary_type, 'arrests', arrests FROM ({_BY_TYPE})""", "view"))
def incidents_by_offense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.by_offense(serving(spark, sf_dir))


@query(sql("""SELECT primary_type, count(*) AS incident_count FROM view WHERE primary_type IS NOT NULL
    GROUP BY primary_type ORDER BY 2 DESC, 1 LIMIT 10""", "view"))
def top_offenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_counts(serving(spark, sf_dir), "primary_type", 10)


@query(sql("""SELECT district_id, count(*) AS incidents FROM view GROUP BY district_id
    ORDER BY 2 DESC, 1 LIMIT 10""", "view"))
def top_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_counts(serving(spark, sf_dir), "district_id", 10, "incidents")


_CATEGORIES = """SELECT DISTINCT crime_category AS category, primary_type AS type
    FROM view WHERE primary_type IS NOT NULL"""


@query(sql(_CATEGORIES, "view"))
def category_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.categories(serving(spark, sf_dir))


def _options_sql(where: str) -> str:
    return sql(f"""SELECT DISTINCT 'category' AS option, category AS value FROM ({_CATEGORIES})
      WHERE category <> 'Unclassified'
      UNION ALL SELECT 'type', type FROM ({_CATEGORIES}) WHERE {where}""", "view")


@query(_options_sql("true"))
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_options(serving(spark, sf_dir))


@query(_options_sql("category IN ('Violent', 'Narcotics')"))
def filter_options_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_options(serving(spark, sf_dir), ["Violent", "Narcotics"])
