"""Quality reports and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics import schemas as S
from hexlytics.functions.features import with_moment
from hexlytics.functions import lattice as L
from hexlytics.operators import clustering as G, hierarchy as H, quality as Q
from hexlytics.plans.bronze import typed
from hexlytics.session import scratch_path
from hexlytics.sources import layers as T, raw as R
from workload import stored as ST
from workload.fixture import raw_incidents
from workload.oracle import sql
from workload.registry import query, r6, rounded


@query(sql("""SELECT 'silver' AS layer, year, month, count(*) AS rows, true AS "exists", true AS h3_r7,
    true AS h3_r8, true AS h3_r9 FROM l2 GROUP BY year, month""", "l2"))
def silver_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Q.partition_manifest(spark, ST.silver_path(spark, sf_dir), "silver")
    return files.groupBy("layer", "year", "month", "exists", "h3_r7", "h3_r8", "h3_r9").agg(
        F.sum("rows").alias("rows")
    )


@query(sql("""SELECT 'gold' AS layer, CAST(res AS INT) AS res, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
    CAST(count(*) AS BIGINT) AS rows FROM daily GROUP BY ALL""", "daily"))
def gold_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    T.write_report(Q.partition_manifest(spark, ST.gold_path(spark, sf_dir), "gold"), path)
    report = spark.read.option("header", True).csv(path)
    return report.groupBy("layer", *[F.col(k).cast("int").alias(k) for k in ("res", "year", "month")]).agg(
        F.sum(F.col("rows").cast("bigint")).alias("rows")
    )


@query(sql("""SELECT CAST(w.year AS INT) AS year, CAST(w.month AS INT) AS month, count(l.id) > 0 AS "exists",
      CASE WHEN count(l.id) = 0 THEN 'missing partition' END AS error
    FROM (SELECT y AS year, m AS month FROM (SELECT unnest(range(a, b + 1)) AS y FROM (
        SELECT min(year) - 1 AS a, max(year) + 1 AS b FROM l2)) CROSS JOIN range(1, 13) r(m)) w
    LEFT JOIN l2 l ON l.year = w.year AND l.month = w.month GROUP BY ALL""", "l2"))
def missing_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month from the year before the first incident to the year after the last."""
    span = ST.silver_rows(spark, sf_dir).agg(
        F.make_date(F.min("year") - 1, F.lit(1), F.lit(1)).alias("a"),
        F.make_date(F.max("year") + 1, F.lit(12), F.lit(1)).alias("b"))
    expected = R.month_work_list(span, "a", "b")
    found = Q.partition_manifest(
        spark, ST.silver_path(spark, sf_dir), "silver", expected=expected)
    return found.select("year", "month", "exists", "error").distinct()


@query("SELECT 'a' AS column, 'b' AS expected, 'c' AS found WHERE false")
def silver_schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, read back, compare with the declared schema: no differences."""
    return S.schema_differences(ST.silver_rows(spark, sf_dir), S.SILVER_SCHEMA)


@query(sql("""SELECT d.*, (SELECT count(*) FROM l2) AS rows FROM (VALUES
    ('extra', CAST(NULL AS VARCHAR), 'int'), ('hour', 'int', 'string'),
    ('street_norm', 'string', CAST(NULL AS VARCHAR))) AS d("column", expected, found)""", "l2"))
def schema_differences_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column dropped, one of another type, one too many, in a table written and read back."""
    path = scratch_path(spark, "planted")
    silver = ST.silver_rows(spark, sf_dir)
    silver.drop("street_norm").withColumn("hour", F.col("hour").cast("string")).withColumn(
        "extra", F.lit(1)).write.parquet(path)
    stored = spark.read.parquet(path)
    rows = stored.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return S.schema_differences(stored, S.SILVER_SCHEMA).withColumn("rows", rows)


@query(sql(f"""SELECT year, raw_count, coalesce(kept_count, 0) AS kept_count,
      raw_count - coalesce(kept_count, 0) AS dropped_count,
      {r6('100.0 * (raw_count - coalesce(kept_count, 0)) / raw_count', 'drop_percent')} FROM (
      SELECT CAST(year AS INT) AS year, count(*) AS raw_count FROM raw GROUP BY ALL)
    LEFT JOIN (SELECT year, count(*) AS kept_count FROM l1 GROUP BY year) USING (year)""", "raw", "l1"))
def rows_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, kept = ST.raw_rows(spark, sf_dir), ST.bronze_rows(spark, sf_dir)
    return rounded(Q.rows_per_year(raw, kept, F.col("year").cast("int"), F.col("year")))


@query(sql(f"""SELECT *, {r6('100.0 * out_of_bounds / valid_coordinates', 'out_of_bounds_percent')} FROM (
      SELECT incident_year AS year, count(*) AS total_records,
        count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS valid_coordinates,
        count(*) FILTER (WHERE latitude BETWEEN 41.0 AND 42.5 AND longitude BETWEEN -88.5 AND -87.0) AS in_bounds,
        count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (
          latitude BETWEEN 41.0 AND 42.5 AND longitude BETWEEN -88.5 AND -87.0)) AS out_of_bounds
      FROM typed GROUP BY incident_year)""", "typed"))
def coordinate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(ST.raw_rows(spark, sf_dir))
    return rounded(Q.coordinate_report(rows, F.col("incident_year")))


def _csv_bytes(columns: list[str]) -> str:
    """Bytes of a row's CSV line."""
    return " + ".join(
        f"""CASE WHEN {c} IS NULL THEN 0 WHEN {c} = '' THEN 2 ELSE strlen({c})
          + CASE WHEN contains({c}, ',') THEN 2 ELSE 0 END END""" for c in columns
    ) + f" + {len(columns)}"


@query(sql(f"""SELECT count(*) AS rows, CAST(sum({_csv_bytes(S.RAW_SCHEMA.names)}) AS BIGINT) AS bytes
    FROM raw""", "raw"))
def raw_csv_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the raw CSV files without their header lines, as written."""
    path = scratch_path(spark, "raw-bytes")
    R.write_raw_by_year(raw_incidents(spark, sf_dir), path)
    lines = spark.read.text(path).where(F.col("value") != ",".join(S.RAW_SCHEMA.names))
    return lines.agg(F.count(F.lit(1)).alias("rows"),
                     F.sum(F.octet_length("value") + 1).alias("bytes"))


@query()
def storage_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as raw CSV and as bronze parquet."""
    path = scratch_path(spark, "raw-size")
    R.write_raw_by_year(raw_incidents(spark, sf_dir), path)
    return Q.size_reduction(spark, path, ST.bronze_path(spark, sf_dir))


_PLACED = ["id", "date", "primary_type", "latitude", "longitude"]


@query(sql(f"""SELECT *, {r6('100.0 * (bytes_before - bytes_after) / bytes_before', 'reduction_percent')},
      100.0 * (bytes_before - bytes_after) / bytes_before BETWEEN 60 AND 80 AS in_documented_range
    FROM (SELECT CAST(sum({_csv_bytes(S.RAW_SCHEMA.names)}) AS BIGINT) AS bytes_before,
      CAST(sum({_csv_bytes(_PLACED)}) AS BIGINT) AS bytes_after FROM raw)""", "raw"))
def storage_reduction_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all raw columns and of five of them, as CSV files without header lines."""
    rows, paths = raw_incidents(spark, sf_dir), []
    for columns in (S.RAW_SCHEMA.names, _PLACED):
        paths.append(scratch_path(spark, "csv-size"))
        rows.select(*columns).write.options(**{**R.CSV, "header": False}).csv(paths[-1])
    return rounded(Q.size_reduction(spark, *paths))


_CYCLES = " UNION ALL ".join(
    f"""SELECT '{name}' AS cycle, 2 * sin(pi() * {near} / {period}) AS near_distance,
      abs(2 * sin(pi() * {far} / {period})) AS far_distance"""
    for name, period, near, far in (("hour", 24, 2, 11), ("day_of_week", 7, 1, 3), ("month", 12, 1, 6))
)


@query(f"""SELECT cycle, {r6('near_distance')}, {r6('far_distance')}, near_distance < far_distance AS valid
    FROM ({_CYCLES})""")
def cyclic_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the codes stored in silver; the expected ones are chord lengths."""
    return rounded(Q.cyclic_continuity(ST.silver_rows(spark, sf_dir)))


@query(sql(f"""SELECT DISTINCT day_of_week AS step, (day_of_week + 1) % 7 AS next_step,
    {r6('2 * sin(pi() / 7)', 'distance')} FROM l2""", "l2"))
def weekday_step_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.step_distances(ST.silver_rows(spark, sf_dir), "day_of_week", 7))


@query(sql(f"""SELECT 'h3_r' || r AS level, {r6('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)', 'success_rate')}
    FROM (SELECT latitude BETWEEN 40.0 AND 43.0 AND longitude BETWEEN -89.0 AND -86.0 AS ok FROM typed)
    CROSS JOIN range(6, 11) g(r) GROUP BY r""", "typed"))
def cell_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all typed rows, those with missing or far coordinates included."""
    from hexlytics.functions.lattice import assign_cells

    rows = typed(ST.raw_rows(spark, sf_dir)).select("latitude", "longitude")
    return rounded(Q.cell_success(assign_cells(rows)))


@query(sql("SELECT id, datetime FROM typed", "typed"))
def parsed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_moment(ST.raw_rows(spark, sf_dir).select("id", "date"), "date", "datetime").drop("date")


# -------------------------------------------------------------------------------- clusters

_REGIONS = """/*RECURSIVE*/WITH busy AS (SELECT i, j, cell, CAST(sum(n_crimes) AS BIGINT) AS n FROM daily WHERE res = 7 GROUP BY ALL),
  dense AS (SELECT * FROM busy WHERE n >= 15),
  reach(i, j, i0, j0) AS (
    SELECT i, j, i, j FROM dense
    UNION SELECT d.i, d.j, r.i0, r.j0 FROM reach r JOIN dense d
      ON greatest(abs(d.i - r.i), abs(d.j - r.j), abs((d.i - r.i) - (d.j - r.j))) = 1),
  labelled AS (SELECT i, j, min((i0, j0)) AS first FROM reach GROUP BY i, j),
  sized AS (SELECT first, sum(n) AS size FROM labelled JOIN dense USING (i, j) GROUP BY first)
  SELECT b.cell, b.n AS n_crimes, coalesce(CASE WHEN s.size >= 50 THEN
      l.first[1] * 4294967296 + l.first[2] + 2147483648 END, -1) AS cluster
  FROM busy b LEFT JOIN labelled l USING (i, j) LEFT JOIN sized s ON s.first = l.first"""


@query(sql(_REGIONS, "daily"))
def hotspot_regions_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent busy cells joined to regions."""
    counts = ST.gold_rows(spark, sf_dir, 7).groupBy("cell").agg(F.sum("n_crimes").alias("n_crimes"))
    return G.hotspot_regions(counts, "cell", min_cell=15)


# Highest level that joins each peak with each bin: the best path's lowest count.
_PEAKS = """/*RECURSIVE*/WITH busy AS (SELECT i, j, cell, CAST(sum(n_crimes) AS BIGINT) AS n FROM daily WHERE res = {res} GROUP BY ALL),
  side AS (SELECT a.i, a.j, a.n, b.i AS bi, b.j AS bj, b.n AS bn FROM busy a JOIN busy b
    ON greatest(abs(a.i - b.i), abs(a.j - b.j), abs((a.i - b.i) - (a.j - b.j))) = 1),
  peak AS (SELECT * FROM busy ANTI JOIN (SELECT DISTINCT i, j FROM side WHERE (bn, -bi, -bj) > (n, -i, -j)) USING (i, j)),
  path(pi, pj, i, j, level) AS (
    SELECT i, j, i, j, n FROM peak
    UNION SELECT p.pi, p.pj, s.bi, s.bj, least(p.level, s.bn) FROM path p JOIN side s ON s.i = p.i AND s.j = p.j),
  joined AS (SELECT pi, pj, i, j, max(level) AS level FROM path GROUP BY ALL),
  met AS (SELECT p.i, p.j, p.n, p.cell, max(g.level) FILTER (WHERE (b.n, -b.i, -b.j) > (p.n, -p.i, -p.j)) AS level
    FROM peak p JOIN joined g ON g.pi = p.i AND g.pj = p.j JOIN busy b ON b.i = g.i AND b.j = g.j GROUP BY ALL),
  tree AS (SELECT m.cell, m.i, m.j, m.n, m.level, CAST(coalesce(sum(b.n) FILTER (WHERE g.level > m.level), 0) AS BIGINT) AS mass
    FROM met m JOIN joined g ON g.pi = m.i AND g.pj = m.j JOIN busy b ON b.i = g.i AND b.j = g.j GROUP BY ALL)
"""


def _busy_bins(spark: SparkSession, sf_dir: str, res: int) -> DataFrame:
    cells = ST.gold_rows(spark, sf_dir, res).groupBy("cell").agg(F.sum("n_crimes").alias("n"))
    return cells.select(L.id_part(F.col("cell"), 2).alias("i"), L.id_part(F.col("cell"), 3).alias("j"), "n")


@query(sql(_PEAKS.format(res=7) + "SELECT cell, n AS peak, level, mass FROM tree WHERE level IS NOT NULL", "daily"))
def density_tree_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every peak of the map that meets a higher one, and where."""
    tree = H.merge_tree(H.basins(_busy_bins(spark, sf_dir, 7)))
    return tree.select(
        L.cell_id(7, -F.col("at.i"), -F.col("at.j")).alias("cell"), F.col("at.n").alias("peak"), "level", "mass")


@query(sql(_PEAKS.format(res=7) + """, kept AS (SELECT * FROM tree WHERE level IS NULL OR (mass >= 50 AND n >= 1.5 * level)),
  floored AS (SELECT k.i, k.j, max(g.level) FILTER (WHERE o.i IS NOT NULL AND (o.i, o.j) <> (k.i, k.j)) AS floor
    FROM kept k JOIN joined g ON g.pi = k.i AND g.pj = k.j LEFT JOIN kept o ON o.i = g.i AND o.j = g.j GROUP BY ALL),
  part AS (SELECT f.i AS pi, f.j AS pj, g.i, g.j FROM floored f JOIN joined g ON g.pi = f.i AND g.pj = f.j
    WHERE g.level > coalesce(f.floor, -1)),
  sized AS (SELECT pi, pj FROM part JOIN busy USING (i, j) GROUP BY pi, pj HAVING sum(n) >= 50)
  SELECT cell, n AS n_crimes, coalesce(s.pi * 4294967296 + s.pj + 2147483648, -1) AS cluster
  FROM busy b LEFT JOIN (part JOIN sized USING (pi, pj)) s USING (i, j)""", "daily"))
def density_clusters_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the map by the density hierarchy: thin ones beside thick ones."""
    labelled = H.density_clusters(_busy_bins(spark, sf_dir, 7), prominence=1.5)
    return labelled.select(
        L.cell_id(7, F.col("i"), F.col("j")).alias("cell"), F.col("n").alias("n_crimes"), "cluster")


@query(sql("""SELECT year, month, CAST(count(*) AS BIGINT) AS rows, true AS large
    FROM l2 WHERE h3_r9 IS NOT NULL GROUP BY ALL""", "l2"))
def incident_density_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the clusters of incidents by density: a month keeps its rows, clusters have 50 or more."""
    rows = ST.silver_rows(spark, sf_dir).where("h3_r9 IS NOT NULL")
    sizes = G.density_incidents(rows, "h3_r9").groupBy("year", "month", "cluster").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("cluster") != -1
    return sizes.groupBy("year", "month").agg(
        F.sum("n").alias("rows"), F.coalesce(F.min(F.when(named, F.col("n"))) >= 50, F.lit(True)).alias("large"))


_Z = ", ".join(
    f"""round(CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.0
      ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END, 5) + CAST(0 AS DOUBLE) AS z_{c}"""
    for c in S.CYCLIC_COLUMNS)


@query(sql(f"""SELECT year, month, {', '.join(f"round({c}, 5) + CAST(0 AS DOUBLE) AS {c}" for c in S.CYCLIC_COLUMNS)},
      {', '.join(f"z_{c}" for c in S.CYCLIC_COLUMNS)}, count(*) AS n
    FROM (SELECT *, {_Z} FROM l2 WINDOW w AS (PARTITION BY year, month)) GROUP BY ALL""", "l2"))
def standardised_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct code tuples of each month, standardised over the month's incidents."""
    rows = ST.silver_rows(spark, sf_dir)
    columns, by = S.CYCLIC_COLUMNS, ("year", "month")
    scaled = G.standardised(G.code_counts(rows, columns, by), columns, by)
    return rounded(scaled, 5)


@query(sql("SELECT res, year, month, count(*) AS incidents FROM (SELECT 9 AS res, year, month FROM l2) GROUP BY ALL",
           "l2"))
def cluster_table_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cluster table holds every incident, by level, year and month."""
    stored = spark.read.parquet(_cluster_table(spark, sf_dir))
    return stored.groupBy("res", "year", "month").agg(F.count(F.lit(1)).alias("incidents"))


def _cluster_table(spark: SparkSession, sf_dir: str) -> str:
    rows = ST.silver_rows(spark, sf_dir).select("year", "month", "h3_r9", *S.CYCLIC_COLUMNS)
    path = scratch_path(spark, "clusters")
    clusters = G.cluster_incidents(rows, "h3_r9").withColumn("res", F.lit(9))
    T.write_partitioned(clusters, path, ["res", "year", "month"])
    return path


@query()
def incident_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of each month's cyclic codes, stored and read back."""
    stored = spark.read.parquet(_cluster_table(spark, sf_dir))
    return stored.groupBy("year", "month", "cluster").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_distinct("h3_r9").alias("cells")
    )
