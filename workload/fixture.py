"""Raw incident rows derived from the test tables, as one SQL text for both engines.

``events`` gives dense days of one month, ``orders`` spans many months. All 22 raw columns are
text, as in a CSV file, with the faults real files have: no or far coordinates, unreadable
dates and numbers, nulls, blanks, lower case, two date formats, unmapped offense types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexlytics import schemas as S

OFFENSES = [
    "THEFT", "BATTERY", "NARCOTICS", "BURGLARY", "ASSAULT", "CRIMINAL DAMAGE",
    "MOTOR VEHICLE THEFT", "ROBBERY", "DECEPTIVE PRACTICE", "WEAPONS VIOLATION",
    "OTHER OFFENSE", "PUBLIC PEACE VIOLATION", "NON - CRIMINAL", "STALKING", " arson ", None,
]

SPARK = {
    "iso": "date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "us": "date_format({at}, 'MM/dd/yyyy hh:mm:ss a')",
    "shift": "{at} + make_dt_interval(0, {h}, {m}, 0)",
}
DUCKDB = {
    "iso": "strftime({at}, '%Y-%m-%dT%H:%M:%S')",
    "us": "strftime({at}, '%m/%d/%Y %I:%M:%S %p')",
    "shift": "{at} + to_hours({h}) + to_minutes({m})",
}


def _offense_case() -> str:
    whens = " ".join(
        f"WHEN {k} THEN '{name}'" for k, name in enumerate(OFFENSES) if name is not None
    )
    return f"CASE (n * n + u) % {len(OFFENSES)} {whens} ELSE NULL END"


def raw_sql(dialect: dict[str, str], events: str = "events", orders: str = "orders") -> str:
    iso, us = dialect["iso"].format(at="moment"), dialect["us"].format(at="moment")
    shifted = dialect["shift"].format(
        at="o_orderdate", h="CAST(o_orderkey % 24 AS INT)", m="CAST(o_orderkey % 60 AS INT)"
    )
    return f"""
SELECT
  concat(tag, CAST(n AS STRING)) AS id,
  concat('C', tag, CAST(n % 5000 AS STRING)) AS case_number,
  CASE WHEN n % 59 = 0 THEN 'not a date' WHEN n % 61 = 0 THEN {us} ELSE {iso} END AS date,
  CASE WHEN n % 29 = 0 THEN NULL WHEN n % 31 = 0 THEN '1000 E MAIN RD'
    WHEN n % 37 = 0 THEN ' 012XX N side ST'
    ELSE concat(lpad(CAST(u % 90 + 1 AS STRING), 3, '0'), 'XX W STREET ', CAST(u % 40 AS STRING))
    END AS block,
  lpad(CAST(u % 2000 AS STRING), 4, '0') AS iucr,
  {_offense_case()} AS primary_type,
  CASE WHEN n % 53 = 0 THEN NULL ELSE concat('DESC ', CAST(u % 9 AS STRING)) END AS description,
  CASE WHEN n % 11 = 0 THEN NULL WHEN u % 4 = 0 THEN 'STREET' WHEN u % 4 = 1 THEN 'ALLEY'
    ELSE 'RESIDENCE' END AS location_description,
  CASE WHEN n % 17 = 0 THEN NULL WHEN hit THEN 'true' ELSE 'false' END AS arrest,
  CASE WHEN n % 43 = 0 THEN 'maybe' WHEN u % 7 = 0 THEN 'True' ELSE 'False' END AS domestic,
  CASE WHEN n % 19 = 0 THEN NULL ELSE CAST(u % 300 + 100 AS STRING) END AS beat,
  CASE WHEN n % 23 = 0 THEN NULL ELSE lpad(CAST(u % 25 + 1 AS STRING), 3, '0') END AS district,
  CASE WHEN n % 67 = 0 THEN 'x' ELSE concat(CAST(u % 50 + 1 AS STRING), '.0') END AS ward,
  CASE WHEN n % 13 = 0 THEN NULL ELSE CAST(u % 77 + 1 AS STRING) END AS community_area,
  lpad(CAST(u % 27 AS STRING), 2, '0') AS fbi_code,
  CASE WHEN n % 47 = 0 THEN NULL ELSE CAST(1100000 + la AS STRING) END AS x_coordinate,
  CASE WHEN n % 47 = 0 THEN NULL ELSE CAST(1800000 + lo AS STRING) END AS y_coordinate,
  CAST(year(moment) AS STRING) AS year,
  {iso} AS updated_on,
  CASE WHEN n % 97 = 0 THEN NULL WHEN n % 101 = 0 THEN '44.5' WHEN n % 103 = 0 THEN '42.8'
    ELSE concat(substr(CAST(416500 + 4 * la AS STRING), 1, 2), '.',
                substr(CAST(416500 + 4 * la AS STRING), 3, 4)) END AS latitude,
  CASE WHEN n % 109 = 0 THEN 'abc'
    ELSE concat('-', substr(CAST(878500 - 4 * lo AS STRING), 1, 2), '.',
                substr(CAST(878500 - 4 * lo AS STRING), 3, 4)) END AS longitude,
  concat('(', CAST(la AS STRING), ', ', CAST(lo AS STRING), ')') AS location
FROM (
  SELECT *,
    CASE WHEN n % 5 = 0 THEN 577 + n % 3 ELSE (u * 7919 + (n % 13) * 31) % 1000 END AS la,
    CASE WHEN n % 5 = 0 THEN 567 + n % 2 ELSE (u * 104729 + (n % 11) * 17) % 1000 END AS lo
  FROM (
    SELECT 'E' AS tag, event_id AS n, user_id AS u, ts AS moment, value > 60 AS hit FROM {events}
    UNION ALL
    SELECT 'O' AS tag, o_orderkey AS n, o_custkey AS u, {shifted} AS moment,
      o_totalprice > 250000 AS hit FROM {orders}
  ) AS base
) AS placed
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = raw_sql(SPARK, "{events}", "{orders}")
    rows = spark.sql(
        text, events=table(spark, sf_dir, "events"), orders=table(spark, sf_dir, "orders")
    )
    return rows.select(*S.RAW_SCHEMA.names)
