import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexlytics import constants as K, schemas as S
from hexlytics.operators import cleaning as C
from hexlytics.plans.bronze import bronze
from hexlytics.plans.silver import canonical, silver


def raw(spark, *rows):
    names = S.RAW_SCHEMA.names
    base = {"date": "2024-01-05T13:45:00", "latitude": "41.9", "longitude": "-87.6",
            "primary_type": "THEFT", "arrest": "true", "domestic": "false"}
    data = [tuple({**base, **r}.get(c) for c in names) for r in rows]
    return spark.createDataFrame(data, S.RAW_SCHEMA)


def test_bronze_keeps_dated_rows_in_the_box_edges_included(spark):
    df = bronze(raw(
        spark, {"id": "ok"}, {"id": "nodate", "date": "soon"}, {"id": "nolat", "latitude": None},
        {"id": "far", "latitude": "42.51"}, {"id": "edge", "latitude": "42.5", "longitude": "-88.5"},
        {"id": "text", "longitude": "abc"}))
    assert {r["id"] for r in df.collect()} == {"ok", "edge"}
    assert df.schema.names == S.BRONZE_SCHEMA.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in S.BRONZE_SCHEMA]


def test_unknown_columns_go_and_missing_ones_are_tolerated(spark):
    df = spark.createDataFrame([("a", "2024-01-05", "41.9", "-87.6", "x")],
                               "id string, date string, latitude string, longitude string, extra string")
    out = bronze(df)
    assert out.columns == ["id", "created_date", "latitude", "longitude", "datetime", "year", "month"]
    assert out.count() == 1


def test_mode_fill_per_month_smallest_on_ties_zero_without_values(spark):
    def row(n, month, district, ward=None):
        return (n, dt.datetime(2024, month, 3), 41.9, -87.6, district, ward, 2024, month)

    rows = [row(1, 1, 5), row(2, 1, 3), row(3, 1, None), row(4, 2, 9), row(5, 2, None), row(6, 2, 7),
            row(7, 2, 7), row(8, 3, None)]
    df = spark.createDataFrame(rows, "n int, datetime timestamp_ntz, latitude double, longitude double,"
                                     " district_id long, ward_id long, year int, month int")
    got = {r["n"]: (r["district_id"], r["ward_id"]) for r in C.fill_ids(df).collect()}
    assert got[3] == (3, 0) and got[5] == (7, 0) and got[8] == (0, 0) and got[1] == (5, 0)


def test_text_fill_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(None, None, None)], "block_address string, case_number string, arrest_made boolean")
    assert tuple(C.fill_text(df).first()) == ("UNKNOWN", None, None)


def test_load_quality_counts(spark):
    named = C.known_columns(C.standard_names(raw(
        spark, {"id": "1"}, {"id": "2", "date": "x"}, {"id": "3", "latitude": None, "arrest": "maybe"})))
    q = C.load_quality(C.with_datetime(C.standard_types(named))).first()
    assert (q["total_rows"], q["null_datetime"], q["null_coordinates"], q["kept_rows"]) == (3, 1, 1, 1)
    assert q["dropped_percent"] == pytest.approx(200 / 3)
    failures = {r["column"]: r["failures"] for r in C.cast_failures(named).collect()}
    assert failures["arrest_made"] == 1 and failures["latitude"] == 0


def test_silver_schema_and_nullable_booleans(spark):
    out = silver(bronze(raw(spark, {"id": "1", "arrest": None, "block": "012XX W SOME ST"},
                            {"id": "2", "primary_type": None})))
    assert out.schema.names == S.SILVER_SCHEMA.names
    assert S.schema_differences(out, S.SILVER_SCHEMA).count() == 0
    first = out.where("id = '1'").first()
    assert first["arrest_made"] is None and first["street_norm"] == "W SOME ST"
    assert (first["hour"], first["day_of_week"], first["is_weekend"]) == (13, 4, False)
    assert first["crime_category"] == "Property" and first["beat_id"] == 0
    assert out.where("id = '2'").first()["crime_category"] == "Unclassified"


def test_canonical_types_of_a_loose_frame(spark):
    rows = [(dt.datetime(2023, 1, 1, 12), "9:1:2", "true", "123", "0.5"),
            (dt.datetime(2023, 1, 2, 13), None, None, "x", "z")]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, h3_index string, arrest_made string,"
                                     " beat_id string, hour_sin string")
    out = canonical(df, 9)
    assert dict(out.dtypes)["beat_id"] == "bigint" and dict(out.dtypes)["hour_sin"] == "double"
    a, b = out.orderBy("datetime").collect()
    assert (a["h3_r9"], a["arrest_made"], a["beat_id"], a["hour_sin"], a["street_norm"]) == (
        "9:1:2", True, 123, 0.5, None)
    assert (b["h3_r9"], b["arrest_made"], b["beat_id"], b["hour_sin"]) == (None, None, None, None)
    assert (a["year"], a["month"], a["day_of_week"], a["hour"]) == (2023, 1, 6, 12)


def test_category_table_is_complete():
    types = [t for ts in K.CATEGORY_TYPES.values() for t in ts]
    assert len(types) == len(set(types)) == 33
    assert len(K.RAW_COLUMNS) == 22


def test_step_functions_keep_rows(spark):
    df = raw(spark, {"id": "1"}).select("id", "date")
    assert C.standard_names(df).columns == ["id", "created_date"]
    assert C.with_datetime(df.drop("date")).select(F.col("datetime").isNull()).first()[0]
