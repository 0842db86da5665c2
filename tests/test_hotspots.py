import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexlytics.functions import lattice as L
from hexlytics.operators import context as X, profiles as P
from hexlytics.plans.gold import gold_daily
from hexlytics.plans.hotspots import Drill, HotspotView
from hexlytics.session import scratch_path

# Two r8 cells under one r7 parent and one far away.
PLACES = {"a": "9:0:0", "b": "9:3:0", "far": "9:40:10"}


@pytest.fixture(scope="module")
def rows(spark):
    centres = {r["cell"]: (r["lat"], r["lon"]) for r in L.id_centre(
        spark.createDataFrame([(c,) for c in PLACES.values()], "cell string"), "cell").collect()}
    out = []

    def add(place, day, offense, arrest, block, district, times=1):
        lat, lon = centres[PLACES[place]]
        for _ in range(times):
            out.append((dt.datetime(2024, 1, day, 10), offense, "Property", block and ("" if block == "UNKNOWN" else block[6:]), block,
                        arrest, 7, district, 2, lat, lon, dt.date(2024, 1, day)))

    add("a", 1, "THEFT", True, "012XX W OAK ST", 5, 3)
    add("a", 2, "ASSAULT", False, "012XX W OAK ST", 5, 2)
    add("a", 9, None, False, None, None)
    add("b", 3, "THEFT", False, "UNKNOWN", 11, 4)
    add("far", 4, "ARSON", True, "0x0x0x place", 11, 6)
    schema = ("datetime timestamp_ntz, primary_type string, crime_category string, street_norm string,"
              " block_address string, arrest_made boolean, community_area_id long, district_id long,"
              " ward_id long, latitude double, longitude double, date date")
    path = scratch_path(spark, "rows")
    L.assign_cells(spark.createDataFrame(out, schema)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def gold(spark, rows):
    path = scratch_path(spark, "gold")
    gold_daily(rows).coalesce(1).write.partitionBy("res").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def view(rows, gold):
    def make(res=9, **choice):
        return HotspotView(rows, gold.where(F.col("res") == res), res, **choice)

    return make


def drill(spark, *children, parent="8:0:0"):
    return Drill(8, parent, spark.createDataFrame([(c,) for c in children], "child string"))


def cells(df):
    return {r["h3_id"]: r for r in df.collect()}


def test_context_prefers_the_smaller_value_on_ties_and_marks_unknown_text(spark):
    df = spark.createDataFrame(
        [("c", "B", 10), ("c", "A", 9), ("d", None, 4), ("d", None, 4)],
        "h3_r9 string, primary_type string, ward_id long")
    got = cells(X.build_context(df, "h3_r9"))
    assert (got["c"]["common_crime"], got["c"]["common_crime_count"], got["c"]["ward_id"]) == ("A", 1, 9)
    assert (got["d"]["common_crime"], got["d"]["common_crime_count"], got["d"]["ward_id"]) == ("UNKNOWN", None, 4)


def test_summary_with_focus(view):
    got = cells(view(types=("THEFT",)).summary())
    a, far = got[PLACES["a"]], got[PLACES["far"]]
    assert (a["n_crimes"], a["focus_count"], a["focus_share"], a["selection_n_crimes"]) == (6, 3, 0.5, 3)
    assert (far["focus_share"], far["selection_n_crimes"], far["common_crime"]) == (0.0, 0, None)


def test_summary_without_focus(view):
    got = cells(view().summary())
    assert {r["focus_share"] for r in got.values()} == {1.0}
    assert all(r["selection_n_crimes"] == r["n_crimes"] for r in got.values())


def test_rows_fall_back_from_children_to_parent_to_all(spark, rows, view):
    def count(**choice):
        return view(**choice).rows().count()

    inside = drill(spark, PLACES["a"])
    assert count() == 16 and count(types=("THEFT",)) == 7
    assert count(types=("THEFT",), drill=inside) == 3
    # Nothing selected anywhere: the drilled cells keep all rows.
    assert count(types=("HOMICIDE",), drill=inside) == 6
    # Selected elsewhere but not here: the parent's rows, selection or not.
    parent = rows.where(F.col("h3_r9") == PLACES["a"]).first()["h3_r8"]
    own = rows.where(F.col("h3_r8") == parent).count()
    assert count(types=("ARSON",), drill=drill(spark, PLACES["a"], parent=parent)) == own
    # The parent has no rows either: all rows.
    assert count(types=("ARSON",), drill=drill(spark, PLACES["a"], parent="8:99:99")) == 16
    # No cell of the drill is shown at all: nothing.
    assert count(drill=drill(spark, "9:99:99")) == 0


def test_kpis(view):
    r = view(types=("THEFT",)).kpis().first()
    assert (r["total_incidents"], r["busiest_cell_count"], r["leading_cell"]) == (7, 4, PLACES["b"])
    assert r["leading_share"] == 1.0 and r["average_focus_share"] == pytest.approx(0.5)
    assert r["leading_delta"] == pytest.approx(0.5) and r["total_arrests"] == 3
    # Two days only: both means are over all days.
    assert (r["incident_trend"], r["arrest_trend"]) == (0.0, 0.0)
    plain = view().kpis().first()
    assert (plain["total_incidents"], plain["busiest_cell_count"], plain["total_arrests"]) == (16, 6, 9)
    assert plain["leading_cell"] == min(PLACES["a"], PLACES["far"]) and plain["leading_share"] is None


def test_trend_compares_first_and_last_week(spark):
    days = [(dt.datetime(2024, 1, d), d <= 2) for d in range(1, 11) for _ in range(d)]
    df = spark.createDataFrame(days, "datetime timestamp_ntz, arrest_made boolean")
    got = HotspotView(df, df, 9).trend().first()
    assert got["incident_trend"] == pytest.approx(7.0 - 4.0)
    assert got["arrest_trend"] == pytest.approx(0.0 - 3 / 7)


def test_map_is_limited_at_fine_levels_without_a_drill(spark, rows, view):
    assert view(map_limit=2).map_cells().count() == 2
    assert view(map_limit=2, drill=drill(spark, *PLACES.values())).map_cells().count() == 3
    assert view(res=7, map_limit=1).map_cells().count() == rows.select("h3_r7").distinct().count()


def test_area_labels(rows):
    got = {r["h3_id"]: r["label"] for r in X.area_labels(rows, 9).collect()}
    assert got[PLACES["a"]] == "012Xx W Oak St"
    # Unknown block: the street, which is blank here, then the district.
    assert got[PLACES["b"]] == "District 11"
    # A placeholder block names no place: the street is used.
    assert got[PLACES["far"]] == " Place".title()
    coarse = {r["label"] for r in X.area_labels(rows.drop("district_id"), 7).collect()}
    assert coarse == {"Community Area 07"}
    bare = rows.drop("district_id", "community_area_id", "ward_id")
    assert {r["label"] for r in X.area_labels(bare, 7).collect()} == {"District-scale hotspot"}


def test_narrative_lines(spark):
    df = spark.createDataFrame(
        [("x", 9, "UNKNOWN", None, "THEFT", 4, 0.125), ("y", 7, "A ST", "B", "UNKNOWN", 4, 0.0),
         ("z", 5, None, None, None, None, None), ("w", 1, "Q", "Q", "Q", 1, 1.0)],
        "h3_id string, n_crimes long, signature_block string, signature_street string,"
        " common_crime string, district_id long, focus_share double")
    lines = [r["line"] for r in X.narrative(df).orderBy(F.col("n_crimes").desc()).collect()]
    assert lines == [
        "- in District 4 we saw **9 incidents**; most common offense: **THEFT** (selected crimes share 12%).",
        "- around **A ST** we saw **7 incidents**; most common offense: **mixed offenses**.",
        "- in this area we saw **5 incidents**; most common offense: **mixed offenses**."]


def test_colour_ranges(spark):
    df = spark.createDataFrame([(float(n), n / 1000) for n in range(11)], "n_crimes double, focus_share double")
    assert X.colour_range(df, "n_crimes").first()["high"] == 9.0
    assert X.colour_range(df, "focus_share").first()["high"] == 0.1
    zero = spark.createDataFrame([(0.0, 0.0)], "n_crimes double, focus_share double")
    assert X.colour_range(zero, "n_crimes").first()["high"] == 1.0
    assert tuple(X.colour_range(df.limit(0), "n_crimes").first()) == (0.0, 1.0)
    assert tuple(X.colour_range(df.limit(0), "focus_share").first()) == (0.0, 1.0)


def test_density_of_an_empty_frame(spark):
    empty = spark.createDataFrame([], "n_crimes long")
    assert tuple(X.density(empty, 10).first()) == (0.0, True)


def test_scope_centre_fallbacks(spark):
    empty = spark.createDataFrame([], "lat double, lon double")
    assert X.scope_centre(empty).first()["lat"] == pytest.approx(41.881832)
    drilled = X.scope_centre(empty, "8:2:1").first()
    want = L.id_centre(spark.createDataFrame([("8:2:1",)], "c string"), "c").first()
    assert tuple(drilled) == (want["lat"], want["lon"])


def test_period_summary_without_rate_columns(spark):
    df = spark.createDataFrame([("9:0:0", 2, 1, True), ("9:0:0", 4, 0, False)],
                               "cell string, n_crimes long, n_arrests long, low_conf boolean")
    r = X.period_summary(df).first()
    assert (r["n_crimes"], r["n_arrests"], r["low_conf_share"], r["smoothed_rate"]) == (6, 1, 0.5, None)


def test_null_types_count_as_other(spark, rows):
    mix = P.offense_mix(rows, top=1).where("type_bucket = 'Other'").agg(F.sum("incidents")).first()[0]
    assert mix == 16 - 7


def test_profiles(rows):
    assert {r["dow"]: r["incidents"] for r in P.weekdays(rows).collect()}["Sunday"] is None
    assert [r["count"] for r in P.arrest_outcome(rows).orderBy("category").collect()] == [9, 7]
    assert P.hourly(rows, "Monday").first()["incidents"] == 3
    top = [tuple(r) for r in P.top_counts(rows, "district_id", 2).collect()]
    assert top == [(11, 10), (5, 5)]
    long = {(r["primary_type"], r["metric"]): r["count"] for r in P.by_offense(rows).collect()}
    assert long["THEFT", "incidents"] == 7 and long["THEFT", "arrests"] == 3
    no_flag = P.daily_series(rows.drop("arrest_made")).agg(F.sum("arrests")).first()[0]
    assert no_flag == 0
