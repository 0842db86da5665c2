import datetime as dt

from pyspark.sql import functions as F

from hexlytics.operators import sketches as K


def test_merged_sketches_equal_one_over_all_rows(spark):
    rows = spark.range(60_000).selectExpr("id % 30 AS day", "id % 17011 AS v")
    days = K.sketched(rows, ["day"], F.col("v"))
    whole = K.estimated(K.merged(days, []), "n").first()["n"]
    assert abs(whole - 17011) <= 4 * K.DEVIATION * 17011
    assert K.estimated(K.sketched(rows, [], F.col("v")), "n").first()["n"] == whole


def test_nulls_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "g string, v string")
    found = {r["g"]: r["n"] for r in K.estimated(K.sketched(rows, ["g"], F.col("v")), "n").collect()}
    assert found == {"a": 1, "b": 0}


def test_streets_of_parent_cells_need_no_second_scan(spark):
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame(
        [("9:0:0", day, "A"), ("9:1:0", day, "A"), ("9:1:0", day + dt.timedelta(1), "B"), (None, day, "C")],
        "h3_r9 string, date date, street_norm string")
    up = K.parents_of(K.merged(K.street_sketches(rows), ["cell"]), 9)
    assert [tuple(r) for r in K.estimated(up, "n").collect()] == [("8:0:0", 2)]
