import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexlytics.functions import features as X, rates as R


def one(spark, column, schema, *values):
    df = spark.createDataFrame([(v,) for v in values], f"v {schema}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_street_names(spark):
    texts = ["012XX W SOME ST", "045XX N OTHER AVE", "1000 E MAIN RD", "00XX N X", " 012XX A",
             None, "00000XX 12 w elm ", "012XX 1000 N BOTH"]
    assert one(spark, X.street_name, "string", *texts) == [
        "W SOME ST", "N OTHER AVE", "E MAIN RD", "00XX N X", "012XX A", "", "00000XX 12 W ELM",
        "N BOTH"]


def test_cyclic_codes(spark):
    df = spark.createDataFrame([(h,) for h in (0, 6, 12, 18, 23)], "h int")
    sin, cos = X.cyclic(F.col("h"), 24)
    got = df.select("h", sin.alias("s"), cos.alias("c")).collect()
    assert (got[0]["s"], got[0]["c"]) == (0.0, 1.0)
    assert got[1]["s"] == pytest.approx(1.0) and got[2]["c"] == pytest.approx(-1.0)


def test_categories(spark):
    values = ["THEFT", " battery ", "Non-Criminal", "NON - CRIMINAL", "STALKING", "", None]
    assert one(spark, X.category_of, "string", *values) == [
        "Property", "Violent", "Disorder", "Disorder", "Unclassified", "Unclassified",
        "Unclassified"]


def test_title_case_restarts_after_any_non_letter(spark):
    assert one(spark, X.title_case, "string", "012XX W SOME ST", "o'hare-DUNNING", "", None) == [
        "012Xx W Some St", "O'Hare-Dunning", "", None]


def test_tolerant_casts(spark):
    texts = ["11", "011", "11.0", "11.5", "x", "", None]
    assert one(spark, lambda c: X.tolerant_cast(c, "bigint"), "string", *texts) == [
        11, 11, 11, None, None, None, None]
    assert one(spark, lambda c: X.tolerant_cast(c, "boolean"), "string", "True", "false", "maybe") == [
        True, False, None]


def test_moments(spark):
    texts = ["2024-01-05T13:45:00", "2024-01-05T13:45:00.000", "2024-01-05", "01/05/2024 12:30:00 AM",
             "01/05/2024 12:30:00 PM", "01/05/2024 11:30:00 PM", "not a date", "13/45/2024 01:00:00 AM",
             None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r["m"] for r in X.with_moment(df, "t", "m").orderBy("n").collect()]
    assert got == [
        dt.datetime(2024, 1, 5, 13, 45), dt.datetime(2024, 1, 5, 13, 45), dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 5, 0, 30), dt.datetime(2024, 1, 5, 12, 30),
        dt.datetime(2024, 1, 5, 23, 30), None, None, None]


def test_arrest_spellings(spark):
    df = spark.createDataFrame([(v,) for v in ("true", "True", "1", "no", None)], "a string")
    assert [r[0] for r in df.select(X.arrest_flag(df, "a")).collect()] == [1, 1, 1, 0, 0]
    yes = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    assert [r[0] for r in yes.select(X.arrest_flag(yes, "a")).collect()] == [1, 0, 0]


def test_wilson_and_smoothing(spark):
    df = spark.createDataFrame([(0, 0), (0, 4), (4, 4), (3, 10)], "k long, n long")
    low, high = R.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("a"), high.alias("b"),
                    R.smoothed(F.col("k"), F.col("n"), F.lit(0.5)).alias("s"),
                    R.raw_rate(F.col("k"), F.col("n")).alias("r"),
                    R.safe_rate(F.col("k"), F.col("n")).alias("q")).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.5, 0.0, None)
    assert got[1]["a"] == 0.0 and got[2]["b"] == 1.0
    # Wilson interval of 3 in 10 at 95%, a textbook value.
    assert (round(got[3]["a"], 4), round(got[3]["b"], 4)) == (0.1078, 0.6032)
    assert got[3]["s"] == pytest.approx((2.5 + 3) / 15)
