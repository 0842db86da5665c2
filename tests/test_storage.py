import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexlytics import schemas as S
from hexlytics.operators import quality as Q
from hexlytics.plans.bronze import bronze
from hexlytics.plans.silver import silver
from hexlytics.session import open_writers
from hexlytics.sources import layers as T, raw as R


def raw(spark, *moments):
    names = S.RAW_SCHEMA.names
    rows = [tuple({"id": f"{n}", "date": m, "year": m[:4], "latitude": "41.9", "longitude": "-87.6",
                   "description": 'said "hi", left', "block": " 012XX A ", "primary_type": "THEFT"
                   }.get(c) for c in names) for n, m in enumerate(moments)]
    return spark.createDataFrame(rows, S.RAW_SCHEMA)


MOMENTS = ("2023-12-31T23:00:00", "2024-01-05T13:45:00", "2024-01-06T01:00:00", "2024-03-01T00:00:00")


def test_raw_files_round_trip(spark, folder):
    path, df = folder("raw"), raw(spark, *MOMENTS)
    R.write_raw_by_year(df, path)
    assert sorted(map(tuple, R.read_raw(spark, path).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str)


def test_columns_are_found_by_name_in_any_order(spark, folder):
    path, df = folder("raw"), raw(spark, *MOMENTS)
    names = list(reversed(df.columns))
    df.limit(2).write.options(**R.CSV).csv(f"{path}/a")
    rest = df.exceptAll(df.limit(2)).drop("case_number").withColumn("remark", F.lit("x"))
    rest.select("remark", *[c for c in names if c != "case_number"]).write.options(**R.CSV).csv(
        f"{path}/b")
    back = R.read_raw(spark, [f"{path}/a", f"{path}/b"])
    assert back.columns == S.RAW_SCHEMA.names
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert bronze(back).count() == 4


def test_header_names():
    assert R.header_columns('\ufeffid,"a, b",,id') == ["id", "a, b", "_c2", "id_3"]


def test_headers_are_read_without_the_rest(spark, folder):
    """The rest of the compressed file is damaged, so reading on would fail."""
    import gzip
    import os

    path = folder("long").removeprefix("file:")
    os.makedirs(f"{path}/below")
    lines = "".join(f"{k},{k * k % 9973}\n" for k in range(300_000))
    for name, header in (("a.csv", "date,id"), ("below/b c%20.csv", "id,date")):
        with open(f"{path}/{name}", "w") as f:
            f.write(header + "\n" + lines)
    packed = bytearray(gzip.compress(b"id,date\n" + lines.encode()))
    packed[len(packed) // 2:] = b"\xff" * (len(packed) - len(packed) // 2)
    with open(f"{path}/c.csv.gz", "wb") as f:
        f.write(packed)
    with open(f"{path}/empty.csv", "w"):
        pass
    groups = R._by_header(spark, [path], False)
    assert [(c, [f.rsplit("/", 1)[1] for f in files]) for c, files in groups] == [
        (["date", "id"], ["a.csv"]), (["id", "date"], ["b c%20.csv", "c.csv.gz"])]
    both = R.read_by_header(spark, [f"{path}/a.csv", f"{path}/below"])
    assert both.count() == 600_000 and both.where("id = '7'").count() > 0


def test_monthly_files_match_columns_by_name_and_skip_the_unreadable(spark, folder):
    import os

    a, b, c = folder("m1"), folder("m2"), folder("m3")
    df = raw(spark, *MOMENTS).select("id", "date", "block")
    df.limit(1).write.options(**R.CSV).csv(a)
    df.select("block", "id").limit(2).write.options(**R.CSV).csv(b)
    plain = c.removeprefix("file:")
    os.makedirs(plain)
    with open(f"{plain}/empty.csv", "w"):
        pass
    with open(f"{plain}/broken.csv.gz", "wb") as f:
        f.write(b"this is not gzip")
    out = R.read_monthly_raw(spark, [a, f"{c}/empty.csv", b, f"{c}/broken.csv.gz", f"{c}/absent.csv"])
    assert out.count() == 3 and out.where("date is null").count() == 2
    assert {r["block"] for r in out.collect()} == {" 012XX A "}
    with pytest.raises(ValueError):
        R.read_monthly_raw(spark, [])
    with pytest.raises(ValueError):
        R.read_monthly_raw(spark, [f"{c}/absent.csv", f"{c}/empty.csv"])


def test_layers_round_trip_strict_and_lenient(spark, folder):
    b, s = folder("bronze"), folder("silver")
    T.write_bronze(bronze(raw(spark, *MOMENTS)), b)
    T.write_silver(silver(T.read_layer(spark, b)), s)
    back = T.read_layer(spark, s, 2024, [1], strict=True)
    assert back.count() == 2 and S.schema_differences(back, S.SILVER_SCHEMA).count() == 0
    assert back.schema["h3_r9"].metadata["h3_resolutions"] == "6,7,8,9,10"
    assert T.read_layer(spark, s, 2024, [2]).count() == 0
    with pytest.raises(FileNotFoundError, match=r"\[2\]"):
        T.read_layer(spark, s, 2024, [1, 2], strict=True)
    assert T.read_layer(spark, folder("nowhere")) is None
    with pytest.raises(Exception):
        T.read_layer(spark, folder("nowhere"), strict=True)
    assert T.read_layer(spark, s, start_year=2024).count() == 3
    plan = T.read_layer(spark, s, 2024, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_rewriting_a_month_leaves_the_others(spark, folder):
    path = folder("bronze")
    T.write_bronze(bronze(raw(spark, *MOMENTS)), path)
    T.write_bronze(bronze(raw(spark, "2024-01-20T00:00:00")), path)
    spark.catalog.refreshByPath(path)
    got = {(r["year"], r["month"]): r["count"] for r in
           T.read_layer(spark, path).groupBy("year", "month").count().collect()}
    assert got == {(2023, 12): 1, (2024, 1): 1, (2024, 3): 1}


def test_gold_and_map_readers(spark, folder):
    path = folder("gold")
    with pytest.raises(FileNotFoundError):
        T.read_gold(spark, path, 9)
    assert T.read_gold(spark, path, 9, strict=False) is None
    assert T.read_drill_map(spark, path, 8, 9).columns == ["parent", "child"]
    df = spark.createDataFrame([(9, 2024, 1, "9:0:0", dt.date(2024, 1, 1)), (8, 2024, 1, "8:0:0", dt.date(2024, 1, 1))],
                               "res int, year int, month int, cell string, date date")
    T.write_gold(df, path)
    assert T.read_gold(spark, path, 9, 2024, 1).first()["h3_r9"] == "9:0:0"


def test_serving_view_fallbacks(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, "THEFT", "1 A ST", 1)],
                               "datetime timestamp_ntz, arrest boolean, crime_type string, block string, month int")
    r = T.serving_view(df).first()
    assert (r["arrest_made"], r["primary_type"], r["street_norm"], r["block_address"]) == (
        False, "THEFT", "1 A ST", "1 A ST")


def test_month_arguments():
    assert R.normalize_months(3) == (3,) and R.normalize_months("4") == (4,)
    assert R.normalize_months({5, 1}) == (1, 5) and R.normalize_months(m for m in (2, 1)) == (1, 2)


def test_work_list_and_pending_months(spark):
    span = spark.sql("SELECT DATE'2023-11-15' a, DATE'2024-02-01' b")
    work = R.month_work_list(span, "a", "b")
    got = [(r["year"], r["month"], str(r["starts"]), str(r["ends"])) for r in work.orderBy("starts").collect()]
    assert got[0] == (2023, 11, "2023-11-01", "2023-12-01")
    assert got[1] == (2023, 12, "2023-12-01", "2024-01-01") and len(got) == 4
    done = spark.createDataFrame([(2024, 1)], "year int, month int")
    years = spark.createDataFrame([(2023,)], "year int")
    assert [tuple(r)[:2] for r in R.pending_months(work, done, years).collect()] == [(2024, 2)]
    assert R.pending_months(work, done).count() == 3


def test_manifest_and_size_reports(spark, folder):
    path = folder("bronze")
    T.write_bronze(bronze(raw(spark, *MOMENTS)), path)
    stored = T.read_layer(spark, path)
    expected = spark.createDataFrame([(2024, 1), (2024, 2)], "year int, month int")
    rows = {r["month"]: r for r in Q.partition_manifest(
        spark, path, "bronze", expected=expected).collect()}
    assert rows[1]["rows"] == 2 and rows[1]["exists"] and not rows[1]["h3_r9"]
    assert rows[2]["error"] == "missing partition" and rows[2]["rows"] is None
    size = Q.layer_size(spark, path, "bronze").first()
    assert size["files"] == stored.select("_metadata.file_path").distinct().count()
    both = Q.size_reduction(spark, path, f"{path}/year=2024").first()
    assert both["bytes_before"] == size["bytes"] > both["bytes_after"] > 0


def test_sizes_come_from_the_listing(spark, folder):
    import os

    path = folder("plain")
    os.makedirs(f"{path.removeprefix('file:')}/part=1")
    for name, content in (("part=1/a.csv", b"x" * 70), ("b.csv", b"y" * 30), ("c.csv", b""),
                          ("_SUCCESS", b"zz")):
        with open(f"{path.removeprefix('file:')}/{name}", "wb") as f:
            f.write(content)
    size = Q.layer_size(spark, path, "raw").first()
    assert (size["files"], size["bytes"]) == (2, 100)
    assert Q.size_reduction(spark, path, f"{path}/part=1").first()["reduction_percent"] == 30.0


def test_manifest_has_columns_and_errors_per_file(spark, folder):
    path = folder("silver")
    rows = bronze(raw(spark, *MOMENTS))
    T.write_silver(silver(rows.where("month <> 3")), path)
    T.write_bronze(rows.where("month = 3"), path)
    with open(path.removeprefix("file:") + "/year=2024/month=1/broken.parquet", "wb") as f:
        f.write(b"not parquet at all")
    found = Q.partition_manifest(spark, path, "silver").collect()
    good = [r for r in found if r["error"] is None]
    assert {(r["month"], r["h3_r9"]) for r in good} == {(12, True), (1, True), (3, False)}
    bad = [r for r in found if r["error"] is not None]
    assert len(bad) == 1 and bad[0]["path"].endswith("broken.parquet") and bad[0]["month"] == 1


def test_year_and_coordinate_reports(spark):
    df = raw(spark, *MOMENTS)
    report = Q.rows_per_year(df, bronze(df).where("month <> 3"), F.col("year").cast("int"), F.col("year"))
    got = {r["year"]: (r["raw_count"], r["kept_count"], r["drop_percent"]) for r in report.collect()}
    assert got[2023] == (1, 1, 0.0) and got[2024] == (3, 2, pytest.approx(100 / 3))


def test_tasks_write_without_sorting_their_rows(spark, folder, monkeypatch):
    """Plans inside ``open_writers`` have no sort; the writers of layers and raw files use it."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.sql(f"CREATE TABLE written (id long, year int) USING parquet PARTITIONED BY (year) LOCATION '{folder('w')}'")
    text = "EXPLAIN INSERT INTO written SELECT id, CAST(id % 90 AS INT) FROM range(1000)"
    try:
        assert "Sort" in spark.sql(text).first()[0]
        with pytest.raises(ZeroDivisionError), open_writers(spark):
            assert "Sort" not in spark.sql(text).first()[0]
            1 / 0
        with open_writers(spark):  # more partitions than open files
            spark.sql("INSERT INTO written SELECT id, CAST(id % 90 AS INT) FROM range(0, 1000, 1, 1)")
        assert spark.table("written").groupBy("year").count().where("count >= 11").count() == 90
    finally:
        spark.sql("DROP TABLE written")
    assert spark.conf.get(key, None) == before

    seen = []
    for module in (T, R):
        monkeypatch.setattr(module, "open_writers", lambda s, m=module: seen.append(m) or open_writers(s))
    df = raw(spark, *MOMENTS)
    R.write_raw_by_year(df, folder("raw"))
    T.write_silver(silver(bronze(df)), folder("silver"))
    assert seen == [R, T]
