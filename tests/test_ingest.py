"""Incremental loads: manifest, renewed layers, runs that die."""

import datetime as dt

from pyspark.sql import functions as F

from hexlytics import schemas as S
from hexlytics.plans import refresh as P
from hexlytics.sources import layers as T, manifest as M, raw as R
from hexlytics.sources.manifest import Store
from hexlytics.streaming import ingest as I
from tests.test_storage import MOMENTS, raw
from workload.load_queries import _put_file


def add(df, folder):
    df.coalesce(1).write.mode("append").options(**R.CSV).csv(folder)


def ids(spark, store, layer="bronze"):
    return sorted((r["id"], r["year"], r["month"]) for r in T.read_layer(spark, getattr(store, layer)).collect())


def test_growing_folder(spark, folder):
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, *MOMENTS[:2]), inbox)
    assert I.load(spark, inbox, store) == [(2023, 12), (2024, 1)]
    assert I.load(spark, inbox, store) == []
    more = raw(spark, *MOMENTS[2:])
    add(more.select(*reversed(more.columns)), inbox)
    assert I.load(spark, inbox, store) == [(2024, 1), (2024, 3)]
    back = T.read_layer(spark, store.bronze)
    assert back.count() == 4 and not {"batch", "file"} & set(back.columns)
    assert S.schema_differences(T.read_layer(spark, store.silver), S.SILVER_SCHEMA).count() == 0
    counts = I.load_quality(spark, store).agg(F.sum("total_rows"), F.sum("kept_rows")).first()
    assert tuple(counts) == (4, 4)


def test_streams_with_other_checkpoints_and_folders_neither_repeat_nor_replace(spark, folder):
    first, second, store = folder("first"), folder("second"), Store(folder("store"))
    add(raw(spark, *MOMENTS[:2]), first)
    I.follow(spark, first, store, folder("offsets"))
    I.follow(spark, first, store, folder("offsets"))
    assert len(ids(spark, store)) == 2
    add(raw(spark, "2024-02-02T00:00:00", "2024-01-09T00:00:00"), second)
    I.follow(spark, second, store, folder("offsets"))
    assert len(ids(spark, store)) == 4


def test_a_run_that_died_is_finished_by_the_next(spark, folder, monkeypatch):
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, *MOMENTS[:1]), inbox)
    I.load(spark, inbox, store)
    add(raw(spark, *MOMENTS[1:]), inbox)
    monkeypatch.setattr(M, "commit", lambda *a: 1 / 0)
    try:
        I.land(spark, [inbox], store)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert len(ids(spark, store)) == 1 and M.commits(spark, store).count() == 1
    I.land(spark, [inbox], store)  # landed again and committed, but not built
    assert len(ids(spark, store)) == 1 and M.pending(spark, store).count() == 1
    assert I.load(spark, inbox, store) == [(2024, 1), (2024, 3)]  # no news, but a batch to build
    assert len(ids(spark, store)) == 4 and M.pending(spark, store).count() == 0
    assert I.load_quality(spark, store).count() == 2


def test_a_changed_file_takes_the_place_of_its_rows_and_empty_partitions_go(spark, folder):
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, "2024-01-05T13:45:00"), inbox)
    _put_file(spark, raw(spark, "2024-01-06T01:00:00", "2024-03-01T00:00:00"), f"{inbox}/changing.csv")
    I.load(spark, inbox, store)
    before = {r[0] for r in T.read_layer(spark, store.silver).select("_metadata.file_path").distinct().collect()}
    _put_file(spark, raw(spark, "2024-04-05T01:00:00"), f"{inbox}/changing.csv")
    assert I.load(spark, inbox, store) == [(2024, 1), (2024, 3), (2024, 4)]
    assert [r[1:] for r in ids(spark, store)] == [(2024, 1), (2024, 4)]
    for layer in ("silver", "daily", "monthly", "rolling", "rolling_across", "cells"):
        months = {r["month"] for r in T.read_layer(spark, getattr(store, layer)).select("month").collect()}
        assert months == {1, 4}, layer
    assert before
    # The only row of all goes: nothing is left of its month.
    _put_file(spark, raw(spark), f"{inbox}/changing.csv")
    I.load(spark, inbox, store)
    assert {r["month"] for r in T.read_layer(spark, store.daily).select("month").collect()} == {1}


def test_untouched_months_keep_their_files(spark, folder):
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, *MOMENTS), inbox)
    I.load(spark, inbox, store)
    files = lambda: {r[0] for r in T.read_layer(spark, store.silver).select(
        "_metadata.file_path").distinct().collect()}
    before = files()
    add(raw(spark, "2024-03-09T10:00:00"), inbox)
    I.load(spark, inbox, store)
    assert {p for p in before if "month=3" not in p} == {p for p in files() if "month=3" not in p}
    assert T.read_layer(spark, store.daily).where("res = 9 and month = 3").agg(F.sum("n_crimes")).first()[0] == 2


def test_rolling_sums_over_month_ends_reach_the_next_months(spark, folder):
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, "2024-02-10T00:00:00", "2024-03-01T00:00:00"), inbox)
    I.load(spark, inbox, store)
    add(raw(spark, "2024-01-31T00:00:00"), inbox)
    assert I.load(spark, inbox, store) == [(2024, 1)]
    rows = T.read_layer(spark, store.rolling_across).select("date", "rolling_n_14", "rolling_n_30").collect()
    assert {r[0]: r[1:] for r in rows} == {
        dt.date(2024, 1, 31): (1, 1), dt.date(2024, 2, 10): (2, 2), dt.date(2024, 3, 1): (1, 2)}


def test_months_that_a_halo_reaches():
    assert P.reached([(2024, 1)], 0) == [(2024, 1)]
    assert P.reached([(2023, 1)], 29) == [(2023, 1), (2023, 2), (2023, 3)]
    assert P.reached([(2024, 1)], 29) == [(2024, 1), (2024, 2)]
    assert P.reached([(2024, 1)], -29) == [(2023, 12), (2024, 1)]


def test_listing_reads_no_contents(spark, folder):
    inbox = folder("inbox")
    add(raw(spark, *MOMENTS), inbox)
    plan = M.listing(spark, [inbox])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_landed_rows_stay_where_they_lie(spark, folder):
    """The manifest goes to the rows: no shuffle between landing and bronze."""
    inbox, store = folder("inbox"), Store(folder("store"))
    add(raw(spark, *MOMENTS), inbox)
    I.load(spark, inbox, store)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (M.counting_rows(spark, store), M.landed(spark, store)):
            text = rows._jdf.queryExecution().executedPlan().toString()
            above = text.split("FileScan")[0]
            assert "BroadcastHashJoin" in above and "Exchange" not in above
            assert rows.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
