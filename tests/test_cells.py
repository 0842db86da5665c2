import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hexlytics.functions import lattice as L
from hexlytics.operators import cells as C
from hexlytics.plans.gold import gold_daily, gold_monthly, gold_rolling, rolled_across
from hexlytics.plans.refresh import cells_by_month
from hexlytics.session import scratch_path

D = dt.date


def test_daily_and_monthly_counts(spark):
    rows = [("A", D(2023, 1, 1), True), ("A", D(2023, 1, 1), False), ("B", D(2023, 1, 2), True),
            (None, D(2023, 1, 2), True)]
    df = spark.createDataFrame(rows, "cell_id string, date date, arrest_made boolean")
    daily = C.daily_counts(df, "cell_id")
    assert {tuple(r) for r in daily.collect()} == {
        ("A", D(2023, 1, 1), 2, 1), ("B", D(2023, 1, 2), 1, 1)}
    monthly = C.monthly_counts(daily, ["cell"])
    assert {tuple(r) for r in monthly.collect()} == {
        ("A", D(2023, 1, 1), 2, 1), ("B", D(2023, 1, 1), 1, 1)}


def test_counts_without_an_arrest_column(spark):
    df = spark.createDataFrame([("A", D(2023, 1, 1))], "cell_id string, date date")
    assert C.daily_counts(df, "cell_id").first()["n_arrests"] == 0


@pytest.fixture(scope="module")
def incidents(spark):
    """A hot cell with a third of all rows, and others around it, over three months."""
    rng = random.Random(3)
    out = []
    for n in range(600):
        hot = n % 3 == 0
        lat = 41.88 if hot else 41.88 + rng.uniform(-0.02, 0.02)
        lon = -87.62 if hot else -87.62 + rng.uniform(-0.02, 0.02)
        day = D(2023, 1, 1) + dt.timedelta(days=rng.randrange(80))
        out.append((f"i{n}", lat, lon, day, rng.choice([True, False, None]),
                    rng.choice(["THEFT", "ARSON", None]), rng.choice(["W A", "N B", "E C", None])))
    schema = ("id string, latitude double, longitude double, date date, arrest_made boolean,"
              " crime_type string, street_norm string")
    path = scratch_path(spark, "incidents")
    L.assign_cells(spark.createDataFrame(out, schema)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_levels_agree_with_direct_counts(spark, incidents):
    levels = C.daily_levels(incidents)
    for res in (6, 8, 10):
        direct = {tuple(r) for r in C.daily_counts(incidents, f"h3_r{res}").collect()}
        rolled = levels.where(F.col("res") == res).select(
            L.cell_id(F.col("res"), F.col("i"), F.col("j")), "date", "n_crimes", "n_arrests")
        assert {tuple(r) for r in rolled.collect()} == direct


@pytest.mark.parametrize("k", [1, 2])
def test_pooling_against_brute_force(incidents, k):
    daily = C.daily_levels(incidents, (8, 9))
    counts = {(r["res"], r["i"], r["j"], r["date"]): (r["n_crimes"], r["n_arrests"])
              for r in daily.collect()}
    pooled = C.pooled_counts(daily, k).collect()
    assert len(pooled) == len(counts)
    for r in pooled:
        around = [counts.get((r["res"], r["i"] + a, r["j"] + b, r["date"]), (0, 0))
                  for a, b in L.ring_offsets(k)]
        assert (r["pooled_n"], r["pooled_k"]) == tuple(map(sum, zip(*around)))
        assert (r["n_crimes"], r["n_arrests"]) == counts[r["res"], r["i"], r["j"], r["date"]]


def test_gold_invariants(incidents):
    gold = gold_daily(incidents).cache()
    bad = gold.where(
        (F.col("ci_low") < 0) | (F.col("ci_low") > F.col("raw_rate"))
        | (F.col("raw_rate") > F.col("ci_high")) | (F.col("ci_high") > 1)
        | (F.col("pooled_n") < F.col("n_crimes")) | (F.col("pooled_k") < F.col("n_arrests")))
    assert bad.count() == 0
    per_level = {r["res"]: r["n"] for r in
                 gold.groupBy("res").agg(F.sum("n_crimes").alias("n")).collect()}
    assert set(per_level.values()) == {600} and set(per_level) == {6, 7, 8, 9, 10}
    monthly = gold_monthly(gold_daily(incidents)).groupBy("res").agg(F.sum("n_crimes").alias("n"))
    assert {r["n"] for r in monthly.collect()} == {600}


def test_unpooled_gold_has_constants(incidents):
    gold = gold_daily(incidents, levels=(8,), pool_k=0)
    assert gold.where("pooled_n <> 0 or pooled_k <> 0 or pooled_smoothed <> smoothed_rate").count() == 0
    assert gold.select("year", "month", "pooled_rate").distinct().count() == 3


def test_profile_and_rolling_against_brute_force(incidents):
    rows = incidents.select("h3_r9", "date", "arrest_made", "crime_type", "street_norm").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["h3_r9"], r["date"]), []).append(r)
    counts = {key: len(v) for key, v in groups.items()}
    out = gold_rolling(incidents, 9).collect()
    assert len(out) == len(groups)
    for r in out:
        key = (r["cell"], r["date"])
        mine = groups[key]
        types = Counter(x["crime_type"] for x in mine if x["crime_type"])
        best = min(types, key=lambda t: (-types[t], t)) if types else None
        assert r["n_crimes"] == len(mine) and r["top_crime_type"] == best
        assert r["unique_streets"] == len({x["street_norm"] for x in mine if x["street_norm"]})
        assert r["n_arrests"] == sum(x["arrest_made"] is True for x in mine)
        for w in (7, 14, 30):
            days = [key[1] - dt.timedelta(days=d) for d in range(w)]
            same = [d for d in days if (d.year, d.month) == (key[1].year, key[1].month)]
            assert r[f"rolling_n_{w}"] == sum(counts.get((key[0], d), 0) for d in same)
        assert r["rolling_n_7"] <= r["rolling_n_14"] <= r["rolling_n_30"]


def test_generated_ids_count_every_row(spark, incidents):
    no_id = incidents.drop("id", "crime_type", "street_norm")
    assert C.daily_profile(no_id, 8).agg(F.sum("n_crimes")).first()[0] == 600
    assert C.daily_profile(no_id, 8).where("top_crime_type is not null or unique_streets > 0").count() == 0


def test_dense_days_fill_gaps_within_a_month(spark):
    daily = spark.createDataFrame(
        [("A", D(2023, 1, 30), 2), ("A", D(2023, 2, 2), 1), ("A", D(2023, 2, 4), 3)],
        "cell string, date date, n_crimes long")
    got = sorted((r["date"], r["n_crimes"]) for r in C.dense_days(daily).collect())
    assert got == [(D(2023, 1, 30), 2), (D(2023, 2, 2), 1), (D(2023, 2, 3), 0), (D(2023, 2, 4), 3)]


def test_drill_map_children_have_their_parent(incidents):
    cells = C.daily_levels(incidents).select("res", "i", "j")
    mapping = C.drill_map(cells)
    assert {(r[0], r[1]) for r in mapping.select("parent_res", "child_res").distinct().collect()} == {
        (6, 7), (7, 8), (8, 9), (9, 10)}
    expected = {(r[0], r[1]) for r in incidents.select("h3_r8", "h3_r9").distinct().collect()}
    pairs = mapping.where("parent_res = 8")
    assert {(r["parent"], r["child"]) for r in pairs.collect()} == expected
    sizes = mapping.groupBy("parent").count().agg(F.max("count")).first()[0]
    assert sizes <= 7


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pooling_sends_each_row_to_lattice_lines(spark, k):
    """2k + 1 messages a row, with repeated and null keys, against sums over all pairs."""
    rng = random.Random(k)
    rows = [(res, rng.randrange(-6, 6), rng.randrange(-6, 6), rng.choice([D(2023, 1, 1), D(2023, 1, 2), None]),
             rng.randrange(1, 9), rng.randrange(3)) for res in (9, 10) for _ in range(60)]
    rows += [(9, None, 1, D(2023, 1, 1), 5, 1), (9, 1, None, D(2023, 1, 1), 5, 1), rows[0], rows[1]]
    daily = spark.createDataFrame(rows, "res int, i bigint, j bigint, date date, n_crimes bigint, n_arrests bigint")
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    expected = {}
    for res, i, j, date, *_ in known:
        near = [r for r in known if (r[0], r[3]) == (res, date)
                and max(abs(r[1] - i), abs(r[2] - j), abs((r[1] - i) - (r[2] - j))) <= k]
        mine = [r for r in near if (r[1], r[2]) == (i, j)]
        expected[res, i, j, date] = (max(r[4] for r in mine), max(r[5] for r in mine),
                                     sum(r[4] for r in near), sum(r[5] for r in near))
    pooled = C.pooled_counts(daily, k)
    got = pooled.select("res", "i", "j", "date", "n_crimes", "n_arrests", "pooled_n", "pooled_k").collect()
    assert len(got) == len(expected) and {tuple(r)[:4]: tuple(r)[4:] for r in got} == expected
    text = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert f"explode([{','.join(map(str, range(-k, k + 1)))}])" in text.replace(" ", "")


def test_pooling_multiplies_rows_after_the_shuffle(spark):
    daily = spark.createDataFrame(
        [(9, i, i % 7, D(2023, 1, 1), 1, 0) for i in range(-40, 40)],
        "res int, i bigint, j bigint, date date, n_crimes bigint, n_arrests bigint")
    text = C.pooled_counts(daily)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.replace(" ", "").index("explode([-1,0,1])") < text.replace(
        " ", "").index("Exchangehashpartitioning(res")


def test_layers_that_follow_from_earlier_ones(incidents):
    """Sums over month ends from the table with sums inside months, the drill map's pairs from months."""
    kept = ["cell", "date", "n_crimes", "n_arrests", "unique_streets", "top_crime_type", "arrest_rate",
            "rolling_n_7", "rolling_n_14", "rolling_n_30", "res", "year", "month"]
    rows = lambda df: Counter(tuple(r) for r in df.select(*kept).collect())
    assert rows(rolled_across(gold_rolling(incidents))) == rows(gold_rolling(incidents, across_months=True))
    monthly = gold_monthly(gold_daily(incidents)).localCheckpoint()
    pairs = cells_by_month(monthly)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text
    assert {tuple(r) for r in pairs.select("child_res", "parent_res", "parent", "child").collect()} == {
        tuple(r) for r in C.drill_map(C.daily_levels(incidents)).collect()}


def test_daily_gold_counts_its_cells_once(incidents):
    """Pooling and priors read one exchange of the counts of all levels."""
    gold = gold_daily(incidents)
    run = gold._jdf.queryExecution().executedPlan()
    run.executeCollect()
    text = run.toString().split("== Initial Plan ==")[0]
    assert len([x for x in text.splitlines() if "Exchange hashpartitioning(res" in x and ", j#" in x
                and "ReusedExchange" not in x]) == 1
