import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_assigned_cell_has_the_nearest_centre(spark):
    rng = random.Random(7)
    points = [(n, rng.uniform(41.6, 42.1), rng.uniform(-87.9, -87.5)) for n in range(400)]
    df = L.locate(spark.createDataFrame(points, "n int, latitude double, longitude double"), "i", "j")
    s = K.FINEST_RADIUS_KM
    for n, lat, lon, i, j in rows(df):
        x, y = (lon - K.CITY_CENTRE[1]) * K.KM_PER_LON, (lat - K.CITY_CENTRE[0]) * K.KM_PER_LAT

        def distance(a, b):
            return math.hypot(x - s * math.sqrt(3) * (a - b / 2), y - 1.5 * s * b)

        best = min(distance(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
        assert distance(i, j) == pytest.approx(best)
        assert distance(i, j) <= s * (1 + 1e-9)


def test_invalid_coordinates_have_no_cell(spark):
    points = [(999.0, -87.6), (None, -87.6), (41.9, None), (float("nan"), -87.6),
              (41.9, float("inf")), (39.99, -87.0), (40.0, -86.0), (43.0, -89.0)]
    df = L.assign_cells(spark.createDataFrame(points, "latitude double, longitude double"))
    got = [r["h3_r10"] is not None for r in df.collect()]
    assert got == [False] * 6 + [True] * 2
    assert [r["h3_r6"] is not None for r in df.collect()] == got


def test_every_parent_has_seven_children_and_one_centre_child(spark):
    cells = spark.range(-40, 41).select(F.col("id").alias("i")).join(
        spark.range(-40, 41).select(F.col("id").alias("j")), F.lit(True)
    )
    for child in (10, 9, 8, 7):
        up_i, up_j = L.parent(F.col("i"), F.col("j"), child)
        back_i, back_j = L.centre_child(F.col("pi"), F.col("pj"), child - 1)
        placed = cells.select("i", "j", up_i.alias("pi"), up_j.alias("pj"))
        inner = placed.where("abs(pi) <= 8 and abs(pj) <= 8").groupBy("pi", "pj").agg(
            F.count("*").alias("n"),
            F.count_if((F.col("i") == back_i) & (F.col("j") == back_j)).alias("centre"),
        )
        assert {(r["n"], r["centre"]) for r in inner.collect()} == {(7, 1)}


@pytest.mark.parametrize("k, size", [(0, 1), (1, 7), (2, 19), (3, 37)])
def test_ring_sizes(k, size):
    assert len(L.ring_offsets(k)) == size


def test_direct_placement_agrees_with_cell_centres(spark):
    """The centre of a cell lies in the cell, at every level."""
    for res in K.RESOLUTIONS:
        cells = [(f"{res}:{i}:{j}", i, j) for i in range(-3, 4) for j in range(-3, 4)]
        df = L.id_centre(spark.createDataFrame(cells, "cell string, a long, b long"), "cell")
        placed = L.locate(df.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}),
                          "i", "j", res=res)
        assert all(r["a"] == r["i"] and r["b"] == r["j"] for r in placed.collect())


def test_boundary_is_a_closed_hexagon_around_the_centre(spark):
    df = spark.createDataFrame([("9:4:-2",)], "cell string")
    centre = L.id_centre(df, "cell").first()
    points = L.boundary_points(df, "cell", 9).orderBy("vertex").collect()
    assert len(points) == 7
    assert (points[0]["lat"], points[0]["lon"]) == (points[6]["lat"], points[6]["lon"])
    for p in points:
        reach = math.hypot((p["lat"] - centre["lat"]) * K.KM_PER_LAT,
                           (p["lon"] - centre["lon"]) * K.KM_PER_LON)
        assert reach == pytest.approx(L.radius_km(9))
    # A corner is shared by three cells: points just inside belong to the cell.
    inside = [(centre["lat"] + 0.98 * (p["lat"] - centre["lat"]),
               centre["lon"] + 0.98 * (p["lon"] - centre["lon"])) for p in points]
    placed = L.locate(spark.createDataFrame(inside, "latitude double, longitude double"),
                      "i", "j", res=9)
    assert {(r["i"], r["j"]) for r in placed.collect()} == {(4, -2)}


def test_geojson(spark):
    df = spark.createDataFrame([("8:0:0", 5), ("8:1:0", 9), ("8:2:0", 1)], "cell string, n int")
    feature = json.loads(L.geojson_features(df, "cell", 8).first()["feature"])
    ring = feature["geometry"]["coordinates"][0]
    assert feature["type"] == "Feature" and feature["properties"] == {"h3_id": feature["id"]}
    assert len(ring) == 7 and ring[0] == ring[-1] and ring[0][0] < 0 < ring[0][1]
    found = L.feature_collections(df, "cell", 8).collect()
    listed = [f["id"] for r in found for f in json.loads(r["collection"])["features"]]
    assert sorted(listed) == ["8:0:0", "8:1:0", "8:2:0"]
    parents = [r["parent"] for r in found]
    assert len(parents) == len(set(parents)) and all(p.startswith("7:") for p in parents)
