import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlytics import schemas as S
from hexlytics.functions.lattice import ring_offsets
from hexlytics.operators import clustering as G


def components(cells):
    """Union by search."""
    left, out = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            i, j = stack.pop()
            part.add((i, j))
            for a, b in ring_offsets(1):
                if (i + a, j + b) in left:
                    left.remove((i + a, j + b))
                    stack.append((i + a, j + b))
        out.append(part)
    return out


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_connected_labels(spark, shape):
    if shape == "random":
        rng = random.Random(23)
        cells = {(rng.randrange(-12, 12), rng.randrange(-12, 12)) for _ in range(190)}
    else:
        cells = {(n, 0) for n in range(-60, 60)} | {(200, n) for n in range(30)}
    df = spark.createDataFrame(sorted(cells), "i long, j long")
    got = {}
    for r in G.connected_labels(df).collect():
        got.setdefault(r["label"], set()).add((r["i"], r["j"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, components(cells)))


def test_components_stay_within_their_group(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 9, 9)],
                               "g int, i long, j long")
    got = {}
    for r in G.connected_labels(df, ["g"]).collect():
        got.setdefault((r["g"], r["label"]), set()).add((r["i"], r["j"]))
    assert sorted(map(sorted, got.values())) == [
        [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(9, 9)]]


def test_small_regions_and_thin_bins_are_noise(spark):
    rows = [(0, 0, 40), (1, 0, 30), (5, 5, 49), (9, 9, 2), (2, 0, 3)]
    df = spark.createDataFrame(rows, "i long, j long, n long")
    got = {(r["i"], r["j"]): r["cluster"] for r in G.dense_regions(df, F.col("n") >= 5).collect()}
    assert got[0, 0] == got[1, 0] != -1
    assert got[5, 5] == got[9, 9] == got[2, 0] == -1


def test_standardised_columns_use_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a_sin double, a_cos double")
    rows = G.standardised(G.code_counts(df, ["a_sin", "a_cos"]), ["a_sin", "a_cos"]).collect()
    mean, var = 4 / 3, (1 + 9 + 0) / 3 - (4 / 3) ** 2
    assert sorted(r["z_a_sin"] for r in rows) == pytest.approx(
        sorted((v - mean) / var**0.5 for v in (1.0, 3.0, 0.0)))
    assert {r["z_a_cos"] for r in rows} == {0.0}


def _codes(n=240):
    rng = random.Random(2)
    return [(2024, 1 + k % 2, "9:0:0",
             *([round(rng.gauss(4, 0.05) if k % 4 < 2 else rng.gauss(-4, 0.05), 3)
                for _ in S.CYCLIC_COLUMNS])) for k in range(n)]


def test_embedding_agrees_with_a_plain_decomposition(spark):
    df = spark.createDataFrame(_codes(), ["year", "month", "h3_r9", *S.CYCLIC_COLUMNS])
    columns = list(S.CYCLIC_COLUMNS)
    out = G.embedding(G.code_counts(df, columns), columns).toPandas()
    x = np.repeat(out[columns].to_numpy(), out["n"], axis=0)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    point = np.repeat(out[["embed_x", "embed_y"]].to_numpy(), out["n"], axis=0)
    assert np.allclose(point.var(0), values[::-1][:2])
    for k in range(2):
        direction = vectors[:, -1 - k]
        direction = direction * np.sign(direction[np.argmax(np.abs(direction))])
        assert np.allclose(z @ direction, point[:, k])


def test_incident_clusters_cover_every_row(spark):
    df = spark.createDataFrame(_codes(480), ["year", "month", "h3_r9", *S.CYCLIC_COLUMNS])
    out = G.cluster_incidents(df, "h3_r9", bin_radius=0.5)
    sizes = {(r["month"], r["cluster"]): r["count"]
             for r in out.groupBy("month", "cluster").count().collect()}
    assert sum(sizes.values()) == 480
    assert sorted((m, v) for (m, c), v in sizes.items() if c != -1) == [
        (1, 120), (1, 120), (2, 120), (2, 120)]
    few = G.cluster_incidents(df, "h3_r9", bin_radius=0.5, min_size=121)
    assert few.select(F.max("cluster")).first()[0] == -1


def test_twice_the_rows_give_the_same_clusters(spark):
    df = spark.createDataFrame(_codes(480), ["year", "month", "h3_r9", *S.CYCLIC_COLUMNS])
    def labels(rows):
        return {tuple(r) for r in G.cluster_incidents(rows, "h3_r9").distinct().collect()}
    assert labels(df) == labels(df.unionByName(df))
