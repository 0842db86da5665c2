import random

import numpy as np
import pytest

from hexlytics.functions.lattice import ring_offsets
from hexlytics.operators import hierarchy as H
from hexlytics.operators.clustering import cluster_incidents, density_incidents

STEPS = [s for s in ring_offsets(1) if s != (0, 0)]


def order(n, cell):
    return (n[cell], -cell[0], -cell[1])


def part_above(n, start, level):
    """Bins connected to ``start`` by bins above ``level``."""
    seen, stack = {start}, [start]
    while stack:
        i, j = stack.pop()
        for a, b in STEPS:
            c = (i + a, j + b)
            if n.get(c, -1) > level and c not in seen:
                seen.add(c)
                stack.append(c)
    return seen


def meeting(n, peak, others):
    """Highest level whose part around ``peak`` holds one of ``others``; None without any."""
    for level in sorted({v for v in n.values() if v <= n[peak]}, reverse=True):
        if part_above(n, peak, level - 0.5) & others:
            return level
    return None


def plain(n, min_size, prominence):
    tree, kept = {}, set()
    for cell in n:
        if any((cell[0] + a, cell[1] + b) in n and
               order(n, (cell[0] + a, cell[1] + b)) > order(n, cell) for a, b in STEPS):
            continue
        level = meeting(n, cell, {c for c in n if order(n, c) > order(n, cell)})
        if level is None:
            kept.add(cell)
            continue
        mass = sum(n[c] for c in part_above(n, cell, level)) if n[cell] > level else 0
        tree[cell] = (level, mass)
        if mass >= min_size and n[cell] >= prominence * level:
            kept.add(cell)
    labels = dict.fromkeys(n, -1)
    for peak in kept:
        floor = meeting(n, peak, kept - {peak})
        part = part_above(n, peak, -1 if floor is None else floor)
        if sum(n[c] for c in part) >= min_size:
            labels |= dict.fromkeys(part, peak[0] * 2**32 + peak[1] + 2**31)
    return tree, labels


def hills(seed, size=300):
    """Points of two densities on a thin background, and a ridge of equal counts."""
    rng = random.Random(seed)
    n = {}
    for _ in range(size):
        for (i, j), wide in (((0, 0), 1.2), ((9, 3), 3.0), ((3, 12), 1.0)):
            cell = (round(rng.gauss(i, wide)), round(rng.gauss(j, wide)))
            n[cell] = n.get(cell, 0) + (3 if wide < 1.1 else 1)
    return n | {(k, -20): 4 for k in range(8)} | {(40, 40): 2}


def noise(seed):
    rng = random.Random(seed)
    return {(rng.randrange(-9, 9), rng.randrange(-9, 9)): rng.randrange(1, 6) for _ in range(220)}


def frame(spark, n, group=None):
    rows = [(*([group] if group else []), i, j, v) for (i, j), v in n.items()]
    return spark.createDataFrame(rows, ("g string, " if group else "") + "i long, j long, n long")


@pytest.mark.parametrize("case, min_size, prominence", [
    (hills(1), 50, 2.0), (noise(3), 5, 1.0)])
def test_tree_and_clusters_equal_a_plain_sweep(spark, case, min_size, prominence):
    tree, labels = plain(case, min_size, prominence)
    df = frame(spark, case)
    got = {(-r["at"]["i"], -r["at"]["j"]): (r["level"], r["mass"])
           for r in H.merge_tree(H.basins(df)).collect()}
    assert got == tree
    rows = H.density_clusters(df, min_size=min_size, prominence=prominence).collect()
    assert {(r["i"], r["j"]): r["cluster"] for r in rows} == labels
    assert {(r["i"], r["j"]): r["n"] for r in rows} == case
    if min_size == 50:  # a thin hill beside a thick one whose slopes are higher than its peak
        heights = sorted(case[c >> 32, (c & (2**32 - 1)) - 2**31] for c in {*labels.values()} - {-1})
        assert len(heights) == 3 and heights[0] * 2 < heights[-1]


def test_groups_do_not_touch(spark):
    a, b = hills(1), noise(3)
    both = frame(spark, a, "a").unionByName(frame(spark, b, "b"))
    rows = H.density_clusters(both, ["g"], min_size=10, prominence=1.5).collect()
    for group, case in (("a", a), ("b", b)):
        assert {(r["i"], r["j"]): r["cluster"] for r in rows if r["g"] == group} == \
            plain(case, 10, 1.5)[1]


def test_no_bins_and_one_bin(spark):
    assert H.density_clusters(frame(spark, {(0, 0): 1}).limit(0)).collect() == []
    rows = H.density_clusters(frame(spark, {(5, -6): 70})).collect()
    assert [(r["i"], r["j"], r["cluster"]) for r in rows] == [(5, -6, 5 * 2**32 - 6 + 2**31)]


def test_incidents_keep_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(2024, 1, f"c{k % 7}", float(np.sin(h)), float(np.cos(h)))
            for k, h in enumerate(np.concatenate([rng.normal(0, 0.05, 300), rng.normal(3, 0.4, 200)]))]
    df = spark.createDataFrame(
        rows, "year int, month int, cell string, hour_sin double, hour_cos double")
    got = density_incidents(df, "cell", min_size=30).toPandas()
    flat = cluster_incidents(df, "cell").toPandas()
    assert len(got) == len(flat) == 500
    sizes = got[got.cluster != -1].groupby("cluster").size()
    assert (sizes >= 30).all() and len(sizes) >= 2


def test_rounds_do_not_multiply_the_planned_size(spark):
    """Each join's estimate is a product; kept over the rounds, its digits would fill the driver."""
    rng = random.Random(3)
    rows = [(i, j, rng.randrange(1, 90)) for i in range(18) for j in range(18)]
    labelled = H.density_clusters(spark.createDataFrame(rows, "i bigint, j bigint, n bigint"), prominence=1.5)
    size = labelled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 1 << 1000 and labelled.count() == len(rows)
