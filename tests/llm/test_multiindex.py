import numpy as np
import pytest

from hexlytics.llm import multiindex as M

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector string, n long, node int"


@pytest.fixture()
def vectors(spark):
    return lambda rows: spark.createDataFrame(
        [(k, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", 3, 4)
         for k, v in rows], SCHEMA)


def fine(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def by_hand(rows, least=0.95):
    links, group = [0] * len(rows), list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b):
                x, y = (np.asarray(v, float) / np.abs(v).max() for v in (a, b))
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= least:
                    links[i] += 1
                    links[j] += 1
                    group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for g, (k, _) in zip(group, rows):
        if k is not None:
            ids[g] = min(k, ids.get(g, k))
    return sorted(((k, n, ids.get(g), k == ids.get(g)) for g, n, (k, _) in zip(group, links, rows)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def clusters(seed, dim=16, groups=40, alone=150, noise=0.05):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(alone)]
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        out += [centre + noise * rng.standard_normal(dim) for _ in range(rng.integers(2, 7))]
    hot = rng.standard_normal(dim)
    out += [hot + 0.08 * rng.standard_normal(dim) for _ in range(120)]
    return out


def test_links_and_components_by_hand(vectors):
    some = clusters(1)
    rows = list(enumerate(some)) + [(5000 + k, some[3]) for k in range(70)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] * 8), (9003, [float("nan")] * 16),
             (9004, [float("inf")] * 16), (9005, []), (None, some[3]), (None, None), (7, some[7]),
             (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [-1.0, 2.0]), (9009, [1e-300] * 2),
             (9010, [x * 1e200 for x in some[5]])]
    assert found(M.near_duplicates(vectors(rows), full=True, block=64)) == by_hand(rows)


def test_calibrated_reach_finds_all_links_of_random_copies_with_fewer_comparisons(vectors):
    rng = np.random.default_rng(2)
    base = [rng.standard_normal(32) for _ in range(1500)]
    rows = list(enumerate(base + [b + 0.1 * rng.standard_normal(32) for b in base[:400]]))
    _, _, result = M.searched(vectors(rows))
    compared = result.agg({"compared": "sum"}).first()[0]
    assert compared < 0.5 * len(rows) ** 2
    right, got = by_hand(rows), found(M.near_duplicates(vectors(rows)))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in right)
    assert all(a[1] <= b[1] for a, b in zip(got, right))


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(3)
    x = M.unit(rng.standard_normal((300, 9)))
    grid = M.Grid((M.codebook(x[:, :4], 12), M.codebook(x[:, 4:], 12)), 0.0)
    a, b = grid.bounds(x)
    i, j = grid.cells(x)
    apart = M._squares(x, x)
    assert (a[:, i] + b[:, j] <= apart + 1e-9).all()


def test_a_cosine_at_the_limit(vectors):
    # 0.95 exactly: 19 / 20.
    rows = [(1, [1.0, 0.0]), (2, [19.0, (20 ** 2 - 19 ** 2) ** 0.5]), (3, [0.0, 1.0])]
    assert found(M.near_duplicates(vectors(rows), full=True)) == by_hand(rows)


def test_empty_and_unusable_tables(vectors):
    assert found(M.near_duplicates(vectors([]))) == []
    assert found(M.near_duplicates(vectors([(1, None)]))) == [(1, 0, 1, True)]
    assert found(M.near_duplicates(vectors([(1, [1.0]), (2, [2.0])]))) == [(1, 1, 1, True), (2, 1, 1, False)]
