import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlytics.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, step, k=5):
    fine = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        if any(v):
            fine[vec_id] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    out = {}
    for q in ids[ids % step == 0]:
        a = fine[q]
        score = (x * a).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((a * a).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def found(df, step, **options):
    out = {}
    rows = N.nearest(df, F.expr(f"id % {step} = 0"), **options).collect()
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def cloud(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(k, (centres[k % 8] + rng.normal(size=dim)).astype(np.float32).tolist(), k % 8)
            for k in range(n)]


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_and_exact_scores(spark):
    rows = cloud(3000)
    got, want = found(spark.createDataFrame(rows, SCHEMA), 50), by_hand(rows, 50)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, w in by_hand(rows, 50, 3000).items() for i, s in w}
    for q, near in got.items():
        assert len(near) == 5 and all(s == pytest.approx(exact[q, i], abs=1e-14) for i, s in near)


def test_small_blocks_change_nothing(spark):
    df = spark.createDataFrame(cloud(400), SCHEMA)
    assert found(df, 10) == found(df, 10, block=16)


def test_unusable_and_equal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0),
            (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0),
            (None, [1.0, 1.0], 0), (8, [1.0, 1.0], 0), (10, [0.0, 1.0], 0), (20, [1.0, 0.0], 0),
            (20, [1.0, 0.0], 0), (30, [], 0), (40, [1.0], 0)]
    rows += [(100 + k, [3.0, 3.0], 0) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand([r for r in rows if r[0] not in (30, 40)], 10)
    got = found(df, 10)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {
        q: [i for i, _ in w] for q, w in want.items()}


def test_fewer_candidates_than_asked(spark):
    got = found(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)], SCHEMA), 1)
    assert [i for i, _ in got[0]] == [1] and [i for i, _ in got[1]] == [0]


@pytest.mark.parametrize("rows", [[], [(3, None, 0)]])
def test_nothing_to_search(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA), 1) == {}


def test_one_row_alone(spark):
    assert found(spark.createDataFrame([(0, [1.0], 0)], SCHEMA), 1) == {}


def test_leaves_hold_every_row_once():
    x = np.random.default_rng(3).normal(size=(1000, 8))
    forest = N.fit(x / np.linalg.norm(x, axis=1, keepdims=True), trees=3, leaf_rows=20)
    leaves = forest.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert leaves.min() >= 0
    for tree in range(3):
        assert np.bincount(leaves[:, tree]).max() <= 20


def test_recall_with_under_half_of_all_comparisons():
    """Vectors without any structure, the worst case; places of all leaves seen, each row once."""
    x = np.random.default_rng(9).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = N.fit(x)
    leaves = forest.leaves(x)
    rows = np.stack([np.bincount(c, minlength=leaves.max() + 1) for c in leaves.T])
    hits, compared = [], []
    for q in range(0, 2000, 20):
        seen = np.zeros(2000, bool)
        for tree, leaf in forest.search(x[q], rows, N.EFFORT * 2000, 6):
            seen |= leaves[:, tree] == leaf
        score = x @ x[q]
        score[q] = -2
        hits.append(seen[np.argsort(-score)[:5]].mean())
        compared.append(seen.mean())
    assert np.mean(hits) >= 0.9 and np.mean(compared) < 0.5


def test_every_dimension_is_searched(spark):
    wide = cloud(300, 24)
    narrow = [(1000 + k, v, c) for k, v, c in cloud(60, 7, seed=2)] + [(2000, [1.0], 0), (2001, [], 0)]
    got = found(spark.createDataFrame(wide + narrow, SCHEMA), 10)
    a, b = by_hand(wide, 10), by_hand(narrow[:60], 10)
    assert set(got) == set(a) | set(b) and recall(got, a | b) >= 0.9
    assert all(i >= 1000 for q in b for i, _ in got[q])
