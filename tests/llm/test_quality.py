import random
import zlib

import numpy as np
import pytest

from hexlytics.llm import quality as Q


def test_separates_planted_classes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(Q.FEATURES)))
    y = ((x[:, 3] > 0.3) ^ (x[:, 7] < -0.5)).astype(float)
    model = Q.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_flat_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(Q.FEATURES)))
    model = Q.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    inner = model.feature.shape[1]
    for row, got in zip(x[:20], model.scores(x[:20])):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - inner]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y", [[], [1.0], [0.0, 0.0]])
def test_without_two_classes(y):
    x = np.zeros((len(y), len(Q.FEATURES)))
    scores = Q.fit(x, np.array(y)).scores(np.zeros((2, len(Q.FEATURES))))
    assert ((scores > 0) & (scores < 1)).all()


def test_statistics_of_odd_texts():
    for text in (None, "", " \n\t", "a", "!!!", "ä€😀", "x" * 1_000_000, "a b " * 100_000):
        out = Q.statistics(text)
        assert len(out) == len(Q.FEATURES) and np.isfinite(out).all()


def test_top_word_counts_every_word():
    at = Q.FEATURES.index("top_word")
    words = [w for k in range(115) for w in (f"w{k}", "spam")]  # a stride of 28 meets no "spam"
    assert Q.statistics(" ".join(words))[at] == 0.5
    random.Random(1).shuffle(words)
    assert Q.statistics(" ".join(words))[at] == 0.5


def _rows(n=300):
    rng = random.Random(4)
    good = "the quick brown fox jumps over a lazy dog and runs home again today".split()
    for k in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(20, 80))]
        bad = k % 3 == 0
        yield k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), not bad


def test_scores_and_acceptance(docs, spark):
    rows = list(_rows())
    df = docs([r[:2] for r in rows] + [(None, None), (5, rows[5][1])])
    labels = spark.createDataFrame(
        [(k, int(good), 0) for k, _, good in rows] + [(7, 0, 0), (None, 1, 0), (9999, 1, 0),
                                                      (8, None, 0)],
        "doc_id long, quality int, toxic int")
    model = Q.train(df, labels)
    out = Q.score(df, model).collect()
    assert len(out) == len(rows) + 2
    held = [r for r in out if r["doc_id"] is not None and zlib.crc32(
        str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 30
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in held)
    kept = Q.accept(df, model, 0.5)
    assert kept.columns == df.columns and kept.first()["score"] == "x"
    assert {r["doc_id"] for r in kept.collect()} >= {k for k, _, good in rows if good and k != 7}


def test_held_out_labels_are_unused(docs, spark):
    rows = list(_rows(120))
    df = docs([r[:2] for r in rows])
    schema = "doc_id long, quality int, toxic int"
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    first = Q.train(df, spark.createDataFrame([(k, int(g), 0) for k, _, g in rows], schema))
    other = Q.train(df, spark.createDataFrame(
        [(k, int(g) ^ held(k), 0) for k, _, g in rows], schema))
    assert (first.leaf == other.leaf).all() and (first.cut == other.cut).all()


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(empty, labels)
    assert Q.score(empty, model).count() == 0
