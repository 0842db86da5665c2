import random
from collections import defaultdict

import pytest

from hexlytics.llm import mixing as M


def by_hand(sizes, share=1.5, most=2.0):
    """Targets by pouring again and again until no source is above its limit."""
    weights = {k: (5, 2, 1)[j % 3] for j, k in enumerate(sorted(sizes))}
    left, out = share * sum(sizes.values()), {}
    open_ = dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [k for k, w in open_.items() if w * level >= most * sizes[k]]
        if not full:
            return out | {k: w * level for k, w in open_.items()}
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
            del open_[k]
    return out


@pytest.fixture()
def rows():
    rng = random.Random(3)
    out = [(k, "w " * rng.choice([0, 1, 3, 20, 400]), rng.choice(["a", "a", "a", "b", "ä", None]))
           for k in range(400)]
    return out + [(7, "same words here", "b")] * 5 + [(None, "no id", None), (900, None, "c")]


def test_targets_and_limits(docs, rows):
    found = M.mixture(docs(rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[f"={source}" if source is not None else "~"] += len((text or "").split())
    want = by_hand(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["_key"]]
        assert r["target"] == pytest.approx(want[r["_key"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["_key"]] += r["taken"]
        largest[r["_key"]] = max(largest[r["_key"]], r["size"])
    for key in sizes:
        assert abs(taken[key] - want[key]) <= largest[key] + 1


def test_reruns_agree(docs, rows):
    pick = lambda df: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in df.collect())
    assert pick(M.mixture(docs(rows))) == pick(M.mixture(docs(rows[::-1]).repartition(5)))


def test_mix_emits_the_documents(docs, rows):
    df = docs(rows)
    out = M.mix(df)
    assert out.columns == df.columns
    expected = sum(r["copies"] for r in M.mixture(df).collect())
    got = out.collect()
    assert len(got) == expected
    assert {(r["doc_id"], r["text"]) for r in got} <= {(a, b) for a, b, *_ in rows}


def test_only_empty_texts(docs):
    found = M.mixture(docs([(1, None), (2, " \t\n"), (3, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in found] == [(0, 0.0, 0)] * 3


def test_empty_table(empty):
    assert M.mixture(empty).count() == 0 and M.mix(empty).count() == 0


@pytest.mark.parametrize("text,words", [
    (" a  b\tc\n", 3), ("a b", 1), ("a\x0bb\x0cc\rd", 4), ("\x1ca", 1), ("x", 1),
    ("y " * 70_000, 70_000)])
def test_words(docs, text, words):
    assert M.mixture(docs([(1, text)])).first()["size"] == words
