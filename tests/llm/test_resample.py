import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hexlytics.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " .,!", "one", "A1b2 É é Zz", "x" * 5000, "日本語 текст " * 40, "a" * 16 + " " + "a" * 17,
       "one two" + "\0" + "three", "same same same same same", ("w" * 70 + " ") * 30, "\x7f\x80é\xa0"]


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[k:k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def by_hand(docs, target, longest, buckets, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, text in docs for f in runs(text, longest)[1])
    t = Counter(of(f) for text in target for f in runs(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(
        (t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in docs:
        words, features = runs(text, longest)
        weight = sum(gain(of(f)) for f in features) // len(features) if features else 0
        salted = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(salted.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(features), weight, weight + noise, None])
    able = sorted((r for r in rows if r[1] >= least),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, row in enumerate(able[:percent * len(able) // 100]):
        row[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    common = ["the", "of", "Überall", "seventeenletters17", "a"]
    return [" ".join(rng.choice(common) if rng.random() < .6 else f"t{rng.randint(0, 900)}"
                     for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("longest, head", [(1, R.HEAD), (1, 3), (2, R.HEAD), (2, 4), (3, 4)])
def test_scores_and_ranks_by_hand(spark, docs, longest, head):
    rows = list(enumerate(ODD + texts(150, 1))) + [(None, "of the " * 15), (None, None), (3, "of the " * 15)]
    target = texts(20, 2) + [None, "éÉ the the"]
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    scored = R.scores(docs(rows), aimed, longest, 500, head=head)
    found = R.ranked(scored, 30, 20).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows, target, longest, 500, 30, 20)


def test_head_holds_every_frequent_word_and_pair(docs):
    rows = list(enumerate(texts(400, 3)))
    known = R.vocabulary(docs(rows), 2, head=64)
    words = [w for _, t in rows for w in runs(t, 1)[0]]
    often = {w for w, n in Counter(words).items() if n * 64 >= len(words) and len(w.encode()) <= R.KEYED}
    held = {(int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")).rstrip(b"\0").decode()
            for a, b in zip(known.low, known.high)}
    assert often and often <= held and len(held) <= 64
    assert 0 < len(known.pairs) <= 64


def test_lookup_tells_all_keys_apart():
    rng = np.random.default_rng(4)
    low = rng.integers(0, 50, 400, dtype=np.uint64)
    high = np.arange(400, dtype=np.uint64) // np.uint64(2)
    keys = np.unique(np.stack([low, high], 1), axis=0)
    look = R.Lookup(keys[:, 0], keys[:, 1])
    assert look.find(keys[:, 0], keys[:, 1]).tolist() == list(range(len(keys)))
    assert (look.find(keys[:, 0], keys[:, 1] + np.uint64(1000)) == -1).all()


def test_ties_go_to_smaller_ids_and_repeated_rows_count_each(spark, docs):
    rows = [(1, "a b " * 10)] * 10
    target = spark.createDataFrame([("a",)], "text string")
    found = R.ranked(R.scores(docs(rows), target), 50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4, 5]


def test_empty_tables(spark, docs, empty):
    target = spark.createDataFrame([], "text string")
    assert R.ranked(R.scores(empty, target)).count() == 0
    found = R.ranked(R.scores(docs([(1, "a " * 30)]), target), 100).collect()
    assert [(r["n_features"], r["rank"]) for r in found] == [(30, 1)]


def test_documents_keep_their_columns(spark, docs):
    rows = list(enumerate(texts(60, 5)))
    target = spark.createDataFrame([("the of",)], "text string")
    df = docs(rows)
    drawn = R.resample(df, target, 20)
    ranks = R.ranked(R.scores(df, target), 20).where("rank is not null")
    assert drawn.columns == df.columns
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranks.collect()}
