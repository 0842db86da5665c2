import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hexlytics.llm import repeats as R


def by_hand(rows):
    seen = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for doc_id, text in order:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            part, here = data[k:k + 100], (doc_id is not None, doc_id or 0, k)
            if seen.setdefault(part, here) < here:
                covered[k:k + 100] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        runs = int((np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1).sum())
        out[doc_id] = (len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def measured(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in R.measure(df).collect()}


def prose(n, seed, alphabet="abcdefgh "):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus():
    passage, other = prose(300, 1), prose(180, 2)
    rows = [(k, prose(150 + k, 100 + k) + passage[k % 7:200 + k] + prose(90, 200 + k))
            for k in range(20)]
    rows += [(30, passage), (31, passage), (32, passage[:99]), (33, passage[50:149]),
             (34, passage[50:150]), (35, "x" * 500), (36, "x" * 99), (37, "ab" * 300),
             (38, None), (39, ""), (40, other + other), (41, prose(50, 3) + other[:120] + "é" * 80),
             (42, "é" * 80), (43, "😀" * 60 + passage), (-4, passage[100:] + other),
             (None, other[20:] + passage[:150]), (44, (prose(130, 7) + "|") * 5)]
    near = list(prose(900, 9))
    for k in range(50, 60):
        copy = list(near)
        for _ in range(k % 4):
            copy[random.Random(k).randrange(900)] = "#"
        rows.append((k, "".join(copy)))
    return rows


def test_by_hand(docs):
    rows = corpus()
    assert measured(docs(rows)) == by_hand(rows)


def test_order_of_rows_is_free(docs):
    rows = corpus()
    assert measured(docs(rows).repartition(9)) == by_hand(rows)


@given(st.lists(st.lists(st.sampled_from(
    [prose(40, 1), prose(70, 2), prose(101, 3), prose(130, 4), "x", "yz"]), max_size=9), max_size=5))
@settings(max_examples=8, deadline=None)
def test_pieces_put_together(spark, parts):
    rows = [(k, "".join(p)) for k, p in enumerate(parts)]
    assert measured(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_repeated_rows_are_one_document(docs):
    text = prose(400, 5)
    found = R.measure(docs([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (1, 0), (2, 400)]


def test_long_text(docs):
    rows = [(1, prose(200_000, 6)), (2, prose(500, 8) + prose(200_000, 6)[70_000:90_000])]
    assert measured(docs(rows)) == by_hand(rows)


def test_strip(docs):
    text = prose(400, 5)
    out = {r["doc_id"]: r["text"] for r in R.strip(docs([(1, text), (2, "new " + text)])).collect()}
    assert out == {1: text, 2: "new "}


def test_empty_table(empty):
    assert R.measure(empty).count() == 0


def test_anchors_by_hand():
    text = R.Text(prose(400, 4).encode())
    anchor, first, last, _ = text.anchors()
    assert first[0] == 0 and last[-1] == 300 and (first[1:] == last[:-1] + 1).all()
    assert ((anchor >= last) & (anchor + R.GRAM <= first + R.LENGTH)).all()


@pytest.mark.parametrize("doc_id", [None, 5])
def test_one_id_with_thousands_of_texts(docs, doc_id):
    shared = prose(150, 77)
    texts = [prose(110 + k % 40, 1000 + k) for k in range(4990)]
    texts += [prose(40 + 13 * k, 9000 + k) + shared for k in range(10)]
    first = {}
    for text in texts:  # rows of one id start together: the earliest start in any of them counts
        for k in range(len(text) - 99):
            first[text[k:k + 100]] = min(k, first.get(text[k:k + 100], k))
    want = []
    for text in texts:
        covered = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            if first[text[k:k + 100]] < k:
                covered[k:k + 100] = True
        want.append((len(text), int(covered.sum())))
    found = R.measure(docs([(doc_id, t) for t in texts])).select("n_bytes", "n_removed").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(n for _, n in want) >= 9 * 150
