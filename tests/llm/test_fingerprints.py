import hashlib
import random

import numpy as np
import pytest

from hexlytics.llm import fingerprints as S

RNG = random.Random(6)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8)))
         for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def by_hand(data):
    """Closed syncmers, gram by gram."""
    n = len(data) - S.GRAM + 1
    view = np.frombuffer(data, np.uint8)
    inner = np.lib.stride_tricks.sliding_window_view(view, S.INNER)
    h = S._mix(np.ascontiguousarray(inner).view("<u8").ravel()).tolist()
    reach = S.GRAM - S.INNER
    return [i for i in range(n) if min(h[i:i + reach + 1]) in (h[i], h[i + reach])]


def test_anchors_by_hand():
    data = prose(120, 1).encode()
    assert S.anchors(data)[1].tolist() == by_hand(data)


def test_anchors_are_free_of_context():
    passage = prose(60, 2).encode()
    hashes = set(S.anchors(passage)[0].tolist())
    assert hashes and hashes <= set(S.anchors(b"x" * 13 + passage + b" and more")[0].tolist())


@pytest.mark.parametrize("share", [0.25, 0.5, 0.9])
def test_likeness_follows_the_common_part(share):
    errors = []
    for seed in range(40):
        words = prose(800, seed).split()
        cut = int(len(words) * share)
        other = words[:cut] + prose(800 - cut, seed + 1000).split()
        errors.append(S.likeness(S.fingerprint(" ".join(words)),
                                 S.fingerprint(" ".join(other))) - share)
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12


def test_order_matters():
    parts = [prose(200, k) for k in range(4)]
    same = S.likeness(S.fingerprint(" ".join(parts)), S.fingerprint(" ".join(parts)))
    turned = S.likeness(S.fingerprint(" ".join(parts)), S.fingerprint(" ".join(parts[::-1])))
    assert same == 1.0 and turned < 0.6


@pytest.mark.parametrize("text", ["a", "short text", "x" * 500, "ab " * 4000, "ä€😀" * 30])
def test_odd_texts(text):
    kept = S.fingerprint(text)
    assert 0 < len(kept) <= S.KEPT and S.likeness(kept, kept) == 1.0
    assert (S.from_text(S.as_text(kept)) == kept).all()
    assert S.likeness(kept, S.fingerprint("")) == 0.0


def test_no_anchor_is_cut():
    text = prose(6000, 3)
    hashes, places = S.anchors(text.encode())
    kept = S.fingerprint(text)
    assert len(kept) > 2000 and set(kept[:, 0].tolist()) == set(hashes.tolist())
    assert np.diff(kept[:, 1].astype(int)).max() <= 2 * S.GRAM
    assert len(S.as_text(kept)) < 11 * len(kept)


def test_a_shared_passage_in_long_texts():
    passage = prose(60, 4)
    texts = [" ".join([prose(5000, 10 + k), passage, prose(100, 20 + k)]) for k in range(2)]
    a, b = map(S.fingerprint, texts)
    own = S.fingerprint(passage)
    assert set(own[:, 0].tolist()) <= set(a[:, 0].tolist()) & set(b[:, 0].tolist())
    assert S.likeness(a, b) >= len(own) / len(a) * 0.9


def test_likeness_by_hand():
    for seed in range(5):
        rng = random.Random(seed)
        parts = [prose(rng.randint(5, 90), 50 + k) for k in range(8)]
        turned = rng.sample(parts, 6)
        a, b = S.fingerprint(" ".join(parts)), S.fingerprint(" ".join(turned))
        x, y = a[:, 0].tolist(), b[:, 0].tolist()
        longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, h in enumerate(x):
            for j, g in enumerate(y):
                longest[i + 1][j + 1] = longest[i][j] + 1 if h == g else max(
                    longest[i][j + 1], longest[i + 1][j])
        run = longest[-1][-1]
        assert S.likeness(a, b) == 2 * run / (len({*x, *y}) + run)


@pytest.mark.parametrize("places", [[0], [5, 133, 260, 20_000, 3_000_000, 4_000_000_000]])
def test_printed_places(places):
    kept = np.array([[7 * k, p] for k, p in enumerate(places)], np.uint32)
    assert (S.from_text(S.as_text(kept)) == kept).all()


def test_empty_texts_are_alike():
    assert S.likeness(S.fingerprint(None), S.fingerprint("")) == 1.0 and not S.as_text(
        S.fingerprint(""))


def test_table(docs):
    rows = [(k * 3, prose(k % 50, k)) for k in range(150)] + [
        (1, None), (2, ""), (4, "tiny"), (5, prose(30_000, 9)), (None, "no id"), (-5, "😀" * 9)]
    found = {r["doc_id"]: r for r in S.with_neighbours(docs(rows)).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", found[doc_id]
        changed = S.edited(text, following)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == S.as_text(S.fingerprint(text))
        assert r["edited_fingerprint"] == S.as_text(S.fingerprint(changed))
        assert r["near_next"] == S.likeness(S.fingerprint(text), S.fingerprint(following))


@pytest.mark.parametrize("rows", [[(1, "only one")], [(1, "same"), (1, "same"), (1, "same")]])
def test_few_rows(docs, rows):
    found = S.with_neighbours(docs(rows)).collect()
    assert len(found) == len(rows) and all(r["near_next"] == 1.0 for r in found)


def test_empty_table(empty):
    assert S.with_neighbours(empty).count() == 0
