import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hexlytics.llm import packing as P

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
TEXTS = [
    None, "", " ", "don't we'll THEY'RE it's", "naïve Straße ÉCOLE ½ 1234 a1b2", "ΣΑΣ İstanbul ﬁ",
    "<|endoftext|> x <|startoftext|>", "a\x1cb\x85c d\xa0e", "é zero​width",
    "😀!!! ### $$$ (x)[y]", "日本語 текст", "'s 't'll", "x" * 3000, "word " * 9000, "ª º µ ŉ ſ ǅ",
    "tab\tnew\nline\r\n", "ĳ Ĳ Œ Ÿ", "\x7f \x00 \x01",
]


def expected(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_agree_with_the_tokenizer():
    words = P.Words(public_tokenizers.path(P.VOCABULARY))
    texts = [t for t in TEXTS if t] * 2 + ["".join(map(chr, range(1, 0x250)))] + [
        f"a{chr(c)}B {chr(c)}" for c in range(1, 0x250)]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == expected(text)[:-1], repr(text[:40])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "_TOGETHER", 10)
    words = P.Words(public_tokenizers.path(P.VOCABULARY))
    words.pieces.most = 2
    for _ in range(3):
        for text in TEXTS[3:6]:
            ids = words.encode([text])[0]
            assert np.frombuffer(ids, "<u2").tolist() == expected(text)[:-1]


@pytest.fixture()
def rows():
    out = [(k, t, "ab"[k % 2]) for k, t in enumerate(TEXTS)]
    out += [(100 + k, f"text number {k} " * (k % 37), "abbbbbc"[k % 7]) for k in range(150)]
    return out + [(3, TEXTS[3], "b")] * 3 + [(None, "no id", None), (999, "null source", None)]


def check(pieces, rows, window):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window or k == len(by_sequence) - 1
    total = Counter()
    for doc_id, text, *_ in rows:
        total[doc_id] += len(expected(text))
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == total
    of = {d: expected(t) for d, t, *_ in rows}
    for p in pieces:
        ids = of[p["doc_id"]]
        part = ids[p["start"]:p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids)
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]


def test_every_token_once(docs, rows):
    pieces = P.pack(docs(rows)).collect()
    check(pieces, rows, P.WINDOW)


def test_windows_hold_the_mixture(docs):
    rows = [(k, "alpha beta gamma " * 40, "aaab"[k % 4]) for k in range(400)]
    pieces = P.pack(docs(rows), window=512, quantum=32).collect()
    check(pieces, rows, 512)
    share = defaultdict(Counter)
    for p in pieces:
        share[p["sequence_id"]][p["source"]] += p["length"]
    for k, found in share.items():
        if k < len(share) - 1:
            assert abs(found["a"] - 384) <= 2 * 32


def test_weights_hold_until_a_source_runs_dry(docs):
    rows = [(k, "alpha beta gamma " * 40, "ab"[k % 2]) for k in range(200)]
    pieces = P.pack(docs(rows), weights={"a": 3, "b": 1}, window=512, quantum=32).collect()
    check(pieces, rows, 512)
    share = defaultdict(Counter)
    for p in pieces:
        share[p["sequence_id"]][p["source"]] += p["length"]
    for k in range(len(share) // 2):
        assert abs(share[k]["a"] - 384) <= 2 * 32
    assert set(share[len(share) - 1]) == {"b"}


def test_rounds_in_closed_form_follow_the_queue():
    sizes, weights, window, quantum = [1000, 37, 450], [5, 1, 2], 64, 8
    rounds = P.Rounds(sizes, weights, window, quantum)
    sent, stream = [0, 0, 0], []
    r = 0
    while sum(sent) < sum(sizes):
        for s in range(3):
            upto = min(sizes[s], quantum * ((r + 1) * rounds.rates[s] >> 32))
            stream += [(s, t) for t in range(sent[s], upto)]
            sent[s] = upto
        r += 1
    place = {token: k for k, token in enumerate(stream)}
    for s in range(3):
        for start, length, at in rounds.runs(s, 0, sizes[s]):
            assert [place[s, start + k] for k in range(length)] == list(range(at, at + length))


def test_sequences_are_whole(docs, rows):
    out = P.sequences(docs(rows)).collect()
    assert all(len(r["ids"]) == P.WINDOW for r in out)
    real = sum(len(expected(t)) for _, t, *_ in rows)
    assert len(out) == -(-real // P.WINDOW)


def test_empty_table(empty):
    assert P.pack(empty).count() == 0


def test_long_words_that_a_polynomial_hash_confuses_keep_their_own_ids():
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate({97: 98, 98: 97})
    other = thue.translate({97: 98, 98: 97})
    words = P.Words(public_tokenizers.path(P.VOCABULARY))
    for text, ids in zip([thue, other], words.encode([thue, other])):
        assert np.frombuffer(ids, "<u2").tolist() == expected(text)[:-1]


def test_random_texts_agree_with_the_tokenizer_together_and_in_slices(monkeypatch):
    rng = np.random.default_rng(8)
    signs = [*"aabcdelmrstvSTLÉéß×÷²½Ÿÿĸŉİſ0123   \t\n!?.,<|-_", *["'"] * 6, "'ll", "'re", "\xa0", "日"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(600)]
    texts += ["x" * 900, "'", "s", "it'", "s a", "y'", "'s", "''s", "a'S", "5'll9", "'llx", "'r", "e"]
    words = P.Words(public_tokenizers.path(P.VOCABULARY))
    for slice_ in (1 << 20, 64):
        monkeypatch.setattr(P, "_TOGETHER", slice_)
        for text, ids in zip(texts, words.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == expected(text)[:-1], repr(text)


def test_forgetting_pieces_changes_nothing():
    words = P.Words(public_tokenizers.path(P.VOCABULARY))
    words.pieces.most = 50
    for text in [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(20)] * 2:
        (ids,) = words.encode([text])
        assert np.frombuffer(ids, "<u2").tolist() == expected(text)[:-1]


def test_batches_are_cut_by_bytes_too():
    import pyarrow as pa

    from hexlytics.llm.tables import small

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 10 + ["y" * 9000] + ["z"] * 600})
    parts = list(small(iter([batch]), 512, 4000))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 4000 for p in parts) and len(parts) < 20
