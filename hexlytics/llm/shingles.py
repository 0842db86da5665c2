"""Hashed word shingles of whole texts, computed on arrays.

Words are runs of bytes between ASCII white space, A-Z lower-cased. A word's hash is a polynomial
over random values of its bytes, taken from running sums, so a batch of texts takes a handful of
array operations; five mixed word hashes make a shingle. All hashes have 64 bits. Strings made to
collide under such a polynomial have some thousand bytes, so words of over 32 take blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_SLICE = 1 << 19  # bytes handled at once
_SURE = 32  # bytes of a word that the polynomial is trusted with
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, _SLICE + 1), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        _powers[base] = known
    return known[:n]


def running(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums S with (S[j] - S[i]) * base ** -i the hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def back(n: int) -> np.ndarray:
    """base ** -0 .. base ** -(n - 1)."""
    return powers(pow(_BASE, -1, 1 << 64), n)


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of each word, in order; long data are handled slice by slice."""
    parts, at = [], 0
    for piece in _slices(data):
        raw = np.frombuffer(piece, np.uint8)
        blank = _BLANK[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        sums = running(raw, _VALUE)
        value = (sums[stop] - sums[start]) * back(len(raw))[start] if len(raw) else sums[:0]
        value = mix(value + (stop - start).astype(np.uint64))
        for k in np.flatnonzero(stop - start > _SURE).tolist():
            word = piece[start[k]:stop[k]].lower()  # bytes: A-Z only
            value[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        parts.append((start + at, stop + at, value))
        at += len(piece)
    return tuple(np.concatenate(c) for c in zip(*parts))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    out: list[np.ndarray] = []
    for data, ends in joined([(t or "").encode("utf-8", "replace") for t in texts], _SLICE // 2):
        start, _, hashes = word_table(data)
        out.extend(np.split(hashes, np.searchsorted(start, ends[:-1])))
    return out


def joined(texts: list[bytes], size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts put together with blanks between, up to about ``size`` bytes; the end of each."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= size):
            total += len(texts[upto]) + 1
            upto += 1
        some = texts[at:upto]
        yield b" ".join(some), np.cumsum([len(t) + 1 for t in some])
        at = upto


def _slices(data: bytes) -> list[bytes]:
    """Cut before white space into parts of at most ``_SLICE`` bytes; a longer word stays whole."""
    parts, at = [], 0
    blank = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8)]) if len(data) > _SLICE else ()
    while len(data) - at > _SLICE:
        k = int(np.searchsorted(blank, at + _SLICE, "right")) - 1
        if k < 0 or blank[k] <= at:
            k += 1  # no blank within reach: up to the next one
            while k < len(blank) and blank[k] <= at:
                k += 1
            if k >= len(blank):
                break
        parts.append(data[at:blank[k]])
        at = int(blank[k])
    return [*parts, data[at:]]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; fewer words than five make one shingle of all of them."""
    if not len(words):
        return words
    width = min(len(words), WORDS)
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k:k + n] * _PLACE[k]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    return [shingle_set(w) for w in word_hashes(texts)]
