"""Packing documents into sequences with the mixture under control.

Each source is a queue of tokens, its documents in order. In every round each source earns tokens
in proportion to its weight; what it may not send yet, because it sends whole quanta of
``QUANTUM`` tokens only, stays as its deficit for later rounds. Rounds follow each other in one
stream, which is cut into windows of ``WINDOW`` tokens, so every window holds the target
proportions up to a quantum per source, and only the last one can be short. Queues that run dry
leave their turns to the others.

What a source has sent after r rounds has a closed form, so the place of any token in the stream
follows from its number within the source: partitions need only the running token counts of the
sources and the list of sources (one row per source, as long as the mixture itself).

Cases: null text counts as empty; an empty text still has its closing token; the null source is a
source of its own; repeated rows are packed as rows of their own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from hexlytics.llm.order import running_within
from hexlytics.llm.shingles import mix
from hexlytics.llm.tables import small, source_key, text_parts
from hexlytics.session import scratch_path

WINDOW = 2048
QUANTUM = 128
CLOSING = 1  # id after each document
PAD = 0
VOCABULARY = "word_bpe_49k.json"
_KNOWN_PIECES = 1_000_000  # remembered per worker, at some 40 bytes and their ids each
_TOGETHER = 1 << 20  # bytes of text whose pieces are looked up at once
_POINT = 32  # binary places of the rates

# Fixed value: how this vocabulary splits lower-cased text into pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters whose case, form and class are the same everywhere, so that pieces are independent.
_PLAIN = regex.compile(r"[\t-\r\x20-\x7E¡-©«-´¶-¹»-įı-ž]")
_BLANK, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_CLASSES = ((_BLANK, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"))


def _class_of(c: str) -> int:
    if not _PLAIN.match(c):
        return _ODD
    return next((kind for kind, pattern in _CLASSES if regex.match(pattern, c)), _OTHER)


# Per byte of one, and per code point of two-byte characters: class, and the lower-case bytes.
_CLASS = np.array([_class_of(chr(c)) if c < 0x80 else _ODD for c in range(256)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if c < 0x80 else c for c in range(256)], np.uint8)
_TWO = [chr(c) for c in range(0x80, 0x800)]
_CLASS_2 = np.full(0x800, _ODD, np.uint8)
_CLASS_2[0x80:] = [_class_of(c) for c in _TWO]
_LOWER_2 = np.zeros((0x800, 2), np.uint8)
_LOWER_2[0x80:] = [list((c if _class_of(c) == _ODD else c.lower()).encode()) for c in _TWO]
_KEYED = 16  # bytes of a piece that two 64-bit numbers hold
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Pieces:
    """Ids of pieces, each encoded once and remembered.

    A piece of up to 16 bytes is known by its bytes, as two numbers (no piece holds a zero byte); a
    longer one by its 128-bit blake2b digest. So two pieces are never taken for each other.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = _KNOWN_PIECES) -> None:
        self.tokenizer, self.most = tokenizer, most
        self._forget()

    def _forget(self) -> None:
        self.n, self.used = 0, 0
        self.low, self.high = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 15, "<u2")
        self._slots(16)

    def _slots(self, bits: int) -> None:
        self.bits, self.slot = bits, np.full(1 << bits, -1, np.int64)
        self._put(np.arange(self.n))

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high + np.uint64(1))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, which: np.ndarray) -> None:
        place = self._places(self.low[which], self.high[which])
        while len(which):
            free = self.slot[place] < 0
            self.slot[place[free]] = which[free]  # of several, the last one stays
            on = self.slot[place] != which
            which, place = which[on], (place[on] + 1) & ((1 << self.bits) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        out = np.full(len(low), -1, np.int64)
        place, left = self._places(low, high), np.arange(len(low))
        while len(left):
            here = self.slot[place]
            hit = (here >= 0) & (self.low[here] == low[left]) & (self.high[here] == high[left])
            out[left[hit]] = here[hit]
            on = (here >= 0) & ~hit
            left, place = left[on], (place[on] + 1) & ((1 << self.bits) - 1)
        return out

    def learn(self, low: np.ndarray, high: np.ndarray, pieces: list[str]) -> None:
        """Add pieces that are not known yet, each once."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        made = [e.ids for e in found]
        count = np.array([len(x) for x in made], np.int64)
        flat = np.array([i for x in made for i in x], "<u2")
        end, room = self.n + len(low), self.used + len(flat)
        if end > len(self.low):
            more = np.zeros(max(end, 2 * len(self.low)) - len(self.low), np.int64)
            for name in ("low", "high", "start", "count"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, more.astype(old.dtype)]))
        if room > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(room, len(self.ids)), "<u2")])
        new = np.arange(self.n, end)
        self.low[new], self.high[new], self.count[new] = low, high, count
        self.start[new] = self.used + np.cumsum(count) - count
        self.ids[self.used:room] = flat
        self.n, self.used = end, room
        if 2 * end > len(self.slot):
            self._slots(int(4 * end).bit_length())
        else:
            self._put(new)

    def of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each). ``data`` has room for a
        key after its last byte."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = eight[start] & _MASK[np.minimum(size, 8)]
        high = eight[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
        for k in np.flatnonzero(size > _KEYED).tolist():
            digest = hashlib.blake2b(data[start[k]:start[k] + size[k]], digest_size=16).digest()
            low[k], high[k] = np.frombuffer(digest, np.uint64)
        if self.n > self.most:
            self._forget()
        at = self.find(low, high)
        new = np.flatnonzero(at < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            l, h = low[order], high[order]
            some = order[np.concatenate([[True], (l[1:] != l[:-1]) | (h[1:] != h[:-1])])]
            self.learn(low[some], high[some], [
                data[a:a + n].tobytes().decode() for a, n in zip(start[some].tolist(), size[some].tolist())])
            at[new] = self.find(low[new], high[new])
        count = self.count[at]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(self.start[at] - (upto - count), count) + np.arange(total)], count


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case bytes with room for a key, class of each byte's character)."""
    low, kind = np.zeros(len(data) + _KEYED + 8, np.uint8), _CLASS[data]
    low[:len(data)] = _LOWER[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(lead):
        code = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        low[lead], low[lead + 1] = _LOWER_2[code].T
        kind[lead] = kind[lead + 1] = _CLASS_2[code]
    return low, kind


def _cut(low: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the pieces as ``_PIECES`` has them; ``firsts`` are first bytes of texts."""
    n = len(kind)
    fresh = np.zeros(n + 1, bool)
    fresh[firsts] = True
    head = (low[:n] & 0xC0) != 0x80  # not the second byte of a character
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    new |= fresh[:n] | ((kind == _NUMBER) & head)
    # An apostrophe that begins and ends a run takes an ending after it along.
    mark = np.flatnonzero((low[:n] == 0x27) & new)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == _LETTER) & ~fresh[mark + 1]]
    a, b = low[mark + 1], low[mark + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    inside = (mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)]
    two = inside & (np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e"))
                    | (a == ord("l")) & (b == ord("l")))
    for which, length in ((mark[one], 2), (mark[two], 3)):
        new[which + 1] = False
        rest = which + length
        new[rest[rest < n]] = True
    start = np.flatnonzero(new)
    size = np.diff(start, append=n)
    real = kind[start] != _BLANK
    return start[real], size[real]


class Words:
    """Ids of texts by the tokenizer.

    Plain text is cut into pieces, all of a slice at once, which the tokenizer encodes independently
    of each other. Any other text goes to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        # One worker per core already; more threads only take time from each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _slices(self, kind: np.ndarray, ends: np.ndarray) -> list[int]:
        """Where to cut long data: before a blank, or at the end of a text without one."""
        cuts, at, n = [0], 0, len(kind)
        while n - at > _TOGETHER:
            blank = np.flatnonzero(kind[at + 1:at + _TOGETHER] == _BLANK)
            if len(blank):
                at += 1 + int(blank[-1])
            else:
                far = np.flatnonzero(kind[at + _TOGETHER:] == _BLANK)
                end = int(ends[np.searchsorted(ends, at, "right")])
                at = min(end, at + _TOGETHER + int(far[0])) if len(far) else end
            cuts.append(at)
        return cuts if cuts[-1] == n else [*cuts, n]

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of ``data``, which ends where ``ends`` says."""
        low, kind = _lowered(data)
        odd = kind == _ODD
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        begins = np.concatenate([[0], ends[:-1]])
        out: list[np.ndarray | None] = [None] * len(ends)
        strange = np.zeros(len(ends), bool)
        strange[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        for k in np.flatnonzero(strange).tolist():
            out[k] = self.whole(data[begins[k]:ends[k]].tobytes().decode())
        plain = np.flatnonzero(~strange)
        if strange.any():  # the others move together
            sizes = (ends - begins)[plain]
            keep = np.repeat(~strange, ends - begins)
            low = np.concatenate([low[:len(data)][keep], np.zeros(_KEYED + 8, np.uint8)])
            kind, ends = kind[keep], np.cumsum(sizes)
            begins = ends - sizes
        ids, upto = [np.zeros(0, "<u2")], np.zeros(len(plain) + 1, np.int64)
        cuts = self._slices(kind, ends) if len(kind) else [0]
        for a, b in zip(cuts, cuts[1:]):
            firsts = begins[(begins > a) & (begins < b)] - a
            start, size = _cut(low[a:b + _KEYED + 8], kind[a:b], firsts)
            made, count = self.pieces.of(low[a:b + _KEYED + 8], start, size)
            ids.append(made)
            np.add.at(upto, np.searchsorted(ends, start + a, "right") + 1, count)
        flat, upto = np.concatenate(ids), np.cumsum(upto)
        for j, k in enumerate(plain.tolist()):
            out[k] = flat[upto[j]:upto[j + 1]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        each = [t.encode() for t in texts]
        ends = np.cumsum([len(t) for t in each], dtype=np.int64)
        return [x.tobytes() for x in self.encode_bytes(np.frombuffer(b"".join(each), np.uint8), ends)]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, _key, ids, doc_tokens): ids as 16-bit numbers, the closing one included."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select("doc_id", source_key(F.col("source")).alias("_key"), "text")
    closing = np.array([CLOSING], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch, data, ends in text_parts(batches, "text", _TOGETHER):
            ids = [x.tobytes() + closing for x in words.encode_bytes(data, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_key"), pa.array(ids, pa.binary()),
                 pa.array([len(x) // 2 for x in ids], pa.int64())],
                names=["doc_id", "_key", "ids", "doc_tokens"])

    return rows.mapInArrow(run, "doc_id long, _key string, ids binary, doc_tokens long")


class Rounds:
    """Deficit round-robin in closed form. ``sizes`` and ``weights`` follow one order of sources."""

    def __init__(self, sizes: list[int], weights: list[int], window: int = WINDOW,
                 quantum: int = QUANTUM) -> None:
        self.sizes, self.quantum = sizes, quantum
        whole = max(1, sum(weights)) * quantum
        # Quanta earned per round, in fixed point.
        self.rates = [max(1, ((w * window) << _POINT) // whole) for w in weights]

    def sent(self, source: int, rounds: int) -> int:
        """Tokens that a source has sent in all before round ``rounds``."""
        earned = (rounds * self.rates[source]) >> _POINT
        return min(self.sizes[source], earned * self.quantum)

    def round_of(self, source: int, token: int) -> int:
        """The round in which the token of that number within its source is sent."""
        needed = (token // self.quantum + 1) << _POINT
        return -(-needed // self.rates[source]) - 1

    def before(self, source: int, round_: int) -> int:
        """Tokens of the stream ahead of what this source sends in this round."""
        return sum(self.sent(s, round_ + (s < source)) for s in range(len(self.sizes)))

    def runs(self, source: int, first: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, stream place) of the runs of a document, start counted within it."""
        at, end = first, first + length
        while at < end:
            r = self.round_of(source, at)
            upto = min(end, self.sent(source, r + 1))
            yield at - first, upto - at, self.before(source, r) + at - self.sent(source, r)
            at = upto


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, source string")


def pack(docs: DataFrame, weights: dict[str | None, int] | None = None, window: int = WINDOW,
         quantum: int = QUANTUM, vocabulary: str | None = None, with_ids: bool = False
         ) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves.

    ``weights`` are per source; without them a source weighs its own tokens, so that all sources
    end together. Runs jobs when called: tokens are written once to the shared folder.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    numbered = tokens(docs, vocabulary).withColumn("_row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    placed = running_within(
        stored.select("_row", "doc_id", "_key", "doc_tokens"), "_key", ["doc_id", "doc_tokens"],
        F.col("doc_tokens"), "_first")
    per = placed.groupBy("_key").agg(F.sum("doc_tokens").alias("n")).orderBy("_key").collect()
    names = [r["_key"] for r in per]
    sizes = [r["n"] for r in per]
    given = {("~" if k is None else f"={k}"): w for k, w in (weights or {}).items()}
    rounds = Rounds(sizes, [given.get(k, 1) for k in names] if given else sizes, window, quantum)
    number = {k: j for j, k in enumerate(names)}
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    columns = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int32())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in columns]
            for doc_id, key, ids, n, first in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "_key", "ids", "doc_tokens", "_first"))):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                name = None if key == "~" else key[1:]
                for start, length, place in rounds.runs(number[key], first, n):
                    while length:
                        some = min(length, window - place % window)
                        part = wide[start:start + some]
                        row = (doc_id, start, some, zlib.crc32(part), n, place // window,
                               place % window, name)
                        for column, value in zip(out, row):
                            column.append(value)
                        if with_ids:
                            out[-1].append(part.astype(np.int32))
                        start, place, length = start + some, place + some, length - some
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=columns)

    return stored.drop("doc_id", "_key", "doc_tokens").join(placed, "_row").mapInArrow(cut, schema)


def sequences(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(sequence_id, ids): whole windows, the last one padded. A group has one window of tokens."""
    pieces = pack(docs, window=window, with_ids=True, **options)
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    return joined.withColumn("ids", F.concat(
        "ids", F.array_repeat(F.lit(PAD), F.lit(window) - F.size("ids"))))
