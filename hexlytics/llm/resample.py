"""Importance resampling of documents towards a target text collection.

A document's features are its runs of 1 to ``longest`` words; a feature's bucket is the crc32 of
its bytes modulo ``buckets``. Bucket totals over all documents and over the target give each bucket
a gain, a document's weight is the floored mean of its features' gains, and the documents with the
highest weight plus Gumbel noise are drawn.

Frequent words and frequent pairs of them (the head) are broadcast: a word with the state its crc
has after its last byte, a pair with its bucket. All other features (the tail) take their crc from
their bytes, going on from the state of the run that is one word shorter. Both give the same
number, so totals are exact and the head only saves work. A word of at least the share
``1 / HEAD`` of all words has that share in one batch at least, so the head is found among the words
frequent in a batch; it has at most ``HEAD`` words, whatever the size of the corpus.

Cases: null and empty texts have no feature and weight 0; documents below ``least_words`` words are
scored but never drawn; a null id hashes as empty text and sorts last; rows alike are judged row by
row; words of any length and texts of any length are read whole (memory grows with the longest
text, not with the table); an empty table gives an empty result, an empty target gains from the
corpus totals alone; further columns are ignored by ``scores`` and kept by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexlytics.llm.order import row_numbers
from hexlytics.llm.shingles import mix
from hexlytics.llm.tables import text_parts
from hexlytics.session import checkpointed

BUCKETS = 10_000
HEAD = 1 << 16
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
KEYED = 16  # bytes of a word that two 64-bit numbers hold; longer words belong to the tail
_AT_ONCE = 64  # bytes of a word that are read array-wise

_byte = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
_IN_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte > 0x7F)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_NO_WORD = -1


@dataclass
class Words:
    """The words of some texts, in order: where they are, their keys and whose they are."""

    data: np.ndarray  # lower-cased, with room for a key after the last byte
    start: np.ndarray
    size: np.ndarray
    per_text: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, ends: np.ndarray) -> Words:
        """``data``: the texts one after the other; ``ends``: where each stops."""
        low = np.zeros(len(data) + KEYED + 8, np.uint8)
        low[:len(data)] = _LOWER[data]
        inside = _IN_WORD[low[:len(data)]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if len(ends):
            cuts = ends[(ends > 0) & (ends < len(data))]
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        upto = np.searchsorted(start, ends)
        return cls(low, start, stop - start, np.diff(upto, prepend=0))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The first 16 bytes as two numbers; no word holds a zero byte, so they tell words apart."""
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        low = eight[self.start] & _MASK[np.minimum(self.size, 8)]
        return low, eight[self.start + 8] & _MASK[np.clip(self.size - 8, 0, 8)]

    def crc(self, which: np.ndarray, state: np.ndarray) -> np.ndarray:
        """crc32 of what ``state`` stands for followed by each of the words ``which``."""
        start, size = self.start[which], self.size[which]
        order = np.argsort(-size, kind="stable")
        start, size, now = start[order], size[order], ~state[order]
        falling = -size
        for k in range(min(_AT_ONCE, int(size[0]) if len(size) else 0)):
            m = int(np.searchsorted(falling, -k))
            now[:m] = _CRC[(now[:m] ^ self.data[start[:m] + k]) & 0xFF] ^ (now[:m] >> np.uint32(8))
        now = ~now
        for k in range(int(np.searchsorted(falling, -_AT_ONCE))):
            rest = self.data[start[k] + _AT_ONCE:start[k] + size[k]]
            now[k] = zlib.crc32(rest.tobytes(), int(now[k]))
        out = np.empty_like(now)
        out[order] = now
        return out


class Lookup:
    """Exact lookup of pairs of 64-bit numbers: a table with open addresses."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        bits = max(4, int(4 * len(low)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, _NO_WORD, np.int64)
        for k, place in enumerate(self._places(low, high).tolist()):
            while self.at[place] != _NO_WORD:
                place = (place + 1) & self.last
            self.low[place], self.high[place], self.at[place] = low[k], high[k], k

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high + np.uint64(1))) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Position of each pair among those given at first, or -1."""
        out = np.full(len(low), _NO_WORD, np.int64)
        left, place = np.arange(len(low)), self._places(low, high)
        while len(left):
            here = self.at[place]
            hit = (here != _NO_WORD) & (self.low[place] == low[left]) & (self.high[place] == high[left])
            out[left[hit]] = here[hit]
            on = (here != _NO_WORD) & ~hit
            left, place = left[on], (place[on] + 1) & self.last
        return out


@dataclass
class Vocabulary:
    """The head: frequent words with the state of their crc, frequent pairs with their bucket."""

    low: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    buckets: int = BUCKETS

    def __post_init__(self):
        spelt = [int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")
                 for a, b in zip(self.low, self.high)]
        spelt = [w.rstrip(b"\0") for w in spelt]
        self.state = np.array([zlib.crc32(w) for w in spelt], np.uint32)
        self.words = Lookup(self.low, self.high)
        self.pair = Lookup(self.pairs, np.ones(len(self.pairs), np.uint64))
        self.pair_bucket = np.array(
            [zlib.crc32(b" " + spelt[p & 0xFFFFFFFF], int(self.state[p >> 32])) % self.buckets
             for p in self.pairs.tolist()], np.int64)

    def ids(self, words: Words) -> np.ndarray:
        """Place of each word in the head, or -1."""
        low, high = words.keys()
        out = np.full(len(words.start), _NO_WORD, np.int64)
        short = np.flatnonzero(words.size <= KEYED)
        out[short] = self.words.find(low[short], high[short])
        return out

    def features(self, words: Words, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per run length: (text, bucket) of each run."""
        text = np.repeat(np.arange(len(words.per_text)), words.per_text)
        head = self.ids(words)
        state = np.zeros(len(head), np.uint32)
        known = head != _NO_WORD
        state[known] = self.state[head[known]]
        tail = np.flatnonzero(~known)
        state[tail] = words.crc(tail, np.zeros(len(tail), np.uint32))
        out = [(text, (state % np.uint32(self.buckets)).astype(np.int64))]
        first = np.arange(len(head))
        for n in range(2, longest + 1):
            # The runs of n words: those of n - 1 with a next word in the same text.
            first = first[first + n - 1 < len(head)]
            first = first[text[first] == text[first + n - 1]]
            bucket = np.full(len(first), -1, np.int64)
            if n == 2 and len(self.pairs):
                both = (head[first] != _NO_WORD) & (head[first + 1] != _NO_WORD)
                key = _pair_keys(head, first[both])
                at = self.pair.find(key, np.ones(len(key), np.uint64))
                bucket[both] = np.where(at == _NO_WORD, -1, np.append(self.pair_bucket, 0)[at])
            # Longer runs need the state of every shorter one; pairs only where the head has none.
            open_ = np.arange(len(first)) if longest > n else np.flatnonzero(bucket < 0)
            before = ~state[first[open_]]
            spaced = ~(_CRC[(before ^ 0x20) & 0xFF] ^ (before >> np.uint32(8)))
            now = words.crc(first[open_] + n - 1, spaced)
            bucket[open_] = now % np.uint32(self.buckets)
            out.append((text[first], bucket))
            state = state.copy()
            state[first[open_]] = now
        return out


def _pair_keys(head: np.ndarray, first: np.ndarray) -> np.ndarray:
    return head[first].astype(np.uint64) << np.uint64(32) | head[first + 1].astype(np.uint64)


def _frequent(low: np.ndarray, high: np.ndarray, head: int) -> pa.RecordBatch:
    """(low, high, n) of the keys with at least one ``head``-th of all rows."""
    place = mix(low + mix(high + np.uint64(1)))
    order = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.diff(place[order], prepend=~place[order[:1]]))
    n = np.diff(edge, append=len(order))
    often = n * head >= len(order)
    at = order[edge[often]]
    return pa.RecordBatch.from_arrays(
        [pa.array(low[at].view(np.int64)), pa.array(high[at].view(np.int64)), pa.array(n[often])],
        names=["low", "high", "n"])


def _top(texts: DataFrame, run, head: int) -> tuple[np.ndarray, np.ndarray]:
    counted = texts.mapInArrow(run, "low long, high long, n long").groupBy("low", "high").agg(
        F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "low", "high").limit(head).toPandas()
    return top["low"].to_numpy(np.int64).view(np.uint64), top["high"].to_numpy(np.int64).view(np.uint64)


def vocabulary(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, head: int = HEAD
               ) -> Vocabulary:
    """The head of all ``docs``. Runs one job, two for runs of more than one word."""
    texts = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in text_parts(batches, "text"):
            found = Words.of(data, ends)
            low, high = found.keys()
            short = found.size <= KEYED
            if short.any():
                yield _frequent(low[short], high[short], head)

    low, high = _top(texts, words, head)
    known = Vocabulary(low, high, buckets=buckets)
    if longest < 2 or not len(low):
        return known
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in text_parts(batches, "text"):
            found = Words.of(data, ends)
            at = shared.value.ids(found)
            text = np.repeat(np.arange(len(found.per_text)), found.per_text)
            first = np.flatnonzero((text[1:] == text[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0))
            if len(first):
                key = _pair_keys(at, first)
                yield _frequent(key, np.ones(len(key), np.uint64), head)

    return Vocabulary(low, high, _top(texts, pairs, head)[0], buckets)


def bucket_totals(docs: DataFrame, known, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all features; a task returns each bucket once. ``known``: a broadcast head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, ends in text_parts(batches, "text"):
            for _, bucket in known.value.features(Words.of(data, ends), longest):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, known, longest: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target; add-one smoothed."""
    spark = docs.sparkSession
    seen = bucket_totals(docs, known, longest, buckets).withColumnRenamed("n", "s")
    aimed = bucket_totals(target, known, longest, buckets).withColumnRenamed("n", "t")
    # ``buckets`` rows, however large the tables are.
    rows = spark.range(buckets).select(F.col("id").alias("bucket")).join(
        seen, "bucket", "left").join(aimed, "bucket", "left").fillna(0).toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scores(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS,
           seed: int = SEED, head: int = HEAD, key: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document. Runs jobs when called.

    ``key``: a further column to carry.
    """
    context = docs.sparkSession.sparkContext
    known = context.broadcast(vocabulary(docs, longest, buckets, head))
    gain = context.broadcast(gains(docs, target, known, longest, buckets))
    carried = ["doc_id", *([key] if key else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_parts(batches, "text"):
            words = Words.of(data, ends)
            total, n = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            for text, bucket in known.value.features(words, longest):
                each = np.bincount(text, minlength=len(ends))
                sums = np.concatenate([[0], np.cumsum(gain.value[bucket])])
                upto = np.cumsum(each)
                total += sums[upto] - sums[upto - each]
                n += each
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [
                    pa.array(words.per_text.astype(np.int64)), pa.array(n),
                    pa.array(total // np.maximum(n, 1))],
                names=[*carried, "n_words", "n_features", "weight"])

    rows = docs.select(*carried, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    weighed = rows.mapInArrow(run, f"{types}, n_words long, n_features long, weight long")
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(salted, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``, 1 upwards for the drawn ones, else null. Runs jobs when called.

    Scores are whole numbers within some hundred thousand (logarithms of counts), so their
    histogram tells the lowest score drawn; only documents from there on are sorted.
    """
    pinned = checkpointed(scored)
    able = F.col("n_words") >= least_words
    steps = pinned.where(able).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    drawn = percent * int(steps["count"].sum()) // 100
    none = F.lit(None).cast("long")
    if drawn == 0:
        return pinned.withColumn("rank", none)
    lowest = int(steps["score"].to_numpy()[np.searchsorted(steps["count"].cumsum().to_numpy(), drawn)])
    high = F.coalesce(able & (F.col("score") >= lowest), F.lit(False))
    placed = row_numbers(pinned.where(high), [
        F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_words"), F.col("n_features")], "_n")
    return placed.withColumn("rank", F.when(F.col("_n") < drawn, F.col("_n") + 1)).drop("_n").unionByName(
        pinned.where(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn documents, all their columns. Rows alike in id and text are drawn together."""
    key = F.sha2(F.concat_ws(":", F.hash("doc_id").cast("string"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    name = "_" + "_".join(docs.columns)  # no column of ``docs`` has it
    keyed = docs.withColumn(name, key)
    chosen = ranked(scores(keyed, target, key=name, **options), percent, least_words).where(
        "rank is not null").select(name).distinct()
    return keyed.join(chosen, name, "left_semi").select(docs.columns)
