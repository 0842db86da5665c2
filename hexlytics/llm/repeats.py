"""Repeated passages by prefix doubling over sampled positions.

Asked for are all bytes covered by a ``LENGTH``-byte string that also starts earlier. Spark sorts
rows of (rank pair, position) at growing lengths; what is unique leaves, what repeats whole is
decided at once, and only the rest is ranked anew:

1. ``GRAM`` bytes. Every window of LENGTH bytes has one anchor, its leftmost smallest-hash gram.
   Equal windows have equal anchors, so only anchors are ranked, not all positions. The pair is
   (anchor gram, the whole run of windows that share the anchor).
2. ``LENGTH - CELL + 1`` bytes. Runs that repeat in part are cut into cells of ``CELL`` window
   starts. The pair is (what all windows of the cell share, all bytes of the cell).
3. ``LENGTH`` bytes. Cells that repeat in part are resolved start by start. The pair is (first
   half, second half), as in any doubling step.

In each round rows with equal pairs repeat the first of them, wherever it is (within a text this
is settled before the shuffle); a first row whose left part occurs in other pairs goes on; all
others are unique. Ranks are 64-bit hashes of whole
substrings, taken from running sums, so a pair has 128 bits. A round streams over sorted rows in
constant memory, and no row is compared with more than its neighbours.

Cases: null text counts as empty; texts shorter than LENGTH lose nothing; positions order by
(doc_id, start), null ids first; rows alike in doc_id and text are one document and have the same
result; rows that share a doc_id only are versions that start together; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexlytics.llm.order import partitions
from hexlytics.llm.shingles import back, mix, running
from hexlytics.llm.tables import small
from hexlytics.session import scratch_path

LENGTH = 100
GRAM = 24
CELL = 16
_VALUE = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(
    2) + np.uint64(1)
_NO_ID = -(1 << 63)
_TAG_BITS, _SPAN_BITS = 18, 7
# An id, and bits of two hashes: a null id may have any number of texts (82 bits), another one some
# thousand (50 bits, which travel in half the space).
TEXT = ["doc", "name", "tag"]
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = (1 << 63) - 1
ROW = "key long, cls long, doc long, name long, at long, done boolean"


def _pack(start, lead, width, tag) -> np.ndarray:
    """One sortable number: first start, anchor minus start, starts minus one, text tag."""
    at = (start.astype(np.int64) << _SPAN_BITS) | lead
    return (((at << _SPAN_BITS) | (width - 1)) << _TAG_BITS) | tag


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, anchor minus start, number of starts)."""
    low = (1 << _SPAN_BITS) - 1
    return (at >> (_TAG_BITS + 2 * _SPAN_BITS), (at >> (_TAG_BITS + _SPAN_BITS)) & low,
            ((at >> _TAG_BITS) & low) + 1)


class Text:
    """Hashes of any substrings of one text."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.sums = running(self.data, _VALUE)
        self.back = back(len(data) + 1)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first start, last start, gram hash) of each run of windows."""
        n = len(self.data) - GRAM + 1
        grams = mix((self.sums[GRAM:] - self.sums[:n]) * self.back[:n])
        least = (grams & _HIGH) | np.arange(n, dtype=np.uint64)
        width, goal = 1, LENGTH - GRAM + 1
        while width < goal:
            step = min(width, goal - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        anchor = (least & ~_HIGH).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        return anchor[first], first, last, grams[anchor[first]]


def _runs(text: Text) -> tuple[np.ndarray, ...]:
    anchor, first, last, grams = text.anchors()
    lead, width = anchor - first, last - first + 1
    shape = (lead * 128 + width).astype(np.uint64)
    return grams, mix(text.hashes(first, last + LENGTH) + mix(shape)), first, lead, width


def _cells(text: Text, at: np.ndarray) -> tuple[np.ndarray, ...]:
    first, lead, width = _unpack(at)
    anchor = first + lead
    near, far = lead - width + 1, lead  # distances of the starts from the anchor
    many = far // CELL - near // CELL + 1
    run = np.repeat(np.arange(len(at)), many)
    cell = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + (near // CELL)[run]
    low, high = np.maximum(near[run], cell * CELL), np.minimum(far[run], cell * CELL + CELL - 1)
    start, stop = anchor[run] - high, anchor[run] - low
    shared = anchor[run] - cell * CELL
    place = mix(cell.astype(np.uint64))
    shape = ((low - cell * CELL) * 128 + (high - low)).astype(np.uint64)
    return (mix(text.hashes(shared, shared - CELL + 1 + LENGTH) + place),
            mix(text.hashes(start, stop + LENGTH) + mix(shape)), start, 0 * start, stop - start + 1)


def _starts(text: Text, at: np.ndarray) -> tuple[np.ndarray, ...]:
    first, _, width = _unpack(at)
    start = np.repeat(first, width) + np.arange(width.sum()) - np.repeat(
        np.cumsum(width) - width, width)
    half = LENGTH // 2
    return (mix(text.hashes(start, start + half)), mix(text.hashes(start + half, start + LENGTH)),
            start, 0 * start, 0 * start + 1)


def _rows(texts: DataFrame, make: Callable[..., tuple[np.ndarray, ...]], chosen: bool
          ) -> DataFrame:
    """Rank rows of each text; ``chosen``: of its positions in ``at`` only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found: list[tuple[np.ndarray, ...]] = []
            size = 0
            ats = batch.column("at") if chosen else None
            for k, (doc, name, tag, text) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in ("doc", "name", "tag", "text")))):
                data = text.encode("utf-8", "replace")
                if len(data) < LENGTH:
                    continue
                more = () if ats is None else (np.asarray(ats[k].values, np.int64),)
                key, cls, start, lead, width = make(Text(data), *more)
                done = _repeated(key, cls, start)
                key = np.where(done, mix(start.astype(np.uint64) + np.uint64(doc & _LOW)), key)
                found.append((key.view(np.int64), cls.view(np.int64),
                              np.full(len(key), doc, np.int64), np.full(len(key), name, np.int64),
                              _pack(start, lead, width, tag), done))
                size += len(key)
                if size > 200_000:
                    yield _batch(found)
                    found, size = [], 0
            if found:
                yield _batch(found)

    return texts.mapInArrow(run, ROW)


def _repeated(key: np.ndarray, cls: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose pair occurs earlier in the same text. They are decided, and travel under keys
    of their own: a text that repeats one word would send all its rows to one task."""
    order = np.lexsort((start, cls, key))
    k, c = key[order], cls[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    return out


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in zip(*found)],
        names=["key", "cls", "doc", "name", "at", "done"])


def rerank(rows: DataFrame) -> DataFrame:
    """(doc, name, tag, at, again) from rank rows: ``again`` repeats an earlier row with the same pair;
    the others are first of their pair while their key occurs in other pairs too."""
    spread = rows.repartition(partitions(rows), "key").sortWithinPartitions(
        "key", "cls", "doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = cls = first_doc = first_at = None  # of the last row; first row of its pair
        pairs = 0  # of the last key so far
        only = None  # first row of the last key while it has one pair
        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, d, m, a = (batch.column(j).to_numpy() for j in range(5))
            done = batch.column(5).to_numpy(zero_copy_only=False)
            if done.any():
                yield _decided(d[done], m[done], a[done], np.ones(int(done.sum()), bool))
                k, c, d, m, a = (x[~done] for x in (k, c, d, m, a))
                if not len(k):
                    continue
            new_key = np.concatenate([[k[0] != key or key is None], k[1:] != k[:-1]])
            new_pair = new_key | np.concatenate([[c[0] != cls or cls is None], c[1:] != c[:-1]])
            starts = np.flatnonzero(new_pair)
            pair = np.cumsum(new_pair)
            heads_d = np.concatenate([[first_doc or 0], d[starts]])
            heads_a = np.concatenate([[first_at or 0], a[starts]])
            shift = _TAG_BITS + 2 * _SPAN_BITS
            begin, head = a >> shift, heads_a[pair] >> shift
            again = (d > heads_d[pair]) | ((d == heads_d[pair]) & (begin > head))
            again &= ~new_pair
            group = np.cumsum(new_key)
            count = np.bincount(group, weights=new_pair, minlength=group[-1] + 1)
            count[0] += pairs
            goes_on = new_pair & (count[group] > 1)
            take = np.flatnonzero(again | goes_on)
            out_d, out_m, out_a, out_again = d[take], m[take], a[take], again[take]
            if only is not None and count[0] > 1:
                out_d = np.concatenate([[only[0]], out_d])
                out_m = np.concatenate([[only[1]], out_m])
                out_a = np.concatenate([[only[2]], out_a])
                out_again = np.concatenate([[False], out_again])
                only = None
            elif group[-1] > 0:
                only = None
            pairs = int(count[group[-1]])
            if pairs == 1 and only is None:
                j = starts[-1]
                only = (d[j], m[j], a[j])
            key, cls, first_doc, first_at = k[-1], c[-1], heads_d[-1], heads_a[-1]
            yield _decided(out_d, out_m, out_a, out_again)

    return spread.mapInArrow(run, "doc long, name long, tag long, at long, again boolean")


def _decided(doc: np.ndarray, name: np.ndarray, at: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(name, pa.int64()),
        pa.array(at & ((1 << _TAG_BITS) - 1), pa.int64()), pa.array(at, pa.int64()),
        pa.array(again, pa.bool_())], names=["doc", "name", "tag", "at", "again"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(_NO_ID).cast("long")).alias("doc"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(
            F.xxhash64("text").bitwiseAND(0xFFFFFFFF)).alias("name"),
        # Another seed. Never null, so that all joins can reuse one exchange of the texts.
        F.xxhash64(F.lit(18), "text").bitwiseAND((1 << _TAG_BITS) - 1).alias("tag"),
        text.alias("text"))


def _again(texts: DataFrame, ranked: DataFrame, make) -> DataFrame:
    """The next round, for the rows that go on."""
    todo = ranked.where("not again").groupBy(*TEXT).agg(F.collect_set("at").alias("at"))
    return rerank(_rows(texts.join(todo, TEXT).select(*TEXT, "text", "at"), make, True))


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, repeats): texts as (doc, name, tag, text), repeats as (doc, name, tag, at) of decided rows.

    Runs the first round when called and writes its rows to the shared folder.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    path = scratch_path(spark, "repeats")
    first = rerank(_rows(texts, _runs, False))
    first.write.parquet(path)
    runs = spark.read.schema(first.schema).parquet(path)
    cells = _again(texts, runs, _cells)
    starts = _again(texts, cells, _starts)
    found = runs.unionByName(cells).unionByName(starts).where("again").drop("again")
    return texts, found


def spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes, as starts and ends."""
    first, _, width = _unpack(np.sort(at))
    stop = np.maximum.accumulate(first + width - 1 + LENGTH)
    new = np.concatenate([[True], first[1:] > stop[:-1]]) if len(at) else np.zeros(0, bool)
    return first[new], np.concatenate([stop[:-1][new[1:]], stop[-1:]])


def _covered(docs: DataFrame) -> DataFrame:
    texts, found = removed(docs)
    per = found.groupBy(*TEXT).agg(F.collect_list("at").alias("at"))
    return texts.join(per, TEXT, "left").select("doc", "text", "at")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes, bytes, int]]:
    """(doc_id, all bytes, kept bytes, spans) of each row."""
    for batch in small(batches):
        for doc, text, at in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(),
                                 batch.column("at")):
            data = text.encode("utf-8", "replace")
            kept, n = data, 0
            if at.is_valid:
                start, stop = spans(np.asarray(at.values, np.int64))
                n = len(start)
                kept = b"".join(data[a:b] for a, b in zip(
                    [0, *stop.tolist()], [*start.tolist(), len(data)]))
            yield None if doc == _NO_ID else doc, data, kept, n


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    types = [pa.int64()] * 4 + [pa.string()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest())
                    for doc, data, kept, n in _kept(iter([batch]))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _covered(docs).mapInArrow(run, schema)


def strip(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts without the repeated bytes; a character cut in two is dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, kept.decode("utf-8", "ignore"))
                    for doc, _, kept, _ in _kept(iter([batch]))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string()))],
                    names=["doc_id", "text"])

    return _covered(docs).mapInArrow(run, "doc_id long, text string")
