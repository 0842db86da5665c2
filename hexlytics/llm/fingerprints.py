"""Document fingerprints from closed syncmers.

A k-gram of bytes is an anchor if the smallest hash of its inner s-grams lies at its first or last
s-gram. Whether a k-gram is one depends on its own bytes only, so an edit elsewhere moves no
anchor. A fingerprint holds all anchors, each with its place, in order of places, so any 40 bytes
of a text have one, unless they repeat; the likeness of two is the Dice share of anchors that
occur in both in the same order. Printed, an anchor takes four bytes and the distance to the one
before, a byte as a rule.

Cases: null text counts as empty; an empty text has an empty fingerprint, like (1) another empty
one and unlike (0) any other; a text too short for an anchor has one anchor for the whole of it;
a passage repeated in a text gives its anchors once, at the first place; equal texts have equal
fingerprints. The next document is by ascending doc_id (null first, ties by text); a lone document
is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexlytics.llm.order import partitions
from hexlytics.llm.tables import small

GRAM, INNER = 24, 8  # bytes
KEPT = 64  # anchors that a text of few distinct grams stays below; no text is cut
BUCKETS_PER_PARTITION = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all closed syncmers, by place; hashes have 32 bits."""
    n = len(data) - GRAM + 1
    if n > 0:
        padded = np.frombuffer(data, np.uint8)
        inner = np.lib.stride_tricks.sliding_window_view(padded, INNER)
        h = _mix(np.ascontiguousarray(inner).view("<u8").ravel())
        reach = GRAM - INNER  # from the first inner gram to the last
        least, width = h, 1
        while 2 * width <= reach + 1:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = reach + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        at = np.flatnonzero((h[:n] == least) | (h[reach:reach + n] == least))
        if len(at):
            # Three inner grams cover the whole k-gram.
            whole = _mix(h[at] + np.uint64(3) * h[at + INNER] + np.uint64(5) * h[at + 2 * INNER])
            return (whole >> np.uint64(32)).astype(np.uint32), at
    if not data:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    whole = int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "big")
    return np.array([whole], np.uint32), np.zeros(1, np.int64)


def fingerprint(text: str | None) -> np.ndarray:
    """(anchor, 2): hash and place of all anchors, in order of places."""
    hashes, places = anchors((text or "").encode("utf-8", "replace"))
    first = np.sort(np.unique(hashes, return_index=True)[1])
    return np.stack([hashes[first], places[first].astype(np.uint32)], 1)


def as_text(kept: np.ndarray) -> str:
    """Hex of the number of anchors, their hashes, and the steps between places in base 128.

    Numbers and hashes have four bytes, high first; a step its low seven bits first, with the high
    bit set on all bytes but its last.
    """
    if not len(kept):
        return ""
    steps = np.diff(kept[:, 1].astype(np.int64), prepend=0)
    shift = 7 * np.arange(5)
    parts = (steps[:, None] >> shift) & 127
    more = (steps[:, None] >> (shift + 7)) > 0
    used = np.concatenate([np.ones((len(kept), 1), bool), more[:, :-1]], 1)
    head = np.concatenate([[len(kept)], kept[:, 0]]).astype(">u4").tobytes()
    return (head + (parts | more * 128)[used].astype(np.uint8).tobytes()).hex()


def from_text(printed: str) -> np.ndarray:
    data = bytes.fromhex(printed)
    if not data:
        return np.zeros((0, 2), np.uint32)
    many = int.from_bytes(data[:4], "big")
    hashes = np.frombuffer(data, ">u4", many, 4)
    parts = np.frombuffer(data, np.uint8, offset=4 + 4 * many).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(parts < 128)[:-1] + 1])
    within = np.arange(len(parts)) - np.repeat(starts, np.diff(starts, append=len(parts)))
    places = np.cumsum(np.add.reduceat((parts & 127) << (7 * within), starts))
    return np.stack([hashes.astype(np.uint32), places.astype(np.uint32)], 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    _, mine, other = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    order = other[np.argsort(mine)]
    run = len(order)  # longest run of shared anchors in the same order
    if (np.diff(order) < 0).any():
        tails: list[int] = []
        for k in order.tolist():
            at = bisect.bisect_left(tails, k)
            tails[at:at + 1] = [k]
        run = len(tails)
    return 2.0 * run / (len(a) + len(b) - len(order) + run)


def edited(text: str, following: str) -> str:
    """The second half replaced by the beginning of the following document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows in buckets of ascending ids; each bucket ends with a copy of the row after it.

    Cut points and the first id of each bucket are as many as there are buckets.
    """
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")).alias("_id"))
    many = BUCKETS_PER_PARTITION * partitions(docs)
    cuts = np.array(rows.approxQuantile(
        "_id", [k / many for k in range(1, many)], 0.1 / many) or [0.0])
    cuts = np.unique(cuts).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    placed = rows.withColumn("_bucket", bucket("_id"))
    firsts = placed.groupBy("_bucket").agg(F.min("_id").alias("f")).orderBy("_bucket").collect()
    before = {firsts[k]["f"]: firsts[k - 1]["_bucket"] for k in range(len(firsts))}

    @F.pandas_udf("int")
    def previous(ids: pd.Series) -> pd.Series:
        return ids.map(before).astype("Int32")

    ends = rows.withColumn("_bucket", previous("_id")).where("_bucket is not null")
    both = placed.withColumn("_end", F.lit(0)).unionByName(ends.withColumn("_end", F.lit(1)))
    return both.repartition(partitions(docs), "_bucket").sortWithinPartitions(
        "_bucket", "_end", "_id", "text").drop("_id")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text, of its edited form, and their likenesses."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
             pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose follower is still to come
        for batch in small(batches):
            columns: list[list] = [[] for _ in names]
            for doc_id, text, bucket, end in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "text", "_bucket", "_end"))):
                if end and (held is None or held[3] != bucket):
                    continue  # a further row with the id of the one after the bucket
                own = fingerprint(text)
                if held is not None and held[3] == bucket:
                    changed = edited(held[1], text)
                    other = fingerprint(changed)
                    row = (held[0], len(held[1]),
                           hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
                           as_text(held[2]), as_text(other), likeness(held[2], other),
                           likeness(held[2], own))
                    for column, value in zip(columns, row):
                        column.append(value)
                held = None if end else (doc_id, text, own, bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _ordered(docs).mapInArrow(run, SCHEMA)
