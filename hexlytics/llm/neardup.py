"""Near duplicates by MinHash bands, odd sketches and exact verification.

1. Each text becomes its set of five-word shingles, a digest of the set, ``SAMPLES`` MinHash
   values, hashes of bands of a few values each, and an odd sketch: the parity, per bit, of the
   MinHash values that fall on it. Equal sets are one class from here on.
2. Classes that share a band are compared by their sketches, in blocks of bounded size: the
   number of differing bits gives the number of differing MinHash values. Pairs that may be
   similar tie their classes into clusters; a block returns a spanning forest, never its pairs.
3. Within each cluster, again in blocks, links are confirmed on the full sets. Blocks return a
   spanning forest of the links. Components of these are the groups.

The least similarity is ``percent``, 85 unless given; size filter, bands (32 of 5 values at 85, 40 of
4 at 80), sketch bound and confirmation follow from it. A pair at the limit shares no band with
probability below 1e-8 and fails the sketch bound, six standard deviations below the limit, even
more rarely. Pairs are compared once per cluster, however many bands they share.

Cases: null, empty and blank texts have an empty set and link with nothing; fewer than five words
make one shingle; rows of equal sets form one group; rows that share a doc_id are judged by their
own texts, ``kept`` marks the row or rows whose doc_id is the smallest of the group; null ids
group like others, and a group of null ids only has a null component; an empty table gives an
empty result; further columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexlytics.llm.components import components
from hexlytics.llm.order import partitions
from hexlytics.llm.shingles import mix, shingle_sets
from hexlytics.llm.tables import small
from hexlytics.session import checkpointed

PERCENT = 85  # 100 * intersection >= PERCENT * union
SAMPLES = 160
MISSED = 1e-8  # most probable share of pairs at the limit without a common band
SKETCH_BITS = 512
SKETCH_ERROR = 0.11  # deviation of a sketch's estimate; measured 0.07 at the limits of 85 and 80
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000

_rng = np.random.default_rng(85)
_FACTOR = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2)
           + np.uint32(1))[:, None]
_SHIFT = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
_BAND_PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 11  # shingles at once, so that the table of values stays in cache


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _STEP):
        values = _FACTOR * x[k:k + _STEP]
        values += _SHIFT
        np.minimum(out, values.min(1), out=out)
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, values in each): the longest bands of which a pair at the limit shares one."""
    for rows in range(SAMPLES, 0, -1):
        bands = SAMPLES // rows
        if (1 - (percent / 100) ** rows) ** bands < MISSED:
            return bands, rows
    raise ValueError(f"{SAMPLES} MinHash values do not find pairs of {percent} %")


def band_hashes(samples: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """(text, band) as signed 64-bit numbers; bands never share a hash by design of the last term."""
    bands, rows = band_shape(percent)
    parts = samples[:, :bands * rows].reshape(len(samples), bands, rows).astype(np.uint64)
    total = (mix(parts) * _BAND_PLACE[:rows]).sum(2, dtype=np.uint64)
    return mix(total + np.arange(bands, dtype=np.uint64)).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(text, word): parity bitmaps of the (place, value) pairs."""
    place = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (mix(samples.astype(np.uint64) + place) % np.uint64(SKETCH_BITS)).astype(np.int64)
    at = np.arange(len(samples))[:, None] * SKETCH_BITS + bit
    odd = np.bincount(at.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), -1), axis=1).view(np.uint64)


def bits_for(differing: int) -> int:
    """Bits expected to differ when that many MinHash values do (each flips one bit per side)."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing)))


def most_differing(percent: int) -> int:
    """MinHash values of two candidates: 24 expected at 85, deviation 5.2; 32 at 80, 6.2."""
    expected = SAMPLES * (100 - percent) / 100
    deviation = math.hypot(math.sqrt(expected * percent / 100), SKETCH_ERROR * expected)
    return math.ceil(expected + 6 * deviation)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_key, n_shingles, node, sketch, bands); null node for an empty set."""
    schema = ("doc_id long, row_key long, n_shingles long, node binary, sketch binary, "
              "bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            sets = shingle_sets(texts)
            samples = np.zeros((len(sets), SAMPLES), np.uint32)
            for k, s in enumerate(sets):
                if len(s):
                    samples[k] = minhash(s)
            bands, sketch = band_hashes(samples, percent), odd_sketches(samples)
            filled = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row_key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if f else None for s, f in zip(sets, filled)], pa.binary()),
                pa.array([x.tobytes() if f else None for x, f in zip(sketch, filled)],
                         pa.binary()),
                pa.array([x.tolist() if f else None for x, f in zip(bands, filled)],
                         pa.list_(pa.int64())),
            ], names=["doc_id", "row_key", "n_shingles", "node", "sketch", "bands"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, schema)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, for edges (a, b) among 0 .. size - 1."""
    label = np.arange(size)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int
                  ) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows again in tables that end where a group ends, with each row's group number."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < most_rows:
            continue
        number = _numbers(held, keys)
        last = int(np.searchsorted(number, number[-1]))
        if last:
            yield held.slice(0, last), number[:last]
            held = held.slice(last)
    if held is not None:
        yield held, _numbers(held, keys)


def _numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        if pa.types.is_binary(column.type):
            values = np.array(column.to_pylist(), object)
        else:
            values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _blocks(rows: DataFrame, key: str, count: str, weight: str | None = None) -> DataFrame:
    """Rows with (key, block): every two rows of a key meet in at least one block.

    A key with more rows than fit one block is dealt into parts, and a block is two parts (or one
    with itself). Small keys have one block.
    """
    need = F.ceil(F.col(count) / F.lit(BLOCK_ROWS / 2))
    if weight:
        need = F.greatest(need, F.ceil(F.col(weight) / F.lit(BLOCK_SHINGLES / 2)))
    parts = F.when((F.col(count) <= BLOCK_ROWS) & (
        F.col(weight) <= BLOCK_SHINGLES if weight else F.lit(True)), 1).otherwise(need)
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("_parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    cut = rows.withColumn("_parts", parts.cast("long")).withColumn("_mine", mine)
    return cut.withColumn("_other", other).withColumn(
        "_block", F.least("_mine", "_other") * F.col("_parts") + F.greatest("_mine", "_other")
    ).drop("_parts", "_mine", "_other")


def _forest_schema() -> str:
    return "a binary, b binary"


def _forest(nodes: list, label: np.ndarray) -> pa.RecordBatch:
    tied = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([
        pa.array([nodes[k] for k in label[tied]], pa.binary()),
        pa.array([nodes[k] for k in tied], pa.binary())], names=["a", "b"])


def clusters(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): forests that tie all classes which share a band and may be similar."""
    most_bits = bits_for(most_differing(percent))
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = classes.select("node", "sketch", "n_shingles", F.explode("bands").alias("band")).join(
        shared, "band")
    dealt = _blocks(rows, "band", "_n").select("band", "_block", "node", "sketch", "n_shingles")
    spread = dealt.repartition(partitions(classes), "band", "_block").sortWithinPartitions(
        "band", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _whole_groups(batches, ["band", "_block"], 4096):
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64
                                   ).reshape(-1, SKETCH_BITS // 64)
            size = table.column("n_shingles").to_numpy()
            firsts, seconds = [], []
            # Row i against row i + step: all pairs of a group, over all groups at once.
            here = np.arange(len(number) - 1)
            step = 1
            while True:
                here = here[:np.searchsorted(here, len(number) - step)]
                here = here[number[here] == number[here + step]]
                if not len(here):
                    break
                there = here + step
                like = 100 * np.minimum(size[here], size[there]) >= percent * np.maximum(
                    size[here], size[there])
                i, j = here[like], there[like]
                bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
                close = bits <= most_bits
                firsts.append(i[close])
                seconds.append(j[close])
                step += 1
            if firsts:
                label = _roots(len(number), np.concatenate(firsts), np.concatenate(seconds))
                yield _forest(table.column("node").to_pylist(), label)

    return spread.mapInArrow(run, _forest_schema()).distinct()


def _links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union, by products of 0/1 columns."""
    sizes = np.array([len(s) for s in sets])
    which = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times[column] > 1
    which, column = which[some], column[some]
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        ones = np.zeros((len(sets), width), np.float32)
        ones[which[a:b], column[a:b] - low] = 1
        shared += ones @ ones.T
    union = sizes[:, None] + sizes[None, :] - shared
    i, j = np.nonzero(100 * shared.astype(np.float64) >= percent * union)
    return i[i < j], j[i < j]


def links(docs: DataFrame, classes: DataFrame, tied: DataFrame, percent: int = PERCENT
          ) -> DataFrame:
    """(a, b): spanning forests of all links, confirmed on the full sets."""
    member = classes.select("node", F.col("row_key").alias("_rep"), "n_shingles").join(
        tied, "node")
    sizes = member.groupBy("root").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    dealt = _blocks(member.join(sizes, "root"), "root", "_n", "_s").select(
        "root", "_block", "node", "_rep")
    text = docs.select(F.col("row_key").alias("_rep"), "text").where("text is not null")
    rows = dealt.join(text, "_rep").select("root", "_block", "node", "text")
    spread = rows.repartition(partitions(docs), "root", "_block").sortWithinPartitions(
        "root", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _whole_groups(batches, ["root", "_block"], 256):
            nodes = table.column("node").to_pylist()
            sets = shingle_sets(table.column("text").to_pylist())
            # Rows alike have one key and the same set; one is enough.
            right = [digest(s) == n for s, n in zip(sets, nodes)]
            firsts, seconds = [], []
            for g in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                g = [k for k in {nodes[k]: k for k in g if right[k]}.values()]
                if len(g) > 1:
                    i, j = _links([sets[k] for k in g], percent)
                    firsts.append(np.array(g)[i])
                    seconds.append(np.array(g)[j])
            if firsts:
                label = _roots(len(number), np.concatenate(firsts), np.concatenate(seconds))
                yield _forest(nodes, label)

    return spread.mapInArrow(run, _forest_schema()).distinct()


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    profile = checkpointed(profiles(keyed, percent))
    classes = checkpointed(
        profile.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    tied = components(clusters(classes, percent))
    linked = components(links(keyed, classes, tied, percent))
    rooted = classes.select("node", "doc_id").join(linked, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    group = rooted.join(least, "root").select("node", "component_id")
    # Equal sets may be a third of all rows: one row per set on the other side, AQE splits the rest.
    return profile.select("doc_id", "n_shingles", "node", "row_key").join(
        group, "node", "left"
    ).select(
        "doc_id", "n_shingles", "row_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document. Runs jobs when called."""
    return _grouped(docs, percent).drop("row_key")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that repeat one of a smaller id.

    Rows alike in doc_id and text are one document and stay once; documents without words stay.
    """
    kept = _grouped(docs, percent).where("kept").select("row_key").distinct()
    keyed = docs.select(
        F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.struct("*").alias("_row"))
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(
        ["row_key", "doc_id"]).select("_row.*")
