"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of given columns. The numbers 0 to n - 1 are permuted by a Feistel
network over the next power of four, walking along the cycle until the number is below n again.
The permuted number gives the shard (remainder) and the slot in it (quotient), so the place of a
row, and the row of a place, are computed and never looked up.

Law: ``rows`` (shard sizes differ by at most one). Cases: null text has size 1 and the crc of no
bytes; repeated rows take places of their own, whichever of them comes first; null ids sort first;
an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hexlytics.llm.order import row_numbers

ROUNDS = 8
SHARDS = 16
SEED = 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(steps + np.uint64(seed))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << shift) | right


def _walk(numbers: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    out = np.asarray(numbers).astype(np.uint64)
    half, keys = _half_bits(n), _keys(seed)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], half, keys, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permute(numbers, n: int, seed: int = SEED) -> np.ndarray:
    """Row numbers (each below n) to shuffled positions, one to one."""
    return _walk(numbers, n, seed, back=False)


def invert(positions, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that ``permute`` sends to these positions."""
    return _walk(positions, n, seed, back=True)


def shard(df: DataFrame, order: Sequence[str | Column], shards: int = SHARDS, seed: int = SEED
          ) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to every row, in place of columns so named.

    Runs the numbering (a range shuffle and a checkpoint) when called, to learn n. Rows that tie
    in ``order`` are spread over partitions, so repeated rows make no large one.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = F.monotonically_increasing_id() % 1024
    rows = df.select(F.struct("*").alias("_row"), *[
        c.alias(f"_key{k}") for k, c in enumerate([*keys, spread])])
    numbered = row_numbers(rows, rows.columns[1:], "row_number").select("_row", "row_number")
    n = numbered.count()

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    added = ("row_number", "shard", "slot")
    kept = [F.col(f"_row.{c}").alias(c) for c in df.columns if c not in added]
    return numbered.withColumn("_position", position("row_number")).select(
        *kept, "row_number", (F.col("_position") % shards).cast("int").alias("shard"),
        F.floor(F.col("_position") / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, order: Sequence[str | Column], shards: int = SHARDS,
                 seed: int = SEED, rows_per_file: int = 1 << 20) -> None:
    """Write the rows under ``path/shard=K``, sorted by slot, in files of bounded length."""
    placed = shard(df, order, shards, seed).withColumn(
        "_file", F.floor(F.col("slot") / rows_per_file))
    (placed.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot")
     .drop("_file", "row_number").write.partitionBy("shard").parquet(path))
