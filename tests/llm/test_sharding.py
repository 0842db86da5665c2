import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hexlytics.llm import sharding as S
from hexlytics.llm.tables import crc


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation_and_inverse(n, seed):
    numbers = np.arange(n)
    moved = S.permute(numbers, n, seed)
    assert sorted(moved) == list(range(n))
    assert (S.invert(moved, n, seed) == numbers).all()


def test_large_numbers_stay_in_range():
    n = 10**13 + 7
    some = np.array([0, 1, n // 2, n - 1])
    moved = S.permute(some, n)
    assert ((0 <= moved) & (moved < n)).all() and (S.invert(moved, n) == some).all()


def test_shards_are_even_gapless_and_repeatable(docs):
    rows = [(k, f"text {k}") for k in range(203)] + [(5, "text 5")] * 40 + [(None, None)] * 3
    df = docs(rows)
    out = S.shard(df, ["doc_id"], shards=8).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in sizes.values()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    place = lambda rows: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in rows)
    assert place(out) == place(S.shard(df.repartition(7), ["doc_id"], shards=8).collect())


def test_place_is_computable(docs):
    out = S.shard(docs([(k, "x") for k in range(50)]), ["doc_id"], shards=4).collect()
    for r in out:
        position = r["slot"] * 4 + r["shard"]
        assert S.invert([position], 50)[0] == r["row_number"] == r["doc_id"]


def test_keeps_other_columns(docs):
    out = S.shard(docs([(1, "a")]), ["doc_id"])
    assert {"score", "_key", "_row", "text"} <= set(out.columns)
    assert out.first()["score"] == "x"


def test_empty_table(empty):
    assert S.shard(empty, ["doc_id"]).count() == 0


def test_written_shards(docs, folder, spark):
    path = folder("shards")
    S.write_shards(docs([(k, f"t{k}") for k in range(30)], extra=False), path, ["doc_id"], 4)
    back = spark.read.parquet(path).collect()
    assert len(back) == 30 and {r["shard"] for r in back} == {0, 1, 2, 3}


@pytest.mark.parametrize("text", [None, "", "ä€😀", "x" * 100_000])
def test_crc_of_utf8(docs, text):
    found = docs([(1, text)]).select(crc_column()).first()[0]
    assert found == zlib.crc32((text or "").encode())


def crc_column():
    from pyspark.sql import functions as F

    return crc(F.col("text"))
