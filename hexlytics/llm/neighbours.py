"""Nearest neighbours by cosine: a forest of random-projection trees, exact reranking of leaves.

The trees are fitted on the driver from a bounded sample (``SAMPLE_ROWS`` vectors, those with the
smallest hashes of their ids); every vector is then routed to one leaf of every tree. A query
walks all trees through one priority queue ordered by the smallest distance to a cutting plane on
the way, until the leaves seen hold ``EFFORT`` times as many rows as the table. Queries and rows
meet leaf by leaf, in blocks of bounded size, and cosines are computed exactly in double
precision; each block returns only its best few per query.

Cases: vectors that are null, empty, zero, hold null or non-finite components or have no id take no
part, as query or candidate; vectors are searched among those of their own dimension, with a forest
for each; equal vectors are searched as one
and put back afterwards, smallest ids first; rows alike in id and vector count once, and a
candidate with the query's own id never counts; with fewer than k candidates all are returned; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hexlytics.session import checkpointed

SAMPLE_ROWS = 16_384
# Small leaves follow the cutting planes closely and more trees overlap less, so fewer vectors are
# compared for the same recall; each tree costs one more copy of the vectors in the shuffle.
TREES = 16
LEAF_ROWS = 32  # of the sample
EFFORT = 0.7
BLOCK = 16_384  # rows, and queries, of a leaf that meet in one task
SEED = 5


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one numbering; a child below 0 is leaf ``-child - 1`` of its tree."""

    roots: np.ndarray
    normal: np.ndarray  # (node, dimension)
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf of each unit vector."""
        out = np.empty((len(unit), len(self.roots)), np.int32)
        for tree, root in enumerate(self.roots):
            at = np.full(len(unit), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", unit[inner], self.normal[node]) > self.cut[node]
                at[inner] = np.where(side, self.high[node], self.low[node])
            out[:, tree] = -at - 1
        return out

    def search(self, unit: np.ndarray, rows: np.ndarray, enough: float, least: int
               ) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) of one query, best first, until they hold ``enough`` rows and one
        tree's leaves alone hold ``least``."""
        margin = self.normal @ unit - self.cut if len(self.normal) else np.zeros(0)
        queue = [(0.0, tree, int(root)) for tree, root in enumerate(self.roots)]
        heapq.heapify(queue)
        out, total, own = [], 0, np.zeros(len(self.roots), np.int64)
        while queue and (total < enough or own.max() < least):
            far, tree, at = heapq.heappop(queue)
            while at >= 0:
                m = margin[at]
                near, other = (self.high, self.low) if m > 0 else (self.low, self.high)
                heapq.heappush(queue, (max(far, abs(m)), tree, int(other[at])))
                at = int(near[at])
            leaf = -at - 1
            out.append((tree, leaf))
            total += rows[tree, leaf]
            own[tree] += rows[tree, leaf]
        return out


def fit(unit: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED
        ) -> Forest:
    """Cut between the means of two random halves, at the median, down to small leaves."""
    rng = np.random.default_rng(seed)
    normal, cut, low, high, roots = [], [], [], [], []

    def plane(rows: np.ndarray) -> np.ndarray:
        a, b = unit[rng.choice(rows, 2, replace=False)]
        some = unit[rng.choice(rows, min(256, len(rows)), replace=False)]
        for _ in range(3):
            nearer = some @ a > some @ b
            if nearer.all() or not nearer.any():
                break
            a, b = some[nearer].mean(0), some[~nearer].mean(0)
        return a - b

    for _ in range(trees):
        leaves = 0
        # (rows, where the node's number goes); an explicit stack, so depth is no concern
        root = [0]
        stack = [(np.arange(len(unit)), root, 0)]
        while stack:
            rows, where, side = stack.pop()
            child = None
            if len(rows) > leaf_rows:
                w = plane(rows)
                if np.linalg.norm(w) < 1e-12:
                    w = rng.standard_normal(unit.shape[1])
                w = w / np.linalg.norm(w)
                along = unit[rows] @ w
                c = float(np.median(along))
                up = along > c
                if up.any() and not up.all():
                    child = len(normal)
                    normal.append(w), cut.append(c), low.append(0), high.append(0)
                    stack += [(rows[~up], low, child), (rows[up], high, child)]
            if child is None:
                leaves += 1
                child = -leaves
            where[side] = child
        roots.append(root[0])
    shape = (0, unit.shape[1] if unit.ndim == 2 else 0)
    return Forest(np.array(roots, np.int64), np.array(normal).reshape(-1, *shape[1:]),
                  np.array(cut), np.array(low, np.int64), np.array(high, np.int64))


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the same two vectors always give the same double."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) rows that take part, each once."""
    v = F.col("vector")
    infinite = [float("inf"), float("-inf"), float("nan")]
    fine = (
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~x.cast("double").isin(infinite))
        & F.exists(v, lambda x: x != 0)
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.where(F.coalesce(fine, F.lit(False))).distinct()


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES, effort: float = EFFORT,
            sample_rows: int = SAMPLE_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): up to k neighbours of each row where ``is_query`` holds.

    ``is_query`` is a condition on ``id``. Small jobs run when called: the sample is collected
    (bounded), leaf sizes are counted (trees x leaves numbers), routed queries are checkpointed.
    """
    rows = checkpointed(usable(df, id_col, vector_col))
    # Mostly one dimension.
    sizes = [r["s"] for r in rows.groupBy(F.size("vector").alias("s")).count().orderBy("s").collect()]
    parts = [_nearest(rows if len(sizes) == 1 else rows.where(F.size("vector") == s), is_query, k, trees,
                      effort, sample_rows, block) for s in sizes]
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id",
                           F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _nearest(rows: DataFrame, is_query: Column, k: int, trees: int, effort: float, sample_rows: int,
             block: int) -> DataFrame:
    """As ``nearest``, for usable vectors of one dimension."""
    # Equal vectors: the k + 1 smallest ids are all that k neighbours can need.
    nth = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    members = checkpointed(
        rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")))
    index = members.select(F.element_at("members", 1).alias("rep"), "vector")
    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toPandas()
    n = index.count()
    forest = fit(_units(sample["vector"]), trees)
    id_type = dict(rows.dtypes)["id"]
    vector_type = dict(rows.dtypes)["vector"]

    def route(batches):
        for pdf in batches:
            if len(pdf):
                found = forest.leaves(_units(pdf["vector"]))
                for tree in range(found.shape[1]):
                    yield pdf.assign(tree=np.int32(tree), leaf=found[:, tree])

    routed = index.mapInPandas(
        route, f"rep {id_type}, vector {vector_type}, tree int, leaf int")
    # Trees x leaves rows, whatever the size of the table.
    counted = routed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_rows"))
    leaf_rows = counted.toPandas()
    shape = (trees, int(leaf_rows["leaf"].max()) + 1)
    row_counts = np.zeros(shape, np.int64)
    row_counts[leaf_rows["tree"], leaf_rows["leaf"]] = leaf_rows["n_rows"]

    def walk(batches):
        for pdf in batches:
            for query, vector, unit in zip(
                    pdf["id"], pdf["vector"], _units(pdf["vector"]) if len(pdf) else ()):
                seen = forest.search(unit, row_counts, effort * n, k + 1)
                yield pd.DataFrame({
                    "query_id": query, "vector": [vector] * len(seen),
                    "tree": np.array([t for t, _ in seen], np.int32),
                    "leaf": np.array([x for _, x in seen], np.int32)})

    queries = checkpointed(rows.where(is_query).mapInPandas(
        walk, f"query_id {id_type}, vector {vector_type}, tree int, leaf int"))
    asked = queries.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_queries"))
    # Also trees x leaves rows; a leaf with many rows or queries is cut into blocks of each.
    blocks = F.broadcast(
        spark_frame(rows, leaf_rows).join(asked, ["tree", "leaf"]).select(
            "tree", "leaf", F.ceil(F.col("n_rows") / block).cast("int").alias("row_blocks"),
            F.ceil(F.col("n_queries") / block).cast("int").alias("query_blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = routed.join(blocks, ["tree", "leaf"]).select(
        "tree", "leaf", "rep", "vector",
        F.pmod(F.xxhash64("rep"), F.col("row_blocks")).cast("int").alias("row_block"),
        every("query_blocks").alias("query_block"))
    right = queries.join(blocks, ["tree", "leaf"]).select(
        "tree", "leaf", "query_id", "vector",
        F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"),
        every("row_blocks").alias("row_block"))

    def rerank(there: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "rep": [], "score": []})
        if not len(there) or not len(asking):
            return out
        x = np.stack([np.asarray(v, np.float64) for v in there["vector"]])
        ux, ids = _units(there["vector"]), there["rep"].to_numpy()
        parts = []
        for lo in range(0, len(asking), 256):
            some = asking.iloc[lo:lo + 256]
            q = np.stack([np.asarray(v, np.float64) for v in some["vector"]])
            rough = _units(some["vector"]) @ ux.T
            # A few more than needed, as the rough cosines may differ in the last digits.
            many = min(k + 4, len(ids))
            best = np.argpartition(-rough, many - 1, axis=1)[:, :many]
            # The worst one kept may tie with one left out; then all that tie are compared.
            floor = np.take_along_axis(rough, best, 1).min(1) - 1e-12
            who, which = np.nonzero(rough >= floor[:, None])
            parts.append(pd.DataFrame({
                "query_id": some["query_id"].to_numpy()[who], "rep": ids[which],
                "score": _cosine(q[who], x[which])}))
        found = pd.concat(parts).sort_values(
            ["query_id", "score", "rep"], ascending=[True, False, True])
        return found.groupby("query_id").head(k + 1)

    keys = ["tree", "leaf", "row_block", "query_block"]
    pairs = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(
        rerank, f"query_id {id_type}, rep {id_type}, score double"
    ).groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    top = pairs.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= k + 1)
    back = top.join(
        members.select(F.element_at("members", 1).alias("rep"), "members"), "rep"
    ).select("query_id", "score", F.explode("members").alias("id")).where("id != query_id")
    once = back.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def spark_frame(like: DataFrame, pdf: pd.DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(
        pdf.astype({"tree": "int32", "leaf": "int32", "n_rows": "int64"}))
