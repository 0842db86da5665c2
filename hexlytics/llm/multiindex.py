"""Near duplicates among vectors: an inverted multi-index, its nearest cells, verified cosines.

Unit vectors are cut into two halves, and each half has a codebook of its own (k-means on a bounded
sample). A vector lies in the cell of the product grid that its two nearest codes name. From a vector, a
cell is at least as far as the planes that part its codes from the vector's own; the squares of both
halves add up. A multi-sequence traversal visits cells by that sum, nearest first; as the sums of two
sorted lists grow along both, the cells up to some reach lie under a staircase and are taken at once.

Vectors with a cosine of ``least`` differ by sqrt(2 - 2 least), so a reach of 2 - 2 ``least`` visits every
linked vector's cell. Less mostly does: ``CALIBRATION`` vectors are compared with all others, and the
reach is the least at which each of them finds all its links (the target recall, 1), with ``MARGIN`` on
top. With fewer than ``LEAST_LINKED`` linked vectors among them, the full reach is kept.

Cells are put together to blocks of at most about ``BLOCK`` vectors, a larger code is cut by ids, and each
vector goes as a query to the blocks with a cell it visits, in parts. Within a block each cell meets the
queries that visit it: cosines in double precision, and near the limit by the plain formula. A block
returns the links each query has in it and a spanning forest, never pairs.

Cases: null, empty and zero vectors and those with null or non-finite components link with nothing and are
their own component; equal vectors are one class that is compared once, each of them counts; rows of the
same id are rows of their own, ``component_id`` is the least id that is not null; vectors of different
sizes link with nothing of another size, each size has a grid of its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexlytics.llm.components import components
from hexlytics.llm.neardup import _roots
from hexlytics.session import checkpointed

LEAST = 0.95
SAMPLE = 16_384
CALIBRATION = 2048
LEAST_LINKED = 32
MARGIN = 0.25
MOST_CODES = 1024
PER_CELL = 8
BLOCK = 16_384
SEED = 13
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each code."""
    return np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1) - 2 * (x @ codes.T), 0)


def codebook(x: np.ndarray, size: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Codes by Lloyd's rounds; a code without points stays where it was."""
    codes = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    codes = codes[rng.choice(len(codes), min(size, len(codes)), replace=False)]
    for _ in range(rounds):
        own = _squares(x, codes).argmin(1)
        n = np.bincount(own, minlength=len(codes))
        order = np.argsort(own, kind="stable")
        starts = np.cumsum(n) - n
        met = np.flatnonzero(n)
        codes = codes.copy()
        codes[met] = np.add.reduceat(x[order], starts[met], axis=0) / n[met, None]
    return codes


@dataclass(frozen=True)
class Grid:
    """Two codebooks and the reach of a search; blocks of the first codebook's codes."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float
    block: np.ndarray | None = None  # first block of each code of the first half
    cuts: np.ndarray | None = None  # into how many blocks a code is cut

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = x.shape[1] // 2
        return x[:, :at], x[:, at:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_squares(h, b).argmin(1) for h, b in zip(self.halves(x), self.books))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, code) for each half: the square of how far the code's cell is at least."""
        out = []
        for half, book in zip(self.halves(x), self.books):
            square = _squares(half, book)
            own = square.argmin(1)
            apart = np.sqrt(_squares(book, book))[own]
            gap = square - square[np.arange(len(x)), own][:, None]
            far = np.divide(gap, 2 * apart, out=np.zeros_like(gap), where=apart > 0)
            out.append(np.maximum(far - _SLACK, 0) ** 2)
        return tuple(out)

    def own_block(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        first = self.cells(x)[0]
        return self.block[first] + _spread(nodes) % self.cuts[first]

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, block) of all blocks with a cell within reach: the least of the second half is 0."""
        who, code = np.nonzero(self.bounds(x)[0] <= self.reach)
        who = np.repeat(who, self.cuts[code])
        n = self.cuts[code]
        block = np.repeat(self.block[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.stack([who, block], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _spread(nodes: np.ndarray) -> np.ndarray:
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _linked(sims: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which cosines reach ``least``; those that rounding could tip by the plain formula."""
    hits = sims >= least
    i, j = np.nonzero(np.abs(sims - least) < _SLACK)
    if len(i):
        x, y = a[i], b[j]
        exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        hits[i, j] = exact >= least
    return hits


def _classes(rows: DataFrame) -> DataFrame:
    """(node, vector, n, least_id): distinct vectors, numbered."""
    each = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))
    return checkpointed(each.withColumn("node", F.monotonically_increasing_id()))


def _fitted(classes: DataFrame, n: int, sample: int, per_cell: int) -> Grid:
    some = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow()
    x = unit(_matrix(some.column("vector"), some.num_rows))
    size = min(MOST_CODES, max(2, math.ceil(math.sqrt(n / per_cell))))
    grid = Grid((x[:, :0], x[:, :0]), 0.0)
    first, second = grid.halves(x)
    return Grid((codebook(first, size), codebook(second, size)), 0.0)


def calibrated(classes: DataFrame, grid: Grid, least: float, many: int = CALIBRATION) -> float:
    """The reach at which each of ``many`` vectors finds all its links, with the margin."""
    full = 2 - 2 * least + _SLACK
    some = classes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(many).select("node", "vector").toArrow()
    asked = unit(_matrix(some.column("vector"), some.num_rows))
    names = some.column("node").to_numpy()
    shared = classes.sparkSession.sparkContext.broadcast((grid, asked, names, grid.bounds(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q, name, (a, b) = shared.value
        need = np.full(len(q), -1.0)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = unit(_matrix(part.column("vector"), part.num_rows))
                hits = (q @ x.T >= least - _SLACK) & (name[:, None] != part.column("node").to_numpy())
                who, which = np.nonzero(hits)
                i, j = index.cells(x)
                np.maximum.at(need, who, a[who, i[which]] + b[who, j[which]])
        met = np.flatnonzero(need >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(need[met])], names=["q", "need"])

    # A row per sampled vector with links, at most.
    found = classes.select("node", "vector").mapInArrow(run, "q long, need double").groupBy("q").agg(
        F.max("need").alias("need")).toPandas()
    if len(found) < LEAST_LINKED:
        return full
    return min(full, float(found["need"].max()) * (1 + MARGIN) + _SLACK)


def _dealt(classes: DataFrame, grid: Grid, block: int) -> Grid:
    """The grid with its codes put together to blocks of about ``block`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(grid.books[0]), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("vector"), batch.num_rows))
                n += np.bincount(grid.cells(x)[0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["code", "n"])

    # A row per code, at most MOST_CODES.
    counted = classes.select("vector").mapInArrow(run, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")).toPandas().sort_values("code")["n"].to_numpy()
    # Codes along the direction in which they differ most, so that near ones share blocks.
    centred = grid.books[0] - grid.books[0].mean(0)
    along = np.linalg.svd(centred, full_matrices=False)[2][0] if centred.size else np.zeros(0)
    first, cuts, at, held = np.zeros(len(counted), np.int64), np.ones(len(counted), np.int64), 0, 0
    for code in np.argsort(centred @ along, kind="stable") if centred.size else range(len(counted)):
        if counted[code] > block or held + counted[code] > block:
            at, held = at + (held > 0), 0
        first[code], cuts[code] = at, max(1, -(-int(counted[code]) // block))
        if cuts[code] > 1:
            at += int(cuts[code])
        else:
            held += int(counted[code])
    return Grid(grid.books, grid.reach, first, cuts)


def _met(grid: Grid, least: float, there: pa.Table, asking: pa.Table, visits: bool = False) -> pa.Table:
    """(node, n_links, a, b, compared) of a block: what each query is linked with, and a forest."""
    names, asked = there.column("node").to_numpy(), asking.column("node").to_numpy()
    none = pa.table({"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()),
                     "other": pa.array([], pa.int64()), "compared": pa.array([], pa.int64())})
    if not len(names) or not len(asked):
        return none
    raw, raw_q = (_matrix(t.column("vector"), t.num_rows) for t in (there, asking))
    x, q, weight = unit(raw), unit(raw_q), there.column("n").to_numpy()
    i, j = grid.cells(x)
    a, b = grid.bounds(q)
    order = np.lexsort((j, i))
    i, j, x, raw, weight, names = i[order], j[order], x[order], raw[order], weight[order], names[order]
    edge = np.flatnonzero(np.diff(i, prepend=-1) | np.diff(j, prepend=-1))
    links, compared = np.zeros(len(asked), np.int64), 0
    label = np.arange(len(names) + len(asked))  # candidates, then queries
    for low, high in zip(edge, [*edge[1:], len(i)]):
        who = np.flatnonzero(a[:, i[low]] + b[:, j[low]] <= grid.reach)
        for k in range(0, len(who), 512):
            some = who[k:k + 512]
            compared += len(some) * int(high - low)
            hits = _linked(q[some] @ x[low:high].T, raw_q[some], raw[low:high], least)
            hits &= asked[some][:, None] != names[low:high]
            if not hits.any():
                continue
            links[some] += hits @ weight[low:high]
            s, t = np.nonzero(hits & (label[len(names) + some][:, None] != label[low:high]))
            if len(s):
                roots = _roots(len(label), label[len(names) + some[s]], label[low + t])
                label = roots[label]
    both = np.concatenate([names, asked])
    tied = np.flatnonzero(label != np.arange(len(label)))
    met = np.flatnonzero(links)
    zero = np.zeros(len(tied), np.int64)
    return pa.table({
        "node": np.concatenate([asked[met], both[tied], [-1]]).astype(np.int64),
        "n_links": np.concatenate([links[met], zero, [0]]).astype(np.int64),
        "other": pa.array([*[None] * len(met), *both[label[tied]].tolist(), None], pa.int64()),
        "compared": np.concatenate([np.zeros(len(met), np.int64), zero, [compared]]).astype(np.int64)})


def _searched(classes: DataFrame, least: float, block: int, full: bool, sample: int, per_cell: int
              ) -> DataFrame:
    """(node, n_links, other, compared): rows with links of a node, edges, and counts of comparisons
    (node -1). ``classes`` hold vectors of one size."""
    n = classes.count()
    block = min(block, max(256, -(-n // 4)))
    grid = _fitted(classes, n, sample, per_cell)
    reach = 2 - 2 * least + _SLACK if full else calibrated(classes, grid, least)
    grid = _dealt(classes, Grid(grid.books, reach), block)
    parts = -(-n // block)
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("vector"), batch.num_rows))
                block_ = shared.value.own_block(x, batch.column("node").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_)], names=[*batch.schema.names, "block"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = unit(_matrix(part.column("vector"), part.num_rows))
                who, block_ = shared.value.visited(x)
                taken = part.take(pa.array(who))
                node = taken.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(block_), pa.array(_spread(node + 1) % parts)],
                    names=[*part.schema.names, "block", "part"])

    vector = classes.schema["vector"].dataType.simpleString()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = classes.select("node", "n", "vector").mapInArrow(
        there, f"node long, n long, vector {vector}, block long").withColumn("part", every)
    right = classes.select("node", "vector").mapInArrow(
        asking, f"node long, vector {vector}, block long, part long")
    keys = ["block", "part"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(
        lambda a, b: _met(shared.value, least, a, b), "node long, n_links long, other long, compared long")


def searched(df: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding",
             block: int = BLOCK, full: bool = False, sample: int = SAMPLE, per_cell: int = PER_CELL
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that take part or not, classes of equal vectors, what the search of their cells found).

    ``full``: keep the reach that no link can escape, whatever the sample says. Runs jobs when called.
    """
    v = F.col("vector")
    odd = [float("inf"), float("-inf"), float("nan")]
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~x.cast("double").isin(odd)) & F.exists(
        v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn(
        "fine", F.coalesce(fine, F.lit(False)))
    classes = _classes(rows.where("fine"))
    empty = classes.select("node", F.col("n").alias("n_links"), F.lit(0).cast("long").alias("other"),
                           F.lit(0).cast("long").alias("compared")).limit(0)
    # Mostly one size; a grid for each.
    sizes = [r["s"] for r in classes.groupBy(F.size("vector").alias("s")).count().orderBy("s").collect()]
    found = empty
    for size in sizes:
        of = classes if len(sizes) == 1 else classes.where(F.size("vector") == size)
        found = found.unionByName(_searched(of, least, block, full, sample, per_cell))
    return rows, classes, checkpointed(found)


def near_duplicates(df: DataFrame, least: float = LEAST, id_col: str = "vec_id",
                    vector_col: str = "embedding", **options) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``df``. Runs jobs when called."""
    rows, classes, found = searched(df, least, id_col, vector_col, **options)
    links = found.where("node >= 0").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.where("other is not null").select(
        F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = classes.select("node", "n", "vector", "least_id").join(
        links, "node", "left").join(roots, "node", "left").select(
        "vector", "least_id", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    least_ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = rooted.join(least_ids, "root").select("vector", "n_links", "component_id")
    # Equal vectors may be many rows, but they meet one row here; AQE splits them.
    linked = rows.where("fine").join(told, "vector").select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
