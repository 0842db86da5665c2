"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts, in one pass. The trees are fitted on the driver from a
bounded sample of labelled rows: ``SAMPLE_ROWS`` documents, those with the smallest hashes of
their ids, so the same ones in every run. Each feature is cut into at most ``BINS`` quantile bins;
trees have fixed depth and are flattened into arrays (tree, node), which numpy walks level by
level for all rows of a batch.

Cases: null and empty texts have all-zero statistics and get a score like any other; a document
with several labels counts with its lowest; labels that are null or name no document are unused;
with no labelled rows, or one label only, every score is the (smoothed) share of label 1; repeated
rows and further columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from hexlytics.llm.tables import map_columns

SAMPLE_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 2.0  # of the second derivatives on each side of a cut
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7

_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "quote", "mark", "pipe",
            "money", "hash", "bracket", "other", "wide")
_MEMBERS = {
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789", "blank": " \t", "line": "\n\r\x0b\x0c", "stop": ".", "comma": ",;:",
    "quote": "\"'-", "mark": "!?", "pipe": "|/\\", "money": "$%&", "hash": "#*@~^_=+",
    "bracket": "<>()[]{}",
}
FEATURES = tuple(f"share_{c}" for c in _CLASSES) + (
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_lines", "words_per_line",
    "words_per_stop", "capital_words", "all_capital_words", "marked_words", "top_word",
    "repeated_pairs",
)


def _table_of_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    table[128:] = _CLASSES.index("wide")
    for name, members in _MEMBERS.items():
        table[list(members.encode())] = _CLASSES.index(name)
    return table


_TABLE = _table_of_classes()


def statistics(text: str | None) -> list[float]:
    """The numbers named by ``FEATURES``, of the whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(_TABLE[data], minlength=len(_CLASSES))
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    lengths = list(map(len, words))
    ends = sum(not (w[-1].isalnum() or w[-1] in ".,;:") for w in words)
    frequent = max(Counter(words).values()) / n
    return [
        *(counts / max(1, len(data))).tolist(),
        float(np.log1p(n)), sum(lengths) / n, float(max(lengths)), distinct / n,
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        n / (1.0 + counts[_CLASSES.index("stop")]), sum(w[0].isupper() for w in words) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n, ends / n, frequent,
        1.0 - pairs / max(1, n - 1),
    ]


@dataclass(frozen=True)
class Model:
    """Complete trees of one depth: node k has children 2k + 1 (low) and 2k + 2 (high)."""

    base: float
    feature: np.ndarray  # (tree, node)
    cut: np.ndarray  # (tree, node); low side: value <= cut
    leaf: np.ndarray  # (tree, leaf)

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def _bins(column: np.ndarray) -> np.ndarray:
    """Upper ends of all bins but the last."""
    ends = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
    return ends[ends < column.max()] if len(column) else ends


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosting of logistic loss with second-order leaves; every cut comes from histograms."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    ends = [_bins(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(ends)], 1)
    margin = np.full(len(y), base)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, bend = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            at = (node - first) * BINS
            for j, e in enumerate(ends):
                if not len(e):
                    continue
                g = np.bincount(at + binned[:, j], slope, width * BINS).reshape(width, BINS)
                h = np.bincount(at + binned[:, j], bend, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = (gl ** 2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE)
                        - ga ** 2 / (ha + RIDGE))
                gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
                gain = gain[:, :len(e)]
                pick = gain.argmax(1)
                got = gain[np.arange(width), pick]
                better = got > best
                best[better] = got[better]
                feature[first:first + width][better] = j
                cut[first:first + width][better] = e[pick[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, slope, leaves) / (
            np.bincount(leaf_of, bend, leaves) + RIDGE)
        margin += leaf[leaf_of]
        trees.append((feature, cut, leaf))
    return Model(base, *(np.stack(part) for part in zip(*trees)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Runs one small job."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(fold(F.col("doc_id")) != HELD_OUT)
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` ids.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = map_columns(
        known, ["text"], lambda t: [list(map(statistics, t))], "_x array<double>"
    ).select("doc_id", "_x", "_quality").orderBy("doc_id").toPandas()
    x = np.array(found["_x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["_quality"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns plus ``score``; a column of that name is replaced."""
    def make(texts):
        x = np.array(list(map(statistics, texts)), float).reshape(len(texts), len(FEATURES))
        return [model.scores(x)]

    return map_columns(docs, ["text"], make, "score double")


def accept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, with their own columns, whose score is at least ``least``."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return score(rows, model).where(F.col("score") >= least).select("_row.*")
