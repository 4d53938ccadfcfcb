"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are taken once (see features.py).  Trees are fitted on a
bounded sample of labelled rows: features are cut into at most BINS bins by quantiles, and
each split is found on histograms of gradients.  A tree is complete to its depth, so a
forest is three arrays (feature, threshold, leaf value) and a batch of documents is scored by
stepping all rows and trees down together in numpy.

Null and empty texts have statistics of zero and get a score like any other.  Without
labelled rows every score is 0.5.  Repeated rows are scored alike; a document with several
labels gives a training row for each.  A row without a doc_id is scored and has a null
``held_out``.  Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.llm import features
from vaakya.llm.scratch import materialise

#: Labelled rows a model is fitted on at most; those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST_WEIGHT, RIDGE = 64, 4, 120, 0.1, 4.0, 1.0
#: A score from which a text is predicted good.
CUT = 0.3


@dataclass
class Forest:
    """Complete trees as arrays: [tree, inner node] and [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        margin = np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))[None, :]
        for lo in range(0, len(x), 1024):
            rows = x[lo : lo + 1024]
            at = np.zeros((len(rows), len(self.leaf)), np.int64)
            index = np.arange(len(rows))[:, None]
            for _ in range(int(np.log2(self.feature.shape[1] + 1)) if len(self.leaf) else 0):
                right = rows[index, self.feature[trees, at]] > self.threshold[trees, at]
                at = 2 * at + 1 + right
            if len(self.leaf):
                margin[lo : lo + 1024] += self.leaf[trees, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for 0/1 labels by logistic loss; deterministic."""
    n, width = x.shape if len(x) else (0, 0)
    inner = (1 << DEPTH) - 1
    if not n:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
    margin = np.full(n, base)
    feature, threshold, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f_tree, t_tree = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, count = (1 << depth) - 1, 1 << depth
            best = np.full(count, 1e-6)
            where = [(-1, 0)] * count
            for f in range(width):
                key = (node - first) * BINS + binned[:, f]
                gs = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)
                hs = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(1)
                top = gain[np.arange(count), b]
                for k in np.flatnonzero(top > best):
                    best[k], where[k] = top[k], (f, int(b[k]))
            for k, (f, b) in enumerate(where):
                if f >= 0:
                    f_tree[first + k], t_tree[first + k] = f, edges[f][b]
            right = x[np.arange(n), f_tree[node]] > t_tree[node]
            node = 2 * node + 1 + right
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        values = -RATE * gs / (hs + RIDGE)
        margin += values[node - inner]
        feature.append(f_tree)
        threshold.append(t_tree)
        leaf.append(values)
    return Forest(np.stack(feature), np.stack(threshold), np.stack(leaf), base)


def _score(batches: Iterator[pa.RecordBatch], forest: Forest, cut: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("features").values.to_numpy().reshape(-1, len(features.NAMES)) if batch.num_rows else np.zeros((0, len(features.NAMES)))
        scores = forest.score(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )


def fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train_sample(labels: DataFrame, label: str, train, limit: int) -> DataFrame:
    """doc_id and label of at most ``limit`` labelled training rows, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: quality of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = materialise(texts.mapInArrow(features.table, "doc_id long, features array<double>"), "stats")
    sample = train_sample(labels, "quality", fold(F.col("doc_id"), 5) != 0, limit)
    rows = stats.join(sample, "doc_id").orderBy("doc_id", "label").limit(limit).select("features", "label").toPandas()
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(features.NAMES))
    forest = fit(x, rows["label"].to_numpy(np.float64))
    scored = stats.mapInArrow(lambda it: _score(it, forest, cut), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
