"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features and flattened into arrays, one complete binary tree a row,
so that scoring a batch walks all trees at once in numpy. The model is fitted on the driver from at most
`max_rows` labelled documents, chosen by a hash of their id; scoring covers every document.

A null text is an empty one and gets the score of its (zero) statistics; a long one is measured whole. Labels that
contradict each other or repeat count as often as they stand, repeated documents too; of equal splits the first feature
and the lowest cut are taken. Without any label, every score is 1.0: nothing is rejected. An empty table gives an empty
one. Other columns keep their values, but none may be called `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, new_columns
from graphloom.llm.textstats import measure

FOLDS = 5
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    m = measure(text)
    n, b, lines = max(1, m["n_words"]), max(1, m["n_bytes"]), max(1, m["n_lines"])
    letters = max(1, m["n_upper"] + m["n_lower"])
    return [
        np.log1p(m["n_words"]),
        m["word_chars"] / n,
        m["n_symbols"] / n,
        m["n_bars"] / n,
        m["n_marks"] / n,
        m["n_stops"] / n,
        m["n_upper"] / letters,
        m["n_digits"] / b,
        m["n_high"] / b,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / n,
        m["n_distinct"] / n,
        m["n_once"] / n,
        m["top_word"] / n,
        m["n_stutter"] / n,
        m["word_entropy"],
        m["word_entropy"] / np.log1p(n),
        n / lines,
        np.log1p(lines),
        np.log1p(m["longest_line"]),
    ]


N_FEATURES = 20


@dataclass
class Forest:
    """Complete binary trees of one depth: row t has tree t; a node's children are at 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    leaf: np.ndarray  # (trees, leaves)
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x, all trees walked at once."""
        trees, inner = self.feature.shape
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.bias + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0,
    least: float = 1.0,
) -> Forest:
    """Gradient boosting of the logistic loss; `least` is the least hessian in a leaf."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0:
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), 40.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), bias)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            first, count = 2**d - 1, 2**d
            local = node - first
            best = np.full(count, 1e-9)
            cut_of = np.full(count, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * width + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, : len(c)], hs[:, : len(c)]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best
                best[better] = value[better]
                cut_of[better] = at[better]
                out.feature[t, first : first + count][better] = j
            split = np.flatnonzero(cut_of >= 0)
            for k in split:
                out.threshold[t, first + k] = cuts[out.feature[t, first + k]][cut_of[k]]
            right = x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node]
            node = 2 * node + 1 + right
        at = node - inner
        out.leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += out.leaf[t, at]
    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _featured(documents: DataFrame, keys: list[str], forest: Forest | None) -> DataFrame:
    """Keys (the text may be one) with `x`, the features, or with `score` if there is a forest."""
    kinds = dict(documents.dtypes)
    value = "score double" if forest else "x array<double>"
    new_columns(keys, [value.split()[0]])
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), value])

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            last = pa.array(forest.score(x)) if forest else pa.array(list(x), pa.list_(pa.float64()))
            own = [batch.column(k) for k in keys]
            return pa.RecordBatch.from_arrays([*own, last], names=[*keys, value.split()[0]])

        return run

    return map_batches(documents.select(*dict.fromkeys([*keys, "text"])), make, schema)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Fit on labelled documents outside the held-out fold; at most `max_rows`, chosen by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = _featured(texts, ["doc_id", "quality"], None).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(max_rows)
    got = rows.toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return fit(x, np.array(got.column("quality").to_pylist(), np.float64))


def classify(documents: DataFrame, forest: Forest) -> DataFrame:
    """The documents' columns but the text, with `score`; rows are returned one for one."""
    keys = [c for c in documents.columns if c != "text"]
    return _featured(documents, keys, forest)


def keep_scored(documents: DataFrame, forest: Forest) -> DataFrame:
    """The documents, text and all, with `score`: the text passes through the map, so nothing is joined."""
    return _featured(documents, documents.columns, forest)
