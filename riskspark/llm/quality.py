"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes sixteen numbers (counts of byte classes, words and lines, and ratios of
them). Trees grow level by level on binned columns; each is a complete binary tree, so a forest is
three flat arrays and a batch of documents walks all trees by array indexing.

The training set is bounded: at most ``max_rows`` labelled rows (20,000 unless set), chosen by a hash
of doc_id. Scoring covers all rows. Null text counts as empty and gets the score of an empty
document; a label row without quality or without a document is ignored; of contradicting label rows
of a document the lower quality counts; without any usable label every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import common

SYMBOLS = b"#*$%&|<>"
STATISTICS = [
    "log_bytes", "log_words", "word_length", "distinct_words", "upper", "digit", "symbol", "pipe", "stop", "bang",
    "wide", "lines_per_word", "repeated_lines", "capital_words", "symbol_words", "longest_word",
]
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
CLASSES = 9


def _byte_classes() -> np.ndarray:
    """Class of every byte: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 pipe, 6 stop, 7 bang, 8 wide."""
    table = np.zeros(256, np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = 1, 2, 3, 8
    table[list(SYMBOLS)] = 4
    table[ord("|")], table[ord("!")] = 5, 7
    table[list(b".,;:?")] = 6
    return table


BYTE_CLASS = _byte_classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for every text; an empty text has zeros."""
    data, lengths = common.concat_bytes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n) * CLASSES, lengths)
    counts = np.bincount(owner + BYTE_CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    shape = np.zeros((n, 7))
    for i, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        if words:
            ends = bytes(w[-1] for w in words)
            heads = bytes(w[0] for w in words)
            shape[i] = (len(words), len(set(words)), len(lines), len(lines) - len(set(lines)), max(map(len, words)),
                        len(heads) - len(heads.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
                        len(ends) - len(ends.translate(None, SYMBOLS)))
    words, size = np.maximum(shape[:, 0], 1), np.maximum(lengths, 1)
    share = counts / size[:, None]
    return np.column_stack([
        np.log1p(lengths), np.log1p(shape[:, 0]), lengths / words, shape[:, 1] / words, share[:, 2], share[:, 3],
        share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], shape[:, 2] / words,
        shape[:, 3] / np.maximum(shape[:, 2], 1), shape[:, 5] / words, shape[:, 6] / words, np.log1p(shape[:, 4])])


@dataclass(frozen=True)
class Forest:
    """Flat complete trees: ``feature`` and ``threshold`` [tree, inner node], ``leaf`` [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaf[t, node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
               ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boost trees on the logistic loss; every split comes from gradient histograms of binned columns."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Forest(np.zeros((1, inner), int), np.full((1, inner), np.inf), np.zeros((1, leaves)), 0.0)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    cut = np.full((width, bins), np.inf)
    for j, e in enumerate(edges):
        cut[j, :len(e)] = e
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width_now = 2**level - 1, 2**level
            slot = (node - first) * bins
            g = np.stack([np.bincount(slot + binned[:, j], grad, width_now * bins) for j in range(width)])
            h = np.stack([np.bincount(slot + binned[:, j], hess, width_now * bins) for j in range(width)])
            g, h = (np.cumsum(v.reshape(width, width_now, bins), axis=2) for v in (g, h))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least / 4) | (h_all - h < least / 4) | np.isinf(cut)[:, None, :]] = 0
            for k in range(width_now):
                j, b = np.unravel_index(np.argmax(gain[:, k]), (width, bins))
                if gain[j, k, b] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = j, cut[j, b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, node - inner]
    return Forest(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id",
          text_col: str = "text", **options) -> Forest:
    """Fit on at most ``max_rows`` labelled rows outside fold 0 of 5; only they reach the driver, as numbers."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (common.fold(F.col(id_col), 5) != 0))
              .groupBy(id_col).agg(F.min("quality").alias("quality")))
    chosen = common.hashed_sample(usable, id_col, max_rows, "quality")
    numbers = common.text_udf(lambda t: pa.array(list(statistics(t)), pa.list_(pa.float64())), T.ArrayType(T.DoubleType()))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = (texts.join(F.broadcast(chosen), id_col).select(id_col, "quality", numbers("text").alias("x"))
            .groupBy(id_col, "quality").agg(F.min("x").alias("x")).orderBy(id_col).limit(max_rows).collect())  # of texts that share an id the least
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_forest(x, np.array([float(r.quality > 0) for r in rows]), **options)


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); same-named columns are replaced."""

    def run(texts: list[bytes]) -> pa.Array:
        s = forest.score(statistics(texts))
        return common.struct_array(score=s, predicted=(s >= threshold).astype(np.int32))

    return common.add_fields(docs, common.text_udf(run, SCORE)(F.col(text_col)), ["score", "predicted"])
