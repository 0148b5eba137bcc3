"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics are computed where the text is. The trees are fitted on a sample of labelled rows (``max_rows`` at most, in
the order of a hash of their ids), which is small enough for the driver: 28 numbers a row. All trees have one depth, so
they are flattened into three arrays (feature, threshold, value by heap position), and a batch of rows goes down all
trees together, one level at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small

MAX_ROWS = 20_000
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_SYMBOL = np.array([chr(c) in "#$%&*+/<=>@[\\]^_`{|}~" for c in range(256)])
_PUNCTUATION = np.array([chr(c) in ".,;:?'\"()-" for c in range(256)])
_ENDS = frozenset(b".!?:;\"')")
N_FEATURES = 28


def statistics(text: str | None) -> list[float]:
    """``N_FEATURES`` numbers of one whole text; those of an empty text are 0."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (N_FEATURES - 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, nw = len(raw), len(words)
    letters = int(hist[_LETTER].sum() + hist[128:].sum())
    share = hist[hist > 0] / n
    counts = Counter(words)
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    line_counts = Counter(lines)
    pairs = Counter(zip(words, words[1:]))
    length = np.fromiter(map(len, words), np.int32, nw)
    last = [w[-1] for w in words]
    first = [w[0] for w in words]
    n_pairs = max(nw - 1, 1)
    return [
        math.log1p(n), math.log1p(nw), float(length.mean()), float(length.std()), float(length.max()),
        letters / n, hist[48:58].sum() / n, hist[_UPPER].sum() / max(letters, 1), hist[_SYMBOL].sum() / n, hist[_PUNCTUATION].sum() / n,
        hist[33] / n, hist[124] / n, hist[128:].sum() / n, hist[10] / n, (hist[32] + hist[9] + hist[10]) / n,
        float(-(share * np.log2(share)).sum()),
        len(counts) / nw, max(counts.values()) / nw, math.log1p(nw) * len(counts) / nw,
        sum(a == b for a, b in zip(words, words[1:])) / n_pairs, 1 - len(pairs) / n_pairs, max(pairs.values(), default=0) / n_pairs,
        len(line_counts) / max(len(lines), 1), sum(len(x) * (k - 1) for x, k in line_counts.items()) / n, math.log1p(n / max(len(lines), 1)),
        sum(x[-1] in _ENDS for x in lines) / max(len(lines), 1),
        sum(x in b"#$%&*|!" for x in last) / nw, sum(65 <= x <= 90 for x in first) / nw,
    ]


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float32).reshape(-1, N_FEATURES)


@dataclass
class Trees:
    """``feature`` and ``threshold`` (trees, 2**depth - 1) of inner nodes in heap order, ``value`` (trees, 2**depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.base + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_rows: float = 5.0) -> Trees:
    """Logistic loss, Newton steps, histograms of ``bins`` quantile bins. Rows of one class give a constant score."""
    n, k = x.shape
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    inner, base = 2**depth - 1, math.log(p / (1 - p))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1), np.float64), base)
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])  # bin b: cuts[b-1] < x <= cuts[b]
    margin = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(n, np.int64)  # number within its level
        for level in range(depth):
            width = 1 << level
            best, split = np.zeros(width), [(0, np.inf, bins)] * width
            for j in range(k):
                key = node * bins + binned[j]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                m = np.bincount(key, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gain = g**2 / (h + l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[(m < min_rows) | (m[:, -1:] - m < min_rows)] = -1
                at = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                    if at[w] < len(cuts[j]):
                        best[w], split[w] = gain[w, at[w]], (j, cuts[j][at[w]], at[w])
            for w, (j, cut, _) in enumerate(split):
                out.feature[t, width - 1 + w], out.threshold[t, width - 1 + w] = j, cut
            feature, edge = np.array([s[0] for s in split]), np.array([s[2] for s in split])
            node = 2 * node + (binned[feature[node], np.arange(n)] > edge[node])
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        out.value[t] = rate * g / (h + l2)
        margin += out.value[t][node]
    return out


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % parts


def labelled_sample(labels: DataFrame, label_col: str, allowed: Column, max_rows: int, id_col: str) -> DataFrame:
    """(id, y) of at most ``max_rows`` rows with a label, in the order of a hash of the id."""
    rows = labels.where(allowed & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("l_id"), "y").limit(max_rows)


def fit_quality(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on at most ``max_rows`` labelled rows for which ``allowed`` (over the columns of labels) holds.

    A null text counts as empty; a null id or label teaches nothing; a label that is repeated, or whose id is, counts as
    often as it occurs. Without rows, or with rows of one class, the score is a constant.
    """
    sample = small(labelled_sample(labels, label_col, allowed, max_rows, id_col), 16 * max_rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": list(matrix(b["text"]).astype(np.float64))})

    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(sample, F.col("d_id") == F.col("l_id"))
    got = rows.select("text", "y").mapInPandas(measure, "y double, x array<double>").toPandas()
    x, y = np.array(got["x"].tolist(), np.float32).reshape(-1, N_FEATURES), got["y"].to_numpy(np.float64)
    order = np.lexsort((y, *x.T))  # sums of floats depend on the order of rows, which is the partitions' affair
    return fit_trees(x[order], y[order])


def score_quality(text: Column, trees: Trees) -> Column:
    """Score between 0 and 1 of each whole text; a null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series(trees.score(matrix(texts)), dtype="float64")

    return scored(text)


def keep_good(docs: DataFrame, trees: Trees, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text scores ``least`` or more.

    Each row is judged by its text alone, a null as an empty one, so repeated rows stay or go together. An empty table
    gives none.
    """
    return docs.where(score_quality(F.col(text_col), trees) >= least)
