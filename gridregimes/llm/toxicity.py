"""Toxicity by logistic regression over hashed words, word pairs and skip-grams, fitted by FTRL-proximal.

Features of a text are the positions that its words, the beginnings of its words (5 and 8 bytes, which inflected forms
share), its pairs of neighbouring words and its pairs with one or two words between them hash to; each counts once.
Those in fewer than ``MIN_TEXTS`` texts of the sample are not learned, and an error on a toxic text, the rarer class,
counts ``TOXIC_WEIGHT`` times. FTRL-proximal keeps two sums per position: squared gradients give each its own
rate, and the L1 bound leaves weights at exactly 0 until the evidence exceeds it, so the broadcast model is a short
list of (position, weight).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, release, small
from .quality import labelled_sample

MAX_ROWS = 8_000
#: Bytes of hashed positions that the driver takes: the sample ends before the text that exceeds them.
MAX_BYTES = 96 << 20
BITS = 20
BEGINNINGS = (5, 8)
MIN_TEXTS, TOXIC_WEIGHT = 3, 4.0
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _C
    return ((h ^ (h >> np.uint64(29))) * _A) >> np.uint64(64 - BITS)


def positions(text: str | None) -> np.ndarray:
    """Positions of all features of a whole text, with repeats."""
    words = (text or "").encode().translate(_FOLD).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64) + np.uint64(1)
    parts = [_mix(h)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append(_mix(h[:-gap] * _A + h[gap:] * _B + np.uint64(gap)))
    for k in BEGINNINGS:
        own = np.fromiter((zlib.crc32(w[:k]) for w in words), np.uint32, len(words)).astype(np.uint64)
        parts.append(_mix(own + np.uint64(k << 33)))
    return np.concatenate(parts).astype(np.uint32)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features."""

    def __init__(self, size: int = 1 << BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), np.zeros(2)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _bias(self) -> float:
        return -self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha)

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> None:
        """``at``: different positions."""
        z, n = self.z[at], self.n[at]
        w, b = self._weights(z, n), self._bias()
        g = (1 / (1 + np.exp(-min(max(w.sum() + b, -35), 35))) - y) * weight
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias += g - (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / self.alpha * b, g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self._weights(self.z, self.n)
        at = np.flatnonzero(w)
        return at.astype(np.uint32), w[at], float(self._bias())


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = 12, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """(positions, weights, bias) from at most ``max_rows`` labelled rows for which ``allowed`` holds over labels.

    Tasks hash the sampled texts; the driver takes their positions, ``max_bytes`` at most, and never a text. Rows come in
    the order of a hash of their ids; the first row that exceeds the bytes and those after it are left out. A null text
    counts as empty; a null id or label teaches nothing; repeated labels and rows count as often as they occur; without
    rows every score is 0.5.
    """
    sample = small(labelled_sample(labels, label_col, allowed, max_rows, id_col), 16 * max_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.unique(positions(t)).tobytes() for t in b["text"]]
            yield pd.DataFrame({"k": [zlib.crc32(i.encode()) for i in b["d_id"]], "id": b["d_id"], "y": b["y"], "size": list(map(len, x)), "x": x}).astype({"k": "int64", "size": "int64"})

    rows = docs.select(F.col(id_col).cast("string").alias("d_id"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, F.col("id") == F.col("l_id"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(rows.select("d_id", "text", "y").mapInPandas(hashed, "k long, id string, y double, size long, x binary"), "sample")
    order = ["k", "id", "y"]  # that no partitioning changes
    upto = F.sum("size").over(Window.orderBy(*order))  # of max_rows numbers
    over = rows.select(*order, "size").withColumn("sum", upto).where(F.col("sum") > max_bytes).agg(F.min("k").alias("k")).first()[0]
    got = (rows if over is None else rows.where(F.col("k") < over)).drop("size").toPandas().sort_values(order)
    scratch.drop()
    model, texts = Ftrl(), np.zeros(1 << BITS, np.int32)
    for x in got["x"]:
        texts[np.frombuffer(x, np.uint32)] += 1
    rows = [(a[texts[a] >= MIN_TEXTS], y) for a, y in ((np.frombuffer(x, np.uint32), y) for x, y in zip(got["x"], got["y"], strict=True))]
    for _ in range(epochs):
        for at, y in rows:
            model.learn(at, y, TOXIC_WEIGHT if y else 1.0)
    return model.weights()


def score_toxicity(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """Score between 0 and 1 of each whole text; a null or empty text has the bias's score."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        at, weight, bias = model
        dense = np.zeros(1 << BITS)
        dense[at] = weight
        live = dense != 0
        for texts in batches:
            out = []
            for t in texts:
                x = positions(t)
                out.append(dense[np.unique(x[live[x]])].sum() + bias)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35))))

    return scored(text)
