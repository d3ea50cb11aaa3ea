"""Logistic calibration of a few numbers, fitted on bounded samples on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Calibration:
    """P(label 1) from standardised columns, by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        x = np.asarray(x, float)
        x = x[:, None] if x.ndim == 1 else x
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._columns(x)
        self.weights = np.zeros(z.shape[1])
        keep = np.full(z.shape[1], ridge)
        keep[0] = 1e-3
        for _ in range(30):
            p = logistic(z @ self.weights)
            slope = z.T @ (y - p) - keep * self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
            step = np.linalg.solve(curve, slope)
            self.weights += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return logistic(self._columns(x[:, None] if x.ndim == 1 else x) @ self.weights)


def hashed_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n rows, those of least key hash: the same rows at every run, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.col(key)).limit(n)


def labelled_ids(labels: DataFrame, label: str, n: int, classes: tuple[int, ...] | None = None) -> DataFrame:
    """(doc_id, y) of labelled rows outside the held-out fifth: at most n rows, or n of each class given.

    Chosen by a hash of doc_id alone, so no text is read; the result is bounded, so it may be broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~tb.held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    if classes is None:
        return hashed_sample(known, n)
    found = [hashed_sample(known.where(F.col("y") == k), n) for k in classes]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def labelled_texts(docs: DataFrame, ids: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(doc_id, y, text) of the documents with those ids and a text: texts stay where they are read."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    if most_chars is not None:
        texts = texts.where(F.length("text") <= most_chars)
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
