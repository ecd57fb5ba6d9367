"""Bounded samples of labelled rows, and what classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """``doc_id, label`` of all labelled rows for learning.

    Rows with a null id or label are not learnt from; of rows that repeat an id the largest label counts.
    """
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def sample(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` of :func:`labelled`, chosen by a hash of the id.  The bound makes the result fit for a broadcast."""
    return labelled(labels, label, learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps with a quadratic penalty; constant labels give a constant."""
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        return np.zeros(k), 0.0 if n == 0 else (4.0 if y[0] else -4.0)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / spread, np.ones(n)])
    w, ridge = np.zeros(k + 1), np.diag([penalty] * k + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge, g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())
