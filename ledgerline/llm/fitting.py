"""Fitting helpers: a bounded labelled sample and small logistic models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, bound: int) -> DataFrame:
    """(doc_id, text, label): the rows with a label (0 or 1) for which ``train``
    holds, or about ``bound`` of them chosen by a hash of the id. The share is
    set from a count of all of them, so every source and size is treated alike."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("label in (0, 1)").where(train).groupBy("doc_id").agg(F.max("label").alias("label")))
    total = known.count()
    if total > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * bound / total))
    return docs.join(known, "doc_id")


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Intercept and weights by Newton's method, lightly ridged; for a handful
    of features over a bounded sample."""
    x = np.asarray(x, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = l2 * len(x) * np.eye(len(w)) / 10
    ridge[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge @ w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    out = w.copy()
    out[1:] = w[1:] / scale
    out[0] = w[0] - (w[1:] * mean / scale).sum()
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, steps: int = 500) -> np.ndarray:
    """Intercept and weights of a logistic model with an L1 penalty, by
    accelerated proximal gradient steps."""
    z = np.hstack([np.ones((len(x), 1)), np.asarray(x, float)])
    n = len(z)
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + 1e-12)
    w, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    w[0] = v[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        u = v - step * (z.T @ (p - y) / n)
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        done = np.abs(u - w).max() < 1e-7
        w, t = u, t2
        if done:
            break
    return w
