"""Deterministic folds by crc32 of the id as text, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; a null id is in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod)), F.lit(0)).cast("int")


def sample_ids(labels: DataFrame, target: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, target) of at most ``rows`` labelled ids, the first by hash; repeated ids take the larger label."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull())
    ids = ids.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("target"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised columns: means, scales, weights with the intercept last."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = z.T @ (y - p) - penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logits(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return (x - mean) / scale @ w[:-1] + w[-1]
