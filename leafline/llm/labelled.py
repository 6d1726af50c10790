"""Labels for the classifiers: which rows may be learnt from, and small fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

#: Labels are broadcast up to so many rows (about 32 MB); beyond that they are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Fold 0 is held out, this one calibrates, the others are fitted.
CALIBRATION_FOLD = 4


def with_labels(rows: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """rows that may be learnt from, with label (0 or 1) and fold (1 to 4).
    Several labels of one id: the majority, 1 on a tie; null labels: none."""
    own = labels.select(id_col, F.col(label).alias("label")).where(f"label is not null and `{id_col}` is not null").withColumn("fold", fold_of(id_col)).where("fold != 0")
    own = own.groupBy(id_col, "fold").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return rows.join(own, id_col)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last one: the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def isotonic(at: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators over bins at ``at``; points of a rising line."""
    blocks: list[list[float]] = []
    for a, g, w in zip(at, good, weight, strict=True):
        blocks.append([a * w, g, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
