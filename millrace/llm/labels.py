"""Labelled training rows, and the logistic link that turns model evidence into a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import id_and_text

#: Labels up to this many rows (about 24 MB) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows whose evidence is collected to fit the logistic link.
CALIBRATION_ROWS = 50_000


def new_column(docs: DataFrame, column: str) -> None:
    """Refuses a column name that ``docs`` has already, in any case of letters."""
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {column} exists already")


def remainder(parts: int) -> F.Column:
    """crc32(doc_id as text) mod ``parts``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label int) of the documents that have a label; of several labels the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label is not null and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return id_and_text(docs).join(own, "doc_id")


def about(rows: DataFrame, limit: int) -> DataFrame:
    """All of ``rows``, or where there are more than ``limit`` about so many of them, chosen by the hash of doc_id."""
    n = rows.count()
    return rows if n <= limit else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit / n * (1 << 20)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_link(evidence: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression, by Newton steps.

    With one class alone, or no rows, the weights give every row a smoothed base rate: 0.25 for no
    rows, so that nothing is rejected for want of labels.
    """
    n, d = evidence.shape
    weights = np.zeros(d + 1)
    rate = (y.sum() + 0.5) / (n + 2.0)
    weights[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return weights
    centre, scale = evidence.mean(0), evidence.std(0)
    # A column that is the same in all rows says nothing of rows where it is not.
    scale = np.where(scale > 1e-9 * (1 + np.abs(centre)), scale, np.inf)
    x = np.column_stack([(evidence - centre) / scale, np.ones(n)])
    penalty = np.diag([ridge] * d + [1e-6])
    for _ in range(60):
        p = sigmoid(x @ weights)
        gradient = x.T @ (y - p) - penalty @ weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(d + 1), gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    inner = weights[:d] / scale
    return np.append(inner, weights[d] - inner @ centre)
