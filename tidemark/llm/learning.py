"""Bounded samples of labelled documents, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLICES = 1 << 20


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, bound: int, *, where: Column | None = None
) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label, pick) of about `bound` documents of each class, and the
    weight of a sampled row of each class.

    Rows are picked by a hash of doc_id, so the sample is the same at each run. Only
    the picked labels, bounded by the parameter, are broadcast. A document with
    several labels counts with the largest; null labels and ids count for nothing.
    `where` restricts the labels by doc_id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.where(where) if where is not None else known
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, bound / n) for k, n in counts.items()}
    if len(share) < 2:
        share = {}
    pick = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(_SLICES))
    limit = F.lit(-1)
    for k, part in share.items():
        limit = F.when(F.col("label") == k, F.lit(round(part * _SLICES))).otherwise(limit)
    picked = known.withColumn("pick", pick).where(F.col("pick") < limit)
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label", "pick"), {k: 1 / v for k, v in share.items()}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the columns of x, the last one for the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - keep * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        beta += (step := np.linalg.solve(curve, slope))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
