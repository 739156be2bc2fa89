"""Comparison of models over folds. Scores: model_name, fold_id, metric_name, value, higher_is_better."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contract(scores: DataFrame) -> DataFrame:
    """Broken parts: doubled cells, metrics with two directions, missing cells of the grid."""
    cells = scores.groupBy("model_name", "fold_id", "metric_name").agg(F.count("*").alias("n")).where("n > 1")
    doubled = cells.select(F.lit("duplicate_cell").alias("code"), F.concat_ws("/", "model_name", "fold_id", "metric_name").alias("cell"))
    two = scores.groupBy("metric_name").agg(F.count_distinct("higher_is_better").alias("n")).where("n > 1")
    directions = two.select(F.lit("two_directions").alias("code"), F.col("metric_name").alias("cell"))
    grid = scores.select("model_name").distinct().crossJoin(F.broadcast(scores.select("fold_id", "metric_name").distinct()))
    gaps = grid.join(scores, ["model_name", "fold_id", "metric_name"], "left_anti")
    return doubled.unionByName(directions).unionByName(gaps.select(F.lit("missing_cell").alias("code"), F.concat_ws("/", "model_name", "fold_id", "metric_name").alias("cell")))


def improvements(scores: DataFrame, reference: str) -> DataFrame:
    """Signed improvement of each other model over the reference model, for each metric and fold."""
    base = scores.where(F.col("model_name") == reference).select("fold_id", "metric_name", F.col("value").alias("reference_value"))
    rows = scores.where(F.col("model_name") != reference).join(base, ["fold_id", "metric_name"])
    sign = F.when(F.col("higher_is_better"), 1.0).otherwise(-1.0)
    return rows.withColumn("improvement", sign * (F.col("value") - F.col("reference_value")))


def paired(scores: DataFrame, reference: str, *, holdout: Sequence[str] = ()) -> DataFrame:
    """Mean, median and counts of improvements over development folds; holdout folds are left out."""
    rows = improvements(scores.where(~F.col("fold_id").isin(*holdout)) if holdout else scores, reference)
    return rows.groupBy("model_name", "metric_name").agg(
        F.count("*").alias("folds"), F.avg("improvement").alias("mean_improvement"), F.median("improvement").alias("median_improvement"),
        F.count_if(F.col("improvement") > 0).alias("improved"), F.count_if(F.col("improvement") == 0).alias("tied"),
        F.avg((F.col("improvement") > 0).cast("double")).alias("share_improved"),
    )


def bootstrap(scores: DataFrame, reference: str, *, resamples: int = 2000, seed: int = 123, level: float = 0.95) -> DataFrame:
    """Interval of the mean improvement; each (metric, model) draws folds by its own seed, so results do not depend on order."""
    if not 1 <= resamples <= 1_000_000:
        raise ValueError("between 1 and 1,000,000 resamples")

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        metric, model = key
        values = frame.sort_values("fold_id")["improvement"].to_numpy(float)
        own = int.from_bytes(hashlib.sha256(f"{seed}|{metric}|{model}".encode()).digest()[:8], "big")
        rng, means = np.random.default_rng(own), []
        for start in range(0, resamples, 10_000):
            means.append(values[rng.integers(0, len(values), (min(10_000, resamples - start), len(values)))].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({"metric_name": [metric], "model_name": [model], "mean_improvement": [values.mean()], "low": [low], "high": [high]})

    rows = improvements(scores, reference).select("metric_name", "model_name", "fold_id", "improvement")
    return rows.groupBy("metric_name", "model_name").applyInPandas(one, "metric_name string, model_name string, mean_improvement double, low double, high double")


def final_comparison(scores: DataFrame, reference: str, holdout: str) -> DataFrame:
    return improvements(scores.where(F.col("fold_id") == holdout), reference)
