"""Evaluation of many models in one plan: completeness, equal truth, scores, audit and holdout checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


def missing_models(submissions: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected models without a row; a suite counts only if it is complete."""
    found = {r["model_name"] for r in submissions.select("model_name").where(F.col("model_name").isin(*expected)).distinct().collect()}
    return sorted(set(expected) - found)


def truth_mismatch(observations: DataFrame) -> DataFrame:
    """Cells where models were given different actual values, or that some model lacks."""
    models = observations.agg(F.count_distinct("model_name").alias("models"))
    cells = observations.groupBy(*metrics.KEYS).agg(F.min("actual_value").alias("low"), F.max("actual_value").alias("high"), F.count_distinct("model_name").alias("n"))
    return cells.crossJoin(F.broadcast(models)).where("low <> high OR n <> models").drop("models")  # models is one row


def score_models(observations: DataFrame) -> DataFrame:
    """Point metrics of each model and fold: one aggregation for all of them."""
    return metrics.with_returns(observations).groupBy("model_name", "fold_id").agg(*(c.alias(k) for k, c in metrics.point_metrics().items()))


def beyond_boundary(observations: DataFrame, holdout_start: Column) -> DataFrame:
    """Development observations whose target lies in the holdout."""
    return observations.where(F.col("target_ts") >= holdout_start)


def attach_audit(folds: DataFrame, audits: DataFrame) -> DataFrame:
    """Folds with the audit of the same data, code and splits; audited is false where there is none that passed."""
    keys = ["dataset_id", "code_commit", "split_hash"]
    passed = audits.groupBy(*keys).agg(F.bool_and("passed").alias("_passed"), F.max("audit_id").alias("audit_id"))
    return folds.join(passed, keys, "left").withColumn("audited", F.coalesce("_passed", F.lit(False))).drop("_passed")


def decision_grade(folds: DataFrame, *, least: int = 2) -> DataFrame:
    """One row: at least so many folds, all audited."""
    return folds.agg(((F.count("*") >= least) & F.coalesce(F.bool_and("audited"), F.lit(False))).alias("decision_grade"))
