"""All bar-series queries; importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics
from . import queries_audit, queries_bars, queries_profile, queries_scores, queries_streams  # noqa: F401
from .adapters import daily, observations, rounded
from .registry import oracle_sql, queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a rolling-mean forecast over daily bars, in total and by group."""
    return rounded(metrics.scorecard(observations(daily(spark, sf_dir))))
