"""Forecast scores. Observations: instrument_id, as_of, target_ts, horizon, reference_value,
actual_value, point_forecast, scale_error, probability_positive, market_regime,
volatility_regime, q05, q50, q95 and samples (array).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import average_rank

KEYS = ("instrument_id", "as_of", "target_ts", "horizon")
GROUPS = ("horizon", "instrument_id", "market_regime", "volatility_regime")
QUANTILES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


def with_returns(observations: DataFrame) -> DataFrame:
    return observations.withColumns({
        "actual_return": F.col("actual_value") / F.col("reference_value") - 1,
        "forecast_return": F.col("point_forecast") / F.col("reference_value") - 1,
    })


def contract(observations: DataFrame, quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """One row: whether each part of the contract is broken anywhere."""
    names = sorted(quantiles, key=quantiles.__getitem__)
    rising = F.lit(True)
    for a, b in zip(names, names[1:], strict=False):
        rising &= F.col(a) <= F.col(b)
    doubled = observations.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("duplicate_key"))
    checks = {
        "non_positive_value": F.least("reference_value", "actual_value", "point_forecast") <= 0,
        "target_not_after_as_of": F.col("target_ts") <= F.col("as_of"),
        "probability_out_of_range": ~F.col("probability_positive").between(0, 1),
        "quantiles_not_rising": ~rising,
        "scale_not_positive": F.col("scale_error") <= 0,
    }
    flags = observations.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in checks.items()))
    return flags.crossJoin(doubled)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(F.count_if(top), F.count_if(bottom))


def point_metrics() -> dict[str, Column]:
    error = F.col("point_forecast") - F.col("actual_value")
    up, said = F.col("actual_return") > 0, F.col("forecast_return") > 0
    return {
        "n": F.count("*"), "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "mase": F.avg(F.abs(error) / F.col("scale_error")),
        "directional_accuracy": F.avg((up == said).cast("int")), "precision": _ratio(up & said, said), "recall": _ratio(up & said, up),
    }


def scorecard(observations: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Point metrics in total and by each group, in one pass of grouping sets; `level` names the group."""
    rows = with_returns(observations)
    sets = [[], *([F.col(g)] for g in groups)]
    out = rows.groupingSets(sets, *groups).agg(*(c.alias(k) for k, c in point_metrics().items()), *(F.grouping(g).alias(f"_{g}") for g in groups))
    level, value = F.lit("total"), F.lit("all")
    for g in groups:
        level = F.when(F.col(f"_{g}") == 0, g).otherwise(level)
        value = F.when(F.col(f"_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    return out.select(level.alias("level"), value.alias("value"), *point_metrics())


def pinball(observations: DataFrame, quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """Mean quantile loss for each quantile column."""
    rows = observations.select("actual_value", *quantiles).unpivot("actual_value", list(quantiles), "quantile", "forecast")
    level = F.create_map(*(F.lit(x) for pair in quantiles.items() for x in pair))[F.col("quantile")]
    error = F.col("actual_value") - F.col("forecast")
    rows = rows.withColumn("loss", F.greatest(level * error, (level - 1) * error))
    return rows.groupBy("quantile").agg(F.avg("loss").alias("pinball"), F.count("*").alias("n"))


def probabilistic(observations: DataFrame, *, low: str = "q05", high: str = "q95", tail: float = -0.02) -> DataFrame:
    """One row: interval coverage, Brier score, and recall of actual falls by the low quantile."""
    rows = with_returns(observations)
    hit = F.col("actual_return") <= tail
    said = F.col(low) / F.col("reference_value") - 1 <= tail
    up = (F.col("actual_return") > 0).cast("double")
    return rows.agg(
        F.avg(F.col("actual_value").between(F.col(low), F.col(high)).cast("int")).alias("coverage"),
        F.avg((F.col("probability_positive") - up) * (F.col("probability_positive") - up)).alias("brier"), _ratio(hit & said, hit).alias("tail_recall"),
    )


def calibration_bin(p: Column, bins: int) -> Column:
    """The bin of a probability: edges i * (1.0 / bins), closed on the left, and 1 in the last bin."""
    return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: i * F.lit(1.0 / bins)), lambda e: e <= p)) - 1


def calibration(observations: DataFrame, *, bins: int = 10, by: str | None = None) -> DataFrame:
    """Every bin with its count, mean probability, share of rises, gap and weight; empty bins too."""
    rows = with_returns(observations).withColumn("bin", calibration_bin(F.col("probability_positive"), bins))
    keys = [by] if by else []
    found = rows.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("probability_positive").alias("mean_probability"), F.avg((F.col("actual_return") > 0).cast("double")).alias("share")
    )
    size = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    grid = size.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(found, [*keys, "bin"], "left")
    gap = F.coalesce(F.abs(F.col("mean_probability") - F.col("share")), F.lit(0.0))
    return out.select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "share", gap.alias("gap"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("weight")
    )


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.sum(F.col("weight") * F.col("gap")).alias("ece"))


def crps(samples: Column, actual: Column) -> Column:
    """Of an empirical sample: mean distance to the value less half the mean distance within."""
    ordered, n = F.array_sort(samples), F.size(samples)
    first = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.abs(x - actual)) / n
    weighted = F.transform(ordered, lambda x, i: x * (2 * (i + 1) - n - 1))
    return first - F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x) / (n * n)


def cross_sections(observations: DataFrame, *, least: int = 3, tail: float = 0.2) -> DataFrame:
    """For each target time and horizon: correlation of forecast and actual returns, of their
    ranks, and the spread of top to bottom forecasts. Small and constant sections are left out.
    """
    keys = ["target_ts", "horizon"]
    rows = with_returns(observations)
    rows = rows.withColumns({"_rf": average_rank("forecast_return", keys), "_ra": average_rank("actual_return", keys)})
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "_n": F.count("*").over(w),
        "_low": F.row_number().over(w.orderBy("forecast_return", "instrument_id", "as_of")),
        "_high": F.row_number().over(w.orderBy(F.desc("forecast_return"), F.desc("instrument_id"), F.desc("as_of"))),
    })
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * tail))

    def correlation(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), correlation("forecast_return", "actual_return").alias("ic"), correlation("_rf", "_ra").alias("rank_ic"),
        (F.avg(F.when(F.col("_high") <= k, F.col("actual_return"))) - F.avg(F.when(F.col("_low") <= k, F.col("actual_return")))).alias("spread"),
        F.min("forecast_return").alias("_f0"), F.max("forecast_return").alias("_f1"), F.min("actual_return").alias("_a0"), F.max("actual_return").alias("_a1"),
    )
    return out.where((F.col("n") >= least) & (F.col("_f0") < F.col("_f1")) & (F.col("_a0") < F.col("_a1"))).select(*keys, "n", "ic", "rank_ic", "spread")


def ic_summary(sections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = sections.groupBy(*by).agg(
        F.count("*").alias("sections"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic_mean"), F.avg("spread").alias("spread_mean")
    )
    return out.withColumn("icir", F.try_divide("ic_mean", "ic_std"))


#: Metrics that are compared between models, and whether more is better.
DIRECTIONS = {"mae": False, "rmse": False, "mase": False, "directional_accuracy": True, "precision": True, "recall": True, "coverage_error": False}


def comparable(scores: DataFrame) -> DataFrame:
    """Long scores (model_name, fold_id, metric_name, value) of metrics that no model lacks."""
    from pyspark.sql import Window

    w = Window.partitionBy("fold_id", "metric_name")
    gaps = F.count_if(F.col("value").isNull()).over(w)
    better = F.create_map(*(F.lit(x) for pair in DIRECTIONS.items() for x in pair))
    rows = scores.withColumn("_gaps", gaps).where("_gaps = 0").drop("_gaps")
    return rows.withColumn("higher_is_better", F.try_element_at(better, F.col("metric_name"))).where("higher_is_better IS NOT NULL")
