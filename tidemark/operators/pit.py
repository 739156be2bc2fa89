"""Point-in-time joins and the leakage audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("train", "validation", "calibration", "test", "final_holdout")
#: A dimension of more rows than this is joined by a shuffle, not by a broadcast.
BROADCAST_ROWS = 100_000


def small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the frame has at most `limit` rows; the check reads no more than that."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def as_of(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], order: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """For each left row the last right row of its key at or before its time (before, if strict).

    Both sides are laid under each other and the last value carried forward: one shuffle by
    key and one sort, and no pairs, whatever the sizes. `order` breaks ties of the right side.
    """
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in (*order, *values)]
    rows = left.select(*left.columns, F.col(left_ts).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("struct<" + ",".join(f"{c}:{right.schema[c].dataType.simpleString()}" for c in (right_ts, *values)) + ">").alias("_found"), *empty[: len(order)])
    others = [c for c in left.columns if c not in by]
    rights = right.select(
        *(F.col(c) for c in by), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in others), F.col(right_ts).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"), F.struct(right_ts, *values).alias("_found"), *(F.col(c).alias(f"_{c}") for c in order),
    )
    window = Window.partitionBy(*by).orderBy("_at", "_side", *(f"_{c}" for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(rights).withColumn("_last", F.last("_found", ignorenulls=True).over(window))
    out = both.where(F.col("_side") == (0 if strict else 1))
    return out.select(*left.columns, F.col("_last")[right_ts].alias(f"asof_{right_ts}"), *(F.col("_last")[c].alias(c) for c in values))


def first_at_or_after(rows: DataFrame, start: Column, *, ts: str = "ts", context: int, horizon: int) -> DataFrame:
    """The rows from the first one at or after `start`: a context and then a horizon, by position."""
    order = Window.partitionBy("instrument_id").orderBy(ts)
    numbered = rows.withColumn("rn", F.row_number().over(order))
    begin = F.min(F.when(F.col(ts) >= start, F.col("rn"))).over(Window.partitionBy("instrument_id"))
    out = numbered.withColumn("offset", F.col("rn") - begin).where(F.col("offset").between(0, context + horizon - 1))
    return out.withColumn("part", F.when(F.col("offset") < context, "context").otherwise("horizon"))


def member(rows: DataFrame, intervals: DataFrame, *, anti: bool = False, ts: str = "prediction_ts") -> DataFrame:
    """Rows with (or without) an interval of their instrument that covers their time and was known then."""
    covers = (
        (rows["instrument_id"] == intervals["instrument_id"]) & (rows[ts] >= intervals["member_from"])
        & (rows[ts] <= intervals["member_to"]) & (intervals["known_at"] <= rows[ts]) & intervals["included"]
    )
    return rows.join(intervals, covers, "left_anti" if anti else "left_semi")


def missing_cells(samples: DataFrame, names: DataFrame, present: DataFrame, *, sample: str = "sample_id", name: str = "feature_name") -> DataFrame:
    """Cells of the grid of samples and expected names that are not there; names are few by contract."""
    grid = samples.select(sample).distinct().crossJoin(small(names.select(name).distinct()))
    return grid.join(present.select(sample, name), [sample, name], "left_anti")


def unequal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with side; empty for equal multisets."""
    left = expected.exceptAll(actual).withColumn("side", F.lit("expected"))
    return left.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def aligned(history: DataFrame, forecast: DataFrame, *, on: Sequence[str], value: str = "close") -> DataFrame:
    """Full outer join in time, with the actual value or else the forecast."""
    left = history.select(*on, F.col(value).alias("actual"))
    right = forecast.select(*on, F.col(value).alias("forecast"))
    return left.join(right, list(on), "full_outer").withColumn("combined", F.coalesce("actual", "forecast"))


def later_than(history: DataFrame, forecast: DataFrame, ts: str = "ts") -> DataFrame:
    """Forecast rows after the last known one; all of them if there are none."""
    last = history.groupBy("instrument_id").agg(F.max(ts).alias("_last"))
    rows = forecast.join(last, "instrument_id", "left").withColumn("_later", F.coalesce(F.col(ts) > F.col("_last"), F.lit(True)))
    rows = rows.withColumn("_some", F.max("_later").over(Window.partitionBy("instrument_id")))
    return rows.where(F.col("_later") | ~F.col("_some")).drop("_later", "_last", "_some")


def finding(frame: DataFrame, code: str, rule: Column, row: str) -> DataFrame:
    return frame.where(F.coalesce(rule, F.lit(False))).select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col(row).cast("string").alias("row_id"))


def _findings(frame: DataFrame, rules: dict[str, Column], row: str) -> DataFrame:
    flags = F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()))
    rows = frame.withColumn("_flags", flags)
    return rows.select(F.explode(F.array_compact("_flags")).alias("code"), F.lit("error").alias("severity"), F.col(row).cast("string").alias("row_id"))


def audit_splits(splits: DataFrame, *, embargo_days: int = 0) -> DataFrame:
    """Splits (name, role, target_start, target_end): order, overlap, embargo, roles. A few rows by contract."""
    order = Window.orderBy("target_start", "name")
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    names, roles = Window.partitionBy("name"), Window.partitionBy("role")
    end_before = F.lag("target_end").over(order)
    embargo = F.make_dt_interval(days=F.lit(embargo_days))
    rules = {
        "split_name_duplicate": F.count("*").over(names) > 1,
        "split_role_unknown": rank == 0,
        "split_bounds_reversed": F.col("target_start") > F.col("target_end"),
        "split_role_order": rank < F.lag(rank).over(order),
        "split_role_repeated": (F.col("role") == "final_holdout") & (F.count("*").over(roles) > 1),
        "split_target_overlap": F.col("target_start") <= end_before,
        "split_embargo_violation": (F.col("target_start") > end_before) & (F.col("target_start") < end_before + embargo),
    }
    found = _findings(splits, rules, "name")
    none = splits.agg(F.count_if(F.col("role") == "final_holdout").alias("n")).where("n = 0")
    return found.unionByName(none.select(F.lit("final_holdout_missing").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("row_id")))


def audit_windows(windows: DataFrame, splits: DataFrame) -> DataFrame:
    """Sample windows against their own order and the bounds of their split (broadcast if small)."""
    bounds = splits.select(F.col("name").alias("split"), F.col("target_start").alias("split_start"), F.col("target_end").alias("split_end"))
    rows = windows.join(small(bounds), "split", "left")
    known = F.col("split_start").isNotNull()
    rules = {
        "sample_lookback_reversed": F.col("lookback_start") > F.col("lookback_end"),
        "sample_lookback_after_prediction": F.col("lookback_end") > F.col("prediction_timestamp"),
        "sample_target_reversed": F.col("target_start") > F.col("target_end"),
        "sample_target_not_after_prediction": F.col("target_start") <= F.col("prediction_timestamp"),
        "sample_normalization_uses_future": F.col("normalization_end") > F.col("prediction_timestamp"),
        "sample_split_unknown": ~known,
        "sample_label_crosses_split": known & ((F.col("target_start") < F.col("split_start")) | (F.col("target_end") > F.col("split_end"))),
    }
    return _findings(rows, rules, "sample_id")


def audit_features(features: DataFrame) -> DataFrame:
    at = F.col("prediction_timestamp")
    rules = {
        "feature_observed_after_prediction": F.col("observation_timestamp") > at,
        "feature_available_after_prediction": F.col("available_at") > at,
        "feature_available_before_observed": F.col("available_at") < F.col("observation_timestamp"),
        "rolling_window_uses_future": F.col("window_end") > at,
        "feature_derived_from_target": F.col("derived_from_target"),
    }
    return _findings(features, rules, "sample_id")


def audit_actions(actions: DataFrame) -> DataFrame:
    """Corporate actions that were applied before they were known or in effect."""
    at, applied = F.col("prediction_timestamp"), F.col("adjustment_applied")
    rules = {
        "future_feature_timestamp": applied & (F.col("feature_timestamp") > at),
        "future_corporate_action_knowledge": applied & (F.col("action_known_at") > at),
        "future_effective_action_applied": applied & (F.col("action_effective_at") > at),
    }
    return _findings(actions, rules, "instrument_id")


def audit_selection(events: DataFrame, splits: DataFrame, *, frozen_at: Column, audited_at: Column) -> DataFrame:
    """Selection events (event_id, purpose, split, occurred_at): nothing but one evaluation touches the holdout."""
    rows = events.join(small(splits.select(F.col("name").alias("split"), "role")), "split", "left")
    final = F.col("purpose") == "final_evaluate"
    everything = Window.partitionBy(F.lit(1))
    first_final = F.min(F.when(final, F.col("occurred_at"))).over(everything)
    rules = {
        "selection_split_unknown": F.col("role").isNull(),
        "selection_uses_test": ~final & F.col("role").isin("test", "final_holdout"),
        "selection_after_freeze": ~final & (F.col("occurred_at") > frozen_at),
        "final_evaluation_wrong_split": final & (F.col("role") != "final_holdout"),
        "final_evaluation_before_freeze": final & (F.col("occurred_at") < frozen_at),
        "final_evaluation_repeated": final & (F.col("occurred_at") > first_final),
        "selection_after_final_evaluation": ~final & (F.col("occurred_at") > first_final),
        "event_after_audit": F.col("occurred_at") > audited_at,
    }
    return _findings(rows, rules, "event_id")


def future_probe(frame: DataFrame, normalise: Callable[[DataFrame], DataFrame], *, row: str, ts: str, cutoff: Column, column: str, output: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows up to the cutoff whose output changes when all later values are changed."""
    poisoned = frame.withColumn(column, F.when(F.col(ts) > cutoff, F.col(column) * -17 + 1_000_003).otherwise(F.col(column)))
    a = normalise(frame).where(F.col(ts) <= cutoff).select(row, F.col(output).alias("_a"))
    b = normalise(poisoned).where(F.col(ts) <= cutoff).select(row, F.col(output).alias("_b"))
    changed = F.abs(F.col("_a") - F.col("_b")) > tolerance + tolerance * F.abs(F.col("_b"))
    return finding(a.join(b, row, "full_outer"), "normalization_uses_future", changed | (F.col("_a").isNull() != F.col("_b").isNull()), row)
