"""Queries: series profiles, adjustments and evaluation of several models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import evaluation, profile, windows
from .adapters import OBSERVATIONS_SQL, bars_sql, daily, hourly, observations, r, rounded
from .registry import query

DAY, HOUR = f"WITH {bars_sql()}", f"WITH {bars_sql('hour')}"
W = "(PARTITION BY instrument_id ORDER BY ts)"


@query("frequency_inference", f"""{HOUR}, d AS (SELECT instrument_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER {W} AS s FROM bars), c AS (SELECT instrument_id, s, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY 1, 2)
  SELECT instrument_id, arg_max(s, (n, -s)) AS step_seconds, CAST(sum(n) - max(n) AS BIGINT) AS other_steps, bool_and(s > 0) AS rising FROM c GROUP BY 1""")
def frequency_inference(spark, d):
    return profile.frequency(hourly(spark, d))


@query("timeframe_detection", f"""{HOUR}, d AS (SELECT instrument_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER {W} AS s, row_number() OVER {W} AS rn FROM bars), m AS (SELECT instrument_id, avg(s) AS s FROM d WHERE rn <= 10 GROUP BY 1)
  SELECT instrument_id, CASE WHEN s < 60 THEN CAST(CAST(round(s) AS BIGINT) AS VARCHAR) || ' seconds' WHEN s < 3600 THEN CAST(CAST(round(s / 60) AS BIGINT) AS VARCHAR) || ' minutes'
    WHEN s < 86400 THEN CAST(CAST(round(s / 3600) AS BIGINT) AS VARCHAR) || ' hours' ELSE CAST(CAST(round(s / 86400) AS BIGINT) AS VARCHAR) || ' days' END AS timeframe FROM m""")
def timeframe_detection(spark, d):
    return profile.timeframe(hourly(spark, d))


_P = ("open", "high", "low", "close")


@query("input_summary", f"""{DAY} SELECT instrument_id, count(*) AS rows, min(ts) AS start, max(ts) AS "end", {", ".join(r(f"{f}({c})", f"{f}_{c}") for c in _P for f in ("min", "max"))},
  {", ".join(r(f"arg_max({c}, ts)", f"last_{c}") for c in _P)} FROM bars GROUP BY 1""")
def input_summary(spark, d):
    return rounded(profile.summary(daily(spark, d)))


@query("prediction_statistics", f"""{DAY} SELECT instrument_id, {r("max(close)", "max_close")}, {r("min(close)", "min_close")}, {r("avg(close)", "mean_close")}, {r("stddev_samp(close)", "std_close")},
  {r("avg(volume)", "mean_volume")}, {r("max(volume)", "max_volume")}, {r("min(volume)", "min_volume")} FROM bars GROUP BY 1""")
def prediction_statistics(spark, d):
    return rounded(profile.statistics(daily(spark, d)))


@query("window_sizing", f"""WITH {bars_sql("day", "user_id")} SELECT instrument_id, CAST(greatest(100, least(400, floor(count(*) * 0.7::DOUBLE))) AS INTEGER) AS lookback, CAST(greatest(20, least(120, floor(90 * 5 / 7))) AS INTEGER) AS horizon,
  CAST(CASE WHEN count(*) <= 30 THEN 2 ELSE 7 END AS INTEGER) AS tick FROM bars GROUP BY 1""")
def window_sizing(spark, d):
    lookback, horizon = profile.window_sizes(F.col("n"), horizon_days=90)
    counts = daily(spark, d, "user_id").groupBy("instrument_id").agg(F.count("*").alias("n"))
    return counts.select("instrument_id", lookback.alias("lookback"), horizon.alias("horizon"), profile.tick_interval(F.col("n")).alias("tick"))


@query("calendar_buffer_load", f"""{DAY}, c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM bars)),
  e AS (SELECT min(CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' THEN p END) AS b, max(CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN p END) AS e FROM c)
  SELECT instrument_id, bars.ts, {r("close")} FROM bars JOIN c ON bars.ts = c.ts, e WHERE p BETWEEN b - 3 AND e.e + 2""")
def calendar_buffer_load(spark, d):
    rows = profile.calendar_range(daily(spark, d), begin="2024-01-10 06:00:00", end="2024-01-20 00:00:00", before=3, after=2)
    return rounded(rows.select("instrument_id", "ts", "close"))


@query("market_vote")
def market_vote(spark, d):
    return rounded(profile.market_vote(windows.market_trend(daily(spark, d))))


@query("factor_scaling", f"""{DAY}, f AS (SELECT *, greatest(0.9, least(1.1, 1 + 0.05 * CAST(CAST(volume AS BIGINT) % 7 AS DOUBLE) - 0.1 * CAST(day(ts) % 3 AS DOUBLE))) AS k FROM bars)
  SELECT instrument_id, ts, {r("close * k", "close")}, {r("volume * (1 + (k - 1) * 0.3)", "volume")} FROM f""")
def factor_scaling(spark, d):
    rows = daily(spark, d).withColumns({"a": (F.col("volume").cast("long") % 7).cast("double"), "b": (F.dayofmonth("ts") % 3).cast("double")})
    return rounded(B.scaled(rows, B.adjustment_factor({"a": 0.05, "b": -0.1})).select("instrument_id", "ts", "close", "volume"))


@query("holiday_uplift", f"""{DAY} SELECT instrument_id, ts, {r("close * CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' OR CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END", "close")} FROM bars""")
def holiday_uplift(spark, d):
    holidays = spark.sql("SELECT explode(array(DATE'2024-01-08', DATE'2024-01-10', DATE'2024-01-20')) AS end_date")
    return rounded(B.holiday_uplift(daily(spark, d), holidays, days=3, uplift=0.02).select("instrument_id", "ts", "close"))


@query("outlier_shrink", f"""{DAY}, x AS (SELECT *, avg(close) OVER (PARTITION BY instrument_id) AS m FROM bars) SELECT instrument_id, ts, {r("CASE WHEN abs(close - m) > 0.3 * abs(m) THEN m + (close - m) * 0.5 ELSE close END", "close")} FROM x""")
def outlier_shrink(spark, d):
    from pyspark.sql import Window

    rows = daily(spark, d).withColumn("m", F.avg("close").over(Window.partitionBy("instrument_id")))
    return rounded(B.shrunk_outliers(rows, "close", "m").select("instrument_id", "ts", "close"))


_MODELS = f"""{DAY}, {OBSERVATIONS_SQL}, m AS (SELECT 'mean5' AS model_name, * FROM observations UNION ALL SELECT 'naive', * REPLACE (reference_value AS point_forecast, 0.0 AS forecast_return) FROM observations)"""


def _models(spark, d):
    rows = observations(daily(spark, d))
    both = rows.withColumn("model_name", F.lit("mean5")).unionByName(rows.withColumn("model_name", F.lit("naive")).withColumn("point_forecast", F.col("reference_value")))
    return both.withColumn("fold_id", F.concat(F.lit("fold-"), F.floor(F.dayofmonth("as_of") / 10).cast("string")))


@query("model_scores", f"""{_MODELS} SELECT model_name, 'fold-' || CAST(day(as_of) // 10 AS VARCHAR) AS fold_id, count(*) AS n, {r("avg(abs(point_forecast - actual_value))", "mae")},
  {r("avg(CASE WHEN (actual_return > 0) = (forecast_return > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "directional_accuracy")} FROM m GROUP BY 1, 2""")
def model_scores(spark, d):
    return rounded(evaluation.score_models(_models(spark, d)).select("model_name", "fold_id", "n", "mae", "directional_accuracy"))


@query("truth_mismatch", f"""{DAY}, {OBSERVATIONS_SQL} SELECT instrument_id, as_of, target_ts, horizon, CAST(2 AS BIGINT) AS n FROM observations WHERE day(as_of) = 15
  UNION ALL SELECT instrument_id, as_of, target_ts, horizon, 1 FROM observations WHERE day(as_of) = 17""")
def truth_mismatch(spark, d):
    rows = _models(spark, d)
    naive, day = F.col("model_name") == "naive", F.dayofmonth("as_of")
    rows = rows.where(~(naive & (day == 17))).withColumn("actual_value", F.when(naive & (day == 15), F.col("actual_value") + 1).otherwise(F.col("actual_value")))
    return evaluation.truth_mismatch(rows).drop("low", "high")


@query("holdout_refusal", f"{DAY}, {OBSERVATIONS_SQL} SELECT instrument_id, as_of FROM observations WHERE target_ts >= TIMESTAMP '2024-01-25'")
def holdout_refusal(spark, d):
    return evaluation.beyond_boundary(observations(daily(spark, d)), F.lit("2024-01-25").cast("timestamp_ntz")).select("instrument_id", "as_of")
