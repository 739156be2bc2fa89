"""The driver's tables as bars, observations, decisions, scores and paths; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import bars as B
from ..operators.bars import by_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest(value: Column) -> Column:
    """To six decimals. Halves go up with a margin, as means of cents often are halves but for the order of summing."""
    return F.floor(value * 1e6 + 0.5001) / 1e6


def rounded(frame: DataFrame) -> DataFrame:
    """All doubles to six decimals."""
    doubles = {f.name for f in frame.schema.fields if isinstance(f.dataType, DoubleType)}
    return frame.select(*(nearest(F.col(c)).alias(c) if c in doubles else F.col(c) for c in frame.columns))


def r(expression: str, alias: str | None = None) -> str:
    return f"floor(({expression}) * 1e6 + 0.5001) / 1e6 AS {alias or expression}"


def daily(spark: SparkSession, sf_dir: str, instrument: str = "event_type") -> DataFrame:
    return B.ohlc_bars(table(spark, sf_dir, "events"), instrument=instrument, price="value", width="1 day")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ohlc_bars(table(spark, sf_dir, "events"), instrument="event_type", price="value", width="1 hour")


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net prices by supplier nation and ship day; the joined dimensions are small and planned by their size."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ticks = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return B.ohlc_bars(ticks, instrument="n_name", price="price", width="1 day", ts="l_shipdate", order=("l_orderkey", "l_linenumber", "price"))


def bars_sql(unit: str = "day", instrument: str = "event_type", name: str = "bars") -> str:
    return f"""{name} AS (SELECT e.{instrument} AS instrument_id, CAST(date_trunc('{unit}', e.ts) AS TIMESTAMP) AS ts,
  first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high, min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume, sum(e.value) AS amount FROM events e GROUP BY 1, 2)"""


NATION_SQL = """bars AS (SELECT n_name AS instrument_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
  first(l_extendedprice * (1 - l_discount) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount)) AS open, max(l_extendedprice * (1 - l_discount)) AS high, min(l_extendedprice * (1 - l_discount)) AS low,
  last(l_extendedprice * (1 - l_discount) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(l_extendedprice * (1 - l_discount)) AS amount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def observations(bars: DataFrame) -> DataFrame:
    """Forecast observations one bar ahead: a rolling mean, and quantiles and samples of past closes."""
    order = by_time()
    frame = lambda k: order.rowsBetween(1 - k, 0)
    change = F.col("close") - F.lag("close").over(order)
    rows = bars.withColumns({"_change": change, "_rn": F.row_number().over(order)})
    rows = rows.select(
        "instrument_id", F.col("ts").alias("as_of"), F.lead("ts").over(order).alias("target_ts"), F.lit(1).alias("horizon"),
        F.col("close").alias("reference_value"), F.lead("close").over(order).alias("actual_value"), F.avg("close").over(frame(5)).alias("point_forecast"),
        F.avg(F.abs("_change")).over(frame(10)).alias("scale_error"), F.avg((F.col("_change") > 0).cast("double")).over(frame(5)).alias("probability_positive"),
        F.when(F.col("close") > F.avg("close").over(frame(10)), "up").otherwise("down").alias("market_regime"),
        F.when(F.abs("_change") > F.col("close") * 0.5, "high").otherwise("low").alias("volatility_regime"),
        *(F.percentile("close", q).over(frame(10)).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))),
        F.collect_list("close").over(frame(5)).alias("samples"), "_rn", "amount",
    )
    return rows.where((F.col("_rn") >= 11) & F.col("target_ts").isNotNull()).drop("_rn")


OBSERVATIONS_SQL = """changes AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) AS chg,
  row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS rn FROM bars),
observations AS (SELECT *, actual_value / reference_value - 1 AS actual_return, point_forecast / reference_value - 1 AS forecast_return FROM (
  SELECT instrument_id, ts AS as_of, lead(ts) OVER w AS target_ts, 1 AS horizon, close AS reference_value, lead(close) OVER w AS actual_value,
  avg(close) OVER w5 AS point_forecast, avg(abs(chg)) OVER w10 AS scale_error, avg(CASE WHEN chg > 0 THEN 1.0::DOUBLE WHEN chg IS NOT NULL THEN 0.0::DOUBLE END) OVER w5 AS probability_positive,
  CASE WHEN close > avg(close) OVER w10 THEN 'up' ELSE 'down' END AS market_regime, CASE WHEN abs(chg) > close * 0.5 THEN 'high' ELSE 'low' END AS volatility_regime,
  quantile_cont(close, 0.05) OVER w10 AS q05, quantile_cont(close, 0.5) OVER w10 AS q50, quantile_cont(close, 0.95) OVER w10 AS q95,
  list(close) OVER w5 AS samples, rn, amount FROM changes
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ts), w5 AS (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w10 AS (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  WHERE rn >= 11 AND target_ts IS NOT NULL)"""


def sector(instrument: Column) -> Column:
    return F.concat(F.lit("s"), (F.length(instrument) % 2).cast("string"))


def decisions(bars: DataFrame) -> DataFrame:
    """Weights by the cross-sectional rank of the last change; scaled returns of the next bar."""
    rows = observations(bars)
    day = Window.partitionBy("as_of")
    rank = F.row_number().over(day.orderBy("point_forecast", "instrument_id"))
    n = F.count("*").over(day)
    weight = (rank - (n + 1) / 2) / (n * n / 4.0)
    return rows.select(
        F.col("as_of").alias("decision_ts"), F.col("target_ts").alias("realization_ts"), "instrument_id", weight.alias("target_weight"),
        (0.01 * (F.col("actual_value") / F.col("reference_value") - 1)).alias("realized_return"), (F.col("amount") * 1e6).alias("dollar_volume"), sector(F.col("instrument_id")).alias("sector"),
    )


DECISIONS_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY point_forecast, instrument_id) AS k, count(*) OVER (PARTITION BY as_of) AS n FROM observations),
decisions AS (SELECT as_of AS decision_ts, target_ts AS realization_ts, instrument_id, (k - (n + 1) / 2) / (n * n / 4) AS target_weight,
  0.01 * (actual_value / reference_value - 1) AS realized_return, amount * 1e6 AS dollar_volume, 's' || CAST(length(instrument_id) % 2 AS VARCHAR) AS sector FROM ranked)"""


def scores(bars: DataFrame) -> DataFrame:
    """Scores of three simple forecasters in folds of seven days."""
    order = by_time()
    rows = bars.withColumns({
        "actual": F.lead("close").over(order), "naive": F.col("close"), "mean5": F.avg("close").over(order.rowsBetween(-4, 0)),
        "mean10": F.avg("close").over(order.rowsBetween(-9, 0)), "day": F.datediff("ts", F.lit("2024-01-01").cast("date")),
    }).where("actual IS NOT NULL")
    long = rows.unpivot(["ts", "day", "close", "actual"], ["naive", "mean5", "mean10"], "model_name", "forecast")
    fold = F.concat(F.lit("fold-"), F.floor(F.col("day") / 7).cast("string"))
    same = ((F.col("forecast") > F.col("close")) == (F.col("actual") > F.col("close"))).cast("double")
    wide = long.groupBy("model_name", fold.alias("fold_id")).agg(F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"), F.avg(same).alias("directional_accuracy"))
    out = wide.unpivot(["model_name", "fold_id"], ["mae", "directional_accuracy"], "metric_name", "value")
    return out.withColumn("higher_is_better", F.col("metric_name") == "directional_accuracy")


SCORES_SQL = """forecasts AS (SELECT *, lead(close) OVER w AS actual, close AS naive, avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5,
  avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean10, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
long AS (SELECT day, close, actual, unnest(['naive', 'mean5', 'mean10']) AS model_name, unnest([naive, mean5, mean10]) AS forecast FROM forecasts WHERE actual IS NOT NULL),
wide AS (SELECT model_name, 'fold-' || CAST(day // 7 AS VARCHAR) AS fold_id, avg(abs(forecast - actual)) AS mae, avg(CASE WHEN (forecast > close) = (actual > close) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS directional_accuracy FROM long GROUP BY 1, 2),
scores AS (SELECT model_name, fold_id, unnest(['mae', 'directional_accuracy']) AS metric_name, unnest([mae, directional_accuracy]) AS value, unnest([false, true]) AS higher_is_better FROM wide)"""


def last_closes(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.col("instrument_id").alias("series")).agg(F.max_by("close", "ts").alias("last_close"))


def paths(bars: DataFrame, samples: int = 8, steps: int = 5) -> DataFrame:
    """Deterministic paths around the last close; some cells break the candle rules on purpose."""
    s, t, last = F.col("sample"), F.col("step"), F.col("last_close")
    rows = last_closes(bars).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    rows = rows.withColumns({"open": last * (1 + 0.01 * F.sin(s * 5.0 + t)), "close": last * (1 + 0.01 * F.sin(s * 7.0 + t * 3))})
    volume = 100 * F.cos(s + t * 0.2)
    return rows.select("series", "sample", "step", "open", (F.col("close") * 1.012).alias("high"), (F.col("close") * 0.988).alias("low"), "close", volume.alias("volume"), (volume * F.col("close")).alias("amount"))


PATHS_SQL = """lasts AS (SELECT instrument_id AS series, arg_max(close, ts) AS last_close FROM bars GROUP BY 1),
raw AS (SELECT series, last_close, CAST(s.range AS INTEGER) AS sample, CAST(t.range AS INTEGER) AS step, last_close * (1 + 0.01 * sin(s.range * 5.0 + t.range)) AS open,
  last_close * (1 + 0.01 * sin(s.range * 7.0 + t.range * 3)) AS close, 100 * cos(s.range + t.range * 0.2) AS volume FROM lasts, range(8) s, range(1, 6) t),
paths AS (SELECT series, last_close, sample, step, open, close * 1.012 AS high, close * 0.988 AS low, close, volume, volume * close AS amount FROM raw)"""


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of users in the canonical schema, with faults of several kinds planted by rule."""
    user = F.col("instrument_id")
    day = F.dayofmonth("ts")
    rows = daily(spark, sf_dir, "user_id").withColumn("row_no", F.col("instrument_id") * 1000 + day)
    return rows.select(
        F.when((user % 19 == 0) & (day == 5), F.col("row_no") + 500).otherwise(F.col("row_no")).alias("row_no"),
        F.when(user % 23 == 0, F.lit(" ")).otherwise(user.cast("string")).alias("instrument_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.when(user % 29 == 0, "XXXX").otherwise("XNYS").alias("exchange"), F.when((user % 17 == 0) & (day > 15), "EUR").otherwise("USD").alias("currency"), F.lit("1D").alias("frequency"),
        F.when(user % 31 == 0, F.lit(float("nan"))).otherwise(F.col("open")).alias("open"), F.when(day % 7 == 0, F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low", "close",
        F.when(user % 11 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"), "amount", F.when(user % 37 == 0, 0.0).otherwise(1.0).alias("adjustment_factor"),
        F.when(user % 41 == 0, F.lit(None)).otherwise(F.lit(True)).alias("is_adjusted"), F.lit("events").alias("source"),
        (F.col("ts") + F.when(user % 13 == 0, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))).cast("timestamp").alias("ingested_at"),
    )


CANONICAL_SQL = bars_sql("day", "user_id") + """,
numbered AS (SELECT *, instrument_id * 1000 + day(ts) AS no, day(ts) AS d, instrument_id AS u FROM bars),
canonical AS (SELECT CASE WHEN u % 19 = 0 AND d = 5 THEN no + 500 ELSE no END AS row_no, CASE WHEN u % 23 = 0 THEN ' ' ELSE CAST(u AS VARCHAR) END AS instrument_id, ts AS timestamp_utc,
  CASE WHEN u % 29 = 0 THEN 'XXXX' ELSE 'XNYS' END AS exchange, CASE WHEN u % 17 = 0 AND d > 15 THEN 'EUR' ELSE 'USD' END AS currency, '1D' AS frequency,
  CASE WHEN u % 31 = 0 THEN NULL ELSE open END AS open, CASE WHEN d % 7 = 0 THEN low * 0.5 ELSE high END AS high, low, close, CASE WHEN u % 11 = 0 THEN -volume ELSE volume END AS volume, amount,
  CASE WHEN u % 37 = 0 THEN 0.0 ELSE 1.0 END AS adjustment_factor, CASE WHEN u % 41 = 0 THEN NULL ELSE true END AS is_adjusted,
  CASE WHEN u % 13 = 0 THEN ts - INTERVAL 1 DAY ELSE ts + INTERVAL 1 DAY END AS ingested_at FROM numbered)"""
