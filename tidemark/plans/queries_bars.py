"""Queries: bars, derived columns, windows, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, windows
from ..operators import bars as B
from ..sources import readers
from . import adapters as A
from .adapters import NATION_SQL, bars_sql, daily, hourly, nation_daily, r, rounded, table
from .registry import query

DAY, HOUR = f"WITH {bars_sql()}", f"WITH {bars_sql('hour')}"
W = "(PARTITION BY instrument_id ORDER BY ts)"
OHLC = ", ".join(r(c) for c in ("open", "high", "low", "close", "volume", "amount"))


@query("ohlc_daily_bars", f"{DAY} SELECT instrument_id, ts, {OHLC} FROM bars")
def ohlc_daily_bars(spark, d):
    return rounded(daily(spark, d))


@query("ohlc_hourly_bars", f"{HOUR} SELECT instrument_id, ts, {OHLC} FROM bars")
def ohlc_hourly_bars(spark, d):
    return rounded(hourly(spark, d))


@query("ohlc_nation_bars", f"WITH {NATION_SQL} SELECT instrument_id, ts, {OHLC} FROM bars")
def ohlc_nation_bars(spark, d):
    return rounded(nation_daily(spark, d))


@query("time_features", f"""{HOUR} SELECT instrument_id, ts, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month FROM bars""")
def time_features(spark, d):
    return B.time_features(hourly(spark, d)).select("instrument_id", "ts", "minute", "hour", "weekday", "day", "month")


@query("returns_and_logdiff", f"""{DAY} SELECT instrument_id, ts, {r("close - lag(close) OVER w", "diff")}, {r("close / lag(close) OVER w - 1", "pct")},
  {r("ln(close) - ln(lag(close) OVER w)", "log_diff")}, {r("(high - low) / open * 100", "amplitude")} FROM bars WINDOW w AS {W}""")
def returns_and_logdiff(spark, d):
    return rounded(B.returns(daily(spark, d)).select("instrument_id", "ts", "diff", "pct", "log_diff", "amplitude"))


def _rolling(k: int) -> str:
    frame = f"(PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {frame} = {k} THEN avg(close) OVER {frame} END"


@query("rolling_mean_5_20", f"WITH {NATION_SQL} SELECT instrument_id, ts, {r(_rolling(5), 'ma5')}, {r(_rolling(20), 'ma20')} FROM bars")
def rolling_mean_5_20(spark, d):
    return rounded(nation_daily(spark, d).select("instrument_id", "ts", windows.rolling_mean("close", 5).alias("ma5"), windows.rolling_mean("close", 20).alias("ma20")))


@query("centered_smoothing", f"{DAY} SELECT instrument_id, ts, {r('avg(close) OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'smooth')} FROM bars")
def centered_smoothing(spark, d):
    return rounded(daily(spark, d).select("instrument_id", "ts", windows.centered_mean("close", 5).alias("smooth")))


@query("forward_fill", f"""{DAY}, gaps AS (SELECT *, CASE WHEN CAST(volume AS BIGINT) % 3 <> 0 THEN close END AS seen FROM bars)
  SELECT instrument_id, ts, {r("last_value(seen IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "filled")} FROM gaps""")
def forward_fill(spark, d):
    rows = daily(spark, d).withColumn("seen", F.when(F.col("volume").cast("long") % 3 != 0, F.col("close")))
    return rounded(rows.select("instrument_id", "ts", windows.forward_fill("seen").alias("filled")))


@query("drawdown_wealth", f"""{DAY}, ret AS (SELECT *, 0.1 * tanh(coalesce(close / lag(close) OVER {W} - 1, 0)) AS ret FROM bars),
  wealth AS (SELECT *, exp(sum(ln(1 + ret)) OVER {W}) AS wealth FROM ret), peak AS (SELECT *, greatest(1.0, max(wealth) OVER {W}) AS peak FROM wealth)
  SELECT instrument_id, ts, {r("wealth")}, {r("peak")}, {r("wealth / peak - 1", "drawdown")} FROM peak""")
def drawdown_wealth(spark, d):
    rows = B.returns(daily(spark, d)).withColumn("ret", 0.1 * F.tanh(F.coalesce("pct", F.lit(0.0))))
    return rounded(windows.wealth(rows, "ret").select("instrument_id", "ts", "wealth", "peak", "drawdown"))


@query("exp_smoothing_level", f"""{DAY}, lists AS (SELECT instrument_id, list(close ORDER BY ts) AS c FROM bars GROUP BY 1)
  SELECT instrument_id, {r("list_reduce(c, lambda s, x: x * 0.3::DOUBLE + s * 0.7::DOUBLE)", "level")}, CAST(len(c) AS BIGINT) AS n FROM lists""")
def exp_smoothing_level(spark, d):
    return rounded(windows.exponential_level(daily(spark, d), 0.3))


@query("ewma_variance", f"""{DAY}, rets AS (SELECT instrument_id, ts, ln(close) - ln(lag(close) OVER {W}) AS x FROM bars),
  lists AS (SELECT instrument_id, list(x * x ORDER BY ts) AS c FROM rets WHERE x IS NOT NULL GROUP BY 1)
  SELECT instrument_id, {r("greatest(list_reduce(c, lambda s, x: s * 0.94::DOUBLE + x * (1 - 0.94::DOUBLE)), 1e-12)", "variance")} FROM lists""")
def ewma_variance(spark, d):
    return rounded(windows.ewma_variance(B.returns(daily(spark, d)), 0.94))


@query("market_trend_score", f"""{DAY}, m AS (SELECT *, {_rolling(5)} AS ma5, {_rolling(10)} AS ma10, {_rolling(20)} AS ma20 FROM bars),
  f AS (SELECT *, ma5 / lag(ma5, 9) OVER {W} - 1 AS a, close / lag(close, 9) OVER {W} - 1 AS b,
    avg(volume) OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) - 1 AS v,
    row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM m)
  SELECT instrument_id, {r("greatest(-10, least(10, (coalesce(a, 0) * 0.4 + coalesce(b, 0) * 0.4 + coalesce(v, 0) * 0.2) * 10))", "strength")},
    coalesce(ma5 > ma10 AND ma10 > ma20 AND close > ma20, false) AS is_up FROM f WHERE rn = 1""")
def market_trend_score(spark, d):
    return rounded(windows.market_trend(daily(spark, d)).select("instrument_id", "strength", "is_up"))


@query("recent_trend_slope", f"""{DAY}, t AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM bars)
  SELECT instrument_id, {r("greatest(-0.1, least(0.1, coalesce(-regr_slope(close, rn) / nullif(max(close) - min(close), 0), 0)))", "trend")} FROM t WHERE rn <= 10 GROUP BY 1""")
def recent_trend_slope(spark, d):
    return rounded(windows.recent_slope(daily(spark, d), 10))


@query("sliding_window_norm", f"""{DAY}, s AS (SELECT instrument_id, ts, list(close) OVER b AS c, list(close) OVER f AS t, avg(close) OVER b AS m, stddev_pop(close) OVER b AS sd FROM bars
  WINDOW b AS (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), f AS (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  SELECT instrument_id, ts, list_transform(c, lambda x: floor(greatest(-5, least(5, (x - m) / (sd + 1e-5))) * 1e6 + 0.5001) / 1e6) AS context_z,
    list_transform(t, lambda x: floor(greatest(-5, least(5, (x - m) / (sd + 1e-5))) * 1e6 + 0.5001) / 1e6) AS target_z FROM s WHERE len(c) = 8 AND len(t) = 3""")
def sliding_window_norm(spark, d):
    rows = windows.sliding_windows(daily(spark, d), "close", context=8, horizon=3)
    return rows.select("instrument_id", "ts", *(F.transform(c, A.nearest).alias(c) for c in ("context_z", "target_z")))


@query("pseudo_shuffle_index", "SELECT event_id, (event_id * 9973 + 3 * 104729) % 1001 AS start FROM events")
def pseudo_shuffle_index(spark, d):
    return table(spark, d, "events").select("event_id", windows.shuffled_start(F.col("event_id"), 2, F.lit(1000)).cast("long").alias("start"))


@query("price_limit_clamp")
def price_limit_clamp(spark, d):
    return rounded(B.clamped_by_limit(daily(spark, d)))


@query("text_number_clean", f"""{DAY}, t AS (SELECT instrument_id, ts, CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN '--' ELSE '1,' || CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS raw,
    CASE WHEN CAST(volume AS BIGINT) % 4 = 0 THEN 0 ELSE open END AS open, close FROM bars)
  SELECT instrument_id, ts, {r("try_cast(nullif(nullif(replace(raw, ',', ''), '--'), '') AS DOUBLE)", "number")},
    {r(f"CASE WHEN open = 0 THEN coalesce(lag(close) OVER {W}, close) ELSE open END", "open")} FROM t""")
def text_number_clean(spark, d):
    whole = F.col("volume").cast("long")
    rows = daily(spark, d).withColumn("raw", F.when(whole % 5 == 0, "--").otherwise(F.concat(F.lit("1,"), whole.cast("string")))).withColumn("open", F.when(whole % 4 == 0, 0.0).otherwise(F.col("open")))
    return rounded(B.repaired_open(rows).select("instrument_id", "ts", B.text_number(F.col("raw")).alias("number"), "open"))


@query("amount_proxy", f"""{DAY}, t AS (SELECT *, CASE WHEN instrument_id IN ('view', 'click') THEN 0 ELSE amount END AS a FROM bars)
  SELECT instrument_id, ts, {r("CASE WHEN bool_and(coalesce(a, 0) = 0) OVER (PARTITION BY instrument_id) THEN close * volume ELSE a END", "amount")} FROM t""")
def amount_proxy(spark, d):
    rows = daily(spark, d).withColumn("amount", F.when(F.col("instrument_id").isin("view", "click"), 0.0).otherwise(F.col("amount")))
    return rounded(B.amount_or_proxy(rows).select("instrument_id", "ts", "amount"))


@query("json_kline_parse", """SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS open, round(value, 2) AS close FROM events""")
def json_kline_parse(spark, d):
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.get_json_object("props", "$.k"), F.format_string("%.2f", "value"), F.format_string("%.2f", "value"), F.format_string("%.2f", "value"))
    payload = F.concat(F.lit('/**/cb({"data":{"klines":["'), line, F.lit('","bad"]}})'))
    rows = readers.jsonp_lines(table(spark, d, "events").select("event_id", payload.alias("payload")))
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", F.round("close", 2).alias("close"))


@query("future_business_days", """WITH lasts AS (SELECT event_type AS instrument_id, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1),
  days AS (SELECT instrument_id, CAST(last + CAST(r.range AS INTEGER) AS DATE) AS day FROM lasts, range(1, 30) r),
  numbered AS (SELECT instrument_id, day, row_number() OVER (PARTITION BY instrument_id ORDER BY day) AS step FROM days WHERE isodow(day) < 6 AND day NOT IN (DATE '2024-02-02', DATE '2024-02-05'))
  SELECT instrument_id, day, CAST(step AS INTEGER) AS step FROM numbered WHERE step <= 10""")
def future_business_days(spark, d):
    last = table(spark, d, "events").groupBy(F.col("event_type").alias("instrument_id")).agg(F.to_date(F.max("ts")).alias("last_date"))
    holidays = spark.sql("SELECT explode(array(DATE'2024-02-02', DATE'2024-02-05')) AS day")
    return B.future_business_days(last, count=10, holidays=holidays).select("instrument_id", "day", "step")


@query("yearly_summary_rollup", f"""WITH {NATION_SQL} SELECT instrument_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS days, {r("avg(close)", "mean_close")}, {r("max(high)", "high")}, {r("min(low)", "low")},
  {r("arg_max(close, ts) / arg_min(close, ts) - 1", "period_return")} FROM bars GROUP BY ROLLUP (instrument_id, year(ts)) HAVING instrument_id IS NOT NULL""")
def yearly_summary_rollup(spark, d):
    rows = nation_daily(spark, d).withColumn("year", F.year("ts"))
    out = rows.rollup("instrument_id", "year").agg(
        F.count("*").alias("days"), F.avg("close").alias("mean_close"), F.max("high").alias("high"), F.min("low").alias("low"), (F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("period_return")
    )
    return rounded(out.where("instrument_id IS NOT NULL"))


@query("continuity_gap", f"""{DAY}, cut AS (SELECT *, ts < TIMESTAMP '2024-01-25' AS past FROM bars), h AS (SELECT instrument_id, arg_max(open, ts) AS lo, arg_max(close, ts) AS lc FROM cut WHERE past GROUP BY 1),
  f AS (SELECT instrument_id, arg_min(open, ts) AS fo, arg_min(close, ts) AS fc FROM cut WHERE NOT past GROUP BY 1)
  SELECT instrument_id, {r("abs(fo - lo)", "open_gap")}, {r("abs(fc - lc)", "close_gap")}, {r("abs(fc - lc) / lc * 100", "close_gap_pct")} FROM f JOIN h USING (instrument_id)""")
def continuity_gap(spark, d):
    rows, cut = daily(spark, d), F.lit("2024-01-25").cast("timestamp_ntz")
    return rounded(B.continuity_gap(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)).select("instrument_id", "open_gap", "close_gap", "close_gap_pct"))


_L = "l AS (SELECT instrument_id, list(close ORDER BY ts) AS c, count(*) AS n FROM bars GROUP BY 1), s AS (SELECT *, CAST(t.range AS INTEGER) AS step FROM l, range(1, 6) t)"
_TAIL = "list_avg(c[-10:])"
_BASELINES = {
    "last_value": "c[n]",
    "drift": "c[n] * exp(step * (ln(c[n]) - ln(c[1])) / (n - 1))",
    "seasonal_naive": "c[n - 5 + 1 + (step - 1) % 5]",
    "rolling_mean": _TAIL,
    "exponential_smoothing": "list_reduce(c, lambda a, x: x * 0.3::DOUBLE + a * 0.7::DOUBLE)",
    "momentum": "c[n] * exp(step * (ln(c[n]) - ln(c[n - 5])) / 5)",
    "mean_reversion": f"{_TAIL} + (c[n] - {_TAIL}) * pow(0.8, step)",
}


def _register(name: str, sql: str | None) -> None:
    @query(f"baseline_{name}", sql)
    def run(spark, d):
        out = baselines.REGISTRY[name](daily(spark, d), 5)
        return rounded(out.select("instrument_id", F.col("step").cast("int").alias("step"), "forecast"))


for _name, _formula in _BASELINES.items():
    _register(_name, f"{DAY}, {_L} SELECT instrument_id, step, {r(_formula, 'forecast')} FROM s")
_register("linear_regression", f"""{DAY}, t AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS back FROM bars),
  line AS (SELECT instrument_id, regr_slope(ln(close), 20 - back) AS b, regr_intercept(ln(close), 20 - back) AS a FROM t WHERE back <= 20 GROUP BY 1)
  SELECT instrument_id, CAST(s.range AS INTEGER) AS step, {r("exp(a + b * (19 + s.range))", "forecast")} FROM line, range(1, 6) s""")
for _name in ("tree", "autoregression", "simulated"):
    _register(_name, None)


@query("historical_volatility", f"WITH {NATION_SQL}, x AS (SELECT instrument_id, ln(close) - ln(lag(close) OVER {W}) AS x FROM bars) SELECT instrument_id, {r('stddev_samp(x)', 'volatility')} FROM x GROUP BY 1")
def historical_volatility(spark, d):
    return rounded(baselines.historical_volatility(B.returns(nation_daily(spark, d))))
