"""Queries: forecast scores, costs, folds, backtests, paths and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, baselines, costs, folds, metrics, paths, pit
from . import adapters as A
from .adapters import DECISIONS_SQL, OBSERVATIONS_SQL, PATHS_SQL, SCORES_SQL, bars_sql, daily, r, rounded, table
from .registry import query

OBS = f"WITH {bars_sql()}, {OBSERVATIONS_SQL}"
DEC = f"{OBS}, {DECISIONS_SQL}"
SCO = f"WITH {bars_sql()}, {SCORES_SQL}"
PTH = f"WITH {bars_sql()}, {PATHS_SQL}"

_POINT = f"""count(*) AS n, {r("avg(abs(point_forecast - actual_value))", "mae")}, {r("sqrt(avg((point_forecast - actual_value) * (point_forecast - actual_value)))", "rmse")},
  {r("avg(abs(point_forecast - actual_value) / scale_error)", "mase")}, {r("avg(CASE WHEN (actual_return > 0) = (forecast_return > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "directional_accuracy")},
  {r("CAST(count(*) FILTER (actual_return > 0 AND forecast_return > 0) AS DOUBLE) / nullif(count(*) FILTER (forecast_return > 0), 0)", "precision")},
  {r("CAST(count(*) FILTER (actual_return > 0 AND forecast_return > 0) AS DOUBLE) / nullif(count(*) FILTER (actual_return > 0), 0)", "recall")}"""


def _obs(spark, d):
    return A.observations(daily(spark, d))


@query("point_metrics_grouping_sets", f"""{OBS} SELECT CASE WHEN grouping(volatility_regime) = 0 THEN 'volatility_regime' WHEN grouping(market_regime) = 0 THEN 'market_regime'
    WHEN grouping(instrument_id) = 0 THEN 'instrument_id' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'total' END AS level,
  CASE WHEN grouping(volatility_regime) = 0 THEN volatility_regime WHEN grouping(market_regime) = 0 THEN market_regime WHEN grouping(instrument_id) = 0 THEN instrument_id
    WHEN grouping(horizon) = 0 THEN CAST(horizon AS VARCHAR) ELSE 'all' END AS value, {_POINT}
  FROM observations GROUP BY GROUPING SETS ((), (horizon), (instrument_id), (market_regime), (volatility_regime))""")
def point_metrics_grouping_sets(spark, d):
    return rounded(metrics.scorecard(_obs(spark, d)))


@query("pinball_loss", f"""{OBS}, l AS (SELECT actual_value, unnest(['q05', 'q50', 'q95']) AS quantile, unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q, unnest([q05, q50, q95]) AS f FROM observations)
  SELECT quantile, {r("avg(greatest(q * (actual_value - f), (q - 1) * (actual_value - f)))", "pinball")}, count(*) AS n FROM l GROUP BY 1""")
def pinball_loss(spark, d):
    return rounded(metrics.pinball(_obs(spark, d)))


@query("interval_coverage_brier", f"""{OBS} SELECT {r("avg(CASE WHEN actual_value BETWEEN q05 AND q95 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "coverage")},
  {r("avg(pow(probability_positive - CASE WHEN actual_return > 0 THEN 1 ELSE 0 END, 2))", "brier")},
  {r("CAST(count(*) FILTER (actual_return <= -0.02 AND q05 / reference_value - 1 <= -0.02) AS DOUBLE) / nullif(count(*) FILTER (actual_return <= -0.02), 0)", "tail_recall")} FROM observations""")
def interval_coverage_brier(spark, d):
    return rounded(metrics.probabilistic(_obs(spark, d)))


def _calibration_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    return f"""{OBS}, b AS (SELECT *, len(list_filter(range(10), lambda i: i * (1.0::DOUBLE / 10) <= probability_positive)) - 1 AS bin FROM observations),
  f AS (SELECT {key}bin, count(*) AS n, avg(probability_positive) AS mp, avg(CASE WHEN actual_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sh FROM b GROUP BY ALL),
  t AS (SELECT {key}count(*) AS total FROM b {"GROUP BY " + by if by else ""}), g AS (SELECT *, r.range AS bin FROM t, range(10) r),
  c AS (SELECT {"g." + by + ", " if by else ""}CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, mp AS mean_probability, sh AS share, coalesce(abs(mp - sh), 0) AS gap, coalesce(n, 0) / total AS weight
    FROM g LEFT JOIN f ON g.bin = f.bin {f"AND g.{by} = f.{by}" if by else ""})"""


@query("calibration_table", f"{_calibration_sql('')} SELECT bin, n, {r('mean_probability')}, {r('share')}, {r('gap')}, {r('weight')} FROM c")
def calibration_table(spark, d):
    return rounded(metrics.calibration(_obs(spark, d)))


@query("calibration_by_group", f"{_calibration_sql('market_regime')} SELECT market_regime, bin, n, {r('mean_probability')}, {r('share')}, {r('gap')}, {r('weight')} FROM c")
def calibration_by_group(spark, d):
    return rounded(metrics.calibration(_obs(spark, d), by="market_regime"))


@query("expected_calibration_error", f"{_calibration_sql('market_regime')} SELECT market_regime, {r('sum(weight * gap)', 'ece')} FROM c GROUP BY 1")
def expected_calibration_error(spark, d):
    return rounded(metrics.expected_calibration_error(metrics.calibration(_obs(spark, d), by="market_regime"), ["market_regime"]))


@query("empirical_crps", f"""{OBS}, s AS (SELECT instrument_id, as_of, actual_value, list_sort(samples) AS x, len(samples) AS n FROM observations)
  SELECT instrument_id, as_of, {r("list_sum(list_transform(x, lambda v: abs(v - actual_value))) / n - list_sum(list_transform(x, lambda v, i: v * (2 * i - n - 1))) / (n * n)", "crps")} FROM s""")
def empirical_crps(spark, d):
    return rounded(_obs(spark, d).select("instrument_id", "as_of", metrics.crps(F.col("samples"), F.col("actual_value")).alias("crps")))


_SECTIONS = """ranks AS (SELECT *, rank() OVER (PARTITION BY target_ts, horizon ORDER BY forecast_return) + (count(*) OVER (PARTITION BY target_ts, horizon, forecast_return) - 1) / 2 AS rf,
    rank() OVER (PARTITION BY target_ts, horizon ORDER BY actual_return) + (count(*) OVER (PARTITION BY target_ts, horizon, actual_return) - 1) / 2 AS ra,
    row_number() OVER (PARTITION BY target_ts, horizon ORDER BY forecast_return, instrument_id, as_of) AS lo,
    row_number() OVER (PARTITION BY target_ts, horizon ORDER BY forecast_return DESC, instrument_id DESC, as_of DESC) AS hi, count(*) OVER (PARTITION BY target_ts, horizon) AS c FROM observations),
  sections AS (SELECT target_ts, horizon, count(*) AS n, corr(forecast_return, actual_return) AS ic, corr(rf, ra) AS rank_ic,
    avg(CASE WHEN hi <= greatest(1, floor(c * 0.2)) THEN actual_return END) - avg(CASE WHEN lo <= greatest(1, floor(c * 0.2)) THEN actual_return END) AS spread
    FROM ranks GROUP BY 1, 2 HAVING count(*) >= 3 AND min(forecast_return) < max(forecast_return) AND min(actual_return) < max(actual_return))"""


@query("cross_section_rank_ic", f"{OBS}, {_SECTIONS} SELECT target_ts, n, {r('ic')}, {r('rank_ic')} FROM sections")
def cross_section_rank_ic(spark, d):
    return rounded(metrics.cross_sections(_obs(spark, d)).select("target_ts", "n", "ic", "rank_ic"))


@query("top_bottom_spread", f"{OBS}, {_SECTIONS} SELECT target_ts, {r('spread')} FROM sections")
def top_bottom_spread(spark, d):
    return rounded(metrics.cross_sections(_obs(spark, d)).select("target_ts", "spread"))


@query("ic_summary", f"""{OBS}, {_SECTIONS} SELECT horizon, count(*) AS sections, {r("avg(ic)", "ic_mean")}, {r("stddev_samp(ic)", "ic_std")}, {r("avg(rank_ic)", "rank_ic_mean")},
  {r("avg(spread)", "spread_mean")}, {r("avg(ic) / nullif(stddev_samp(ic), 0)", "icir")} FROM sections GROUP BY 1""")
def ic_summary(spark, d):
    return rounded(metrics.ic_summary(metrics.cross_sections(_obs(spark, d)), ["horizon"]))


@query("observation_contract", f"""{OBS} SELECT bool_or(least(reference_value, actual_value, point_forecast) <= 0) AS non_positive_value, bool_or(target_ts <= as_of) AS target_not_after_as_of,
  bool_or(NOT probability_positive BETWEEN 0 AND 1) AS probability_out_of_range, bool_or(NOT (q05 <= q50 AND q50 <= q95)) AS quantiles_not_rising, bool_or(scale_error <= 0) AS scale_not_positive,
  count(*) > count(DISTINCT (instrument_id, as_of, target_ts, horizon)) AS duplicate_key FROM observations""")
def observation_contract(spark, d):
    return metrics.contract(_obs(spark, d))


# Costs.

_TRADES = f"""{DEC}, scen AS (SELECT * FROM (VALUES ('base', 1.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE), ('high', 2.0, 4.0, 2.0, 20.0)) v(name, com, spr, sli, imp)),
  moved AS (SELECT *, target_weight - coalesce(lag(target_weight) OVER (PARTITION BY name, instrument_id ORDER BY realization_ts), 0) AS delta FROM decisions, scen),
  trades AS (SELECT *, abs(delta) AS traded, abs(delta) * 1e6 / dollar_volume AS participation, abs(delta) / 1e4 * com AS commission, abs(delta) / 1e4 * spr AS half_spread,
    abs(delta) / 1e4 * sli AS slippage, abs(delta) / 1e4 * imp * sqrt(abs(delta) * 1e6 / dollar_volume) AS impact, target_weight * realized_return AS gross FROM moved),
  periods AS (SELECT name, realization_ts, sum(gross) AS gross_return, sum(commission) AS commission, sum(half_spread) AS half_spread, sum(slippage) AS slippage, sum(impact) AS impact,
    sum(gross) - sum(commission) - sum(half_spread) - sum(slippage) - sum(impact) AS net_return, sum(traded) AS turnover, sum(abs(target_weight)) AS gross_exposure, sum(target_weight) AS net_exposure,
    max(abs(target_weight)) AS max_position, sum(target_weight * target_weight) AS concentration, min(dollar_volume) AS min_dollar_volume, max(participation) AS max_participation FROM trades GROUP BY 1, 2),
  wealth AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY name ORDER BY realization_ts)) AS wealth FROM periods),
  dd AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY name ORDER BY realization_ts)) - 1 AS drawdown FROM wealth)"""
_BASE = costs.Assumptions()
_HIGH = costs.Assumptions("high", commission_bps=2.0, half_spread_bps=4.0, slippage_bps=2.0, impact_bps=20.0)


def _trades(spark, d):
    return costs.trade_ledger(A.decisions(daily(spark, d)), costs.scenarios(spark, [_BASE, _HIGH]), enforce_cap=False)


def _columns(*names: str) -> str:
    return ", ".join(r(n) for n in names)


@query("trade_ledger", f"{_TRADES} SELECT name, realization_ts, instrument_id, {_columns('delta', 'traded', 'participation', 'commission', 'half_spread', 'slippage', 'impact', 'gross')} FROM trades")
def trade_ledger(spark, d):
    return rounded(_trades(spark, d).select("name", "realization_ts", "instrument_id", "delta", "traded", "participation", "commission", "half_spread", "slippage", "impact", "gross"))


_PERIOD = ("gross_return", "commission", "half_spread", "slippage", "impact", "net_return", "turnover", "gross_exposure", "net_exposure", "max_position", "concentration", "min_dollar_volume", "max_participation")


@query("period_ledger", f"{_TRADES} SELECT name, realization_ts, {_columns(*_PERIOD)} FROM periods")
def period_ledger(spark, d):
    return rounded(costs.period_ledger(_trades(spark, d)))


@query("sector_exposure", f"{_TRADES} SELECT name, realization_ts, sector, {r('sum(target_weight)', 'net_exposure')}, {r('sum(abs(target_weight))', 'gross_exposure')} FROM trades GROUP BY 1, 2, 3")
def sector_exposure(spark, d):
    return rounded(costs.sector_ledger(_trades(spark, d)))


_ECONOMIC = f"""SELECT name, count(*) AS periods, {r("exp(sum(ln(1 + gross_return))) - 1", "gross_total")}, {r("exp(sum(ln(1 + net_return))) - 1", "net_total")}, {r("sum(turnover)", "turnover")},
  {r("avg(turnover)", "mean_turnover")}, {", ".join(r(f"sum({c})", c) for c in costs.COSTS)}, {r("min(drawdown)", "max_drawdown")}, {r("stddev_samp(net_return) * sqrt(252)", "volatility")},
  {r("avg(net_return) * 252 / nullif(stddev_samp(net_return) * sqrt(252), 0)", "sharpe")}, {r("max(gross_exposure)", "max_gross_exposure")}, {r("max(max_participation)", "max_participation")} FROM dd"""


@query("economic_metrics", f"{_TRADES} {_ECONOMIC} WHERE name = 'base' GROUP BY 1")
def economic_metrics(spark, d):
    trades = costs.trade_ledger(A.decisions(daily(spark, d)), costs.scenarios(spark, [_BASE]), enforce_cap=False)
    return rounded(costs.economic_metrics(costs.period_ledger(trades)))


@query("cost_scenarios", f"{_TRADES} {_ECONOMIC} GROUP BY 1")
def cost_scenarios(spark, d):
    return rounded(costs.economic_metrics(costs.period_ledger(_trades(spark, d))))


@query("decision_contract", f"""{DEC}, u AS (SELECT realization_ts, list_sort(list(instrument_id)) AS i FROM decisions GROUP BY 1)
  SELECT bool_or(instrument_id IS NULL) AS blank_instrument, bool_or(target_weight IS NULL) AS weight_missing, bool_or(realized_return <= -1) AS return_below_minus_one,
  bool_or(dollar_volume <= 0) AS dollar_volume_not_positive, bool_or(realization_ts <= decision_ts) AS realized_before_decided,
  count(*) > count(DISTINCT (realization_ts, instrument_id)) AS duplicate_key, (SELECT count(DISTINCT i) > 1 FROM u) AS universe_changes FROM decisions""")
def decision_contract(spark, d):
    return costs.contract(A.decisions(daily(spark, d)))


# Folds.

_PAIRED = f"""{SCO}, imp AS (SELECT s.model_name, s.metric_name, s.fold_id, CASE WHEN s.higher_is_better THEN 1 ELSE -1 END * (s.value - b.value) AS i
  FROM scores s JOIN scores b ON b.model_name = 'naive' AND s.model_name <> 'naive' AND s.fold_id = b.fold_id AND s.metric_name = b.metric_name)"""


@query("paired_fold_comparison", f"""{_PAIRED} SELECT model_name, metric_name, count(*) AS folds, {r("avg(i)", "mean_improvement")}, {r("median(i)", "median_improvement")}, count(*) FILTER (i > 0) AS improved,
  count(*) FILTER (i = 0) AS tied, {r("avg(CASE WHEN i > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "share_improved")} FROM imp WHERE fold_id <> 'fold-4' GROUP BY 1, 2""")
def paired_fold_comparison(spark, d):
    return rounded(folds.paired(A.scores(daily(spark, d)), "naive", holdout=["fold-4"]))


@query("final_holdout_comparison", f"{_PAIRED} SELECT model_name, metric_name, {r('i', 'improvement')} FROM imp WHERE fold_id = 'fold-4'")
def final_holdout_comparison(spark, d):
    return rounded(folds.final_comparison(A.scores(daily(spark, d)), "naive", "fold-4").select("model_name", "metric_name", "improvement"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return folds.bootstrap(A.scores(daily(spark, d)), "naive")


@query("comparable_grid", f"""{SCO}, holes AS (SELECT model_name, fold_id, metric_name, CASE WHEN model_name = 'mean5' AND fold_id = 'fold-2' AND metric_name = 'mae' THEN NULL ELSE value END AS value, higher_is_better FROM scores)
  SELECT model_name, fold_id, metric_name, {r("value")}, higher_is_better FROM holes WHERE (fold_id, metric_name) NOT IN (SELECT (fold_id, metric_name) FROM holes WHERE value IS NULL)""")
def comparable_grid(spark, d):
    hole = (F.col("model_name") == "mean5") & (F.col("fold_id") == "fold-2") & (F.col("metric_name") == "mae")
    scores = A.scores(daily(spark, d)).withColumn("value", F.when(~hole, F.col("value"))).drop("higher_is_better")
    return rounded(metrics.comparable(scores).select("model_name", "fold_id", "metric_name", "value", "higher_is_better"))


@query("score_contract", f"""{SCO}, holes AS (SELECT * FROM scores WHERE NOT (model_name = 'mean10' AND fold_id = 'fold-1' AND metric_name = 'mae'))
  SELECT 'missing_cell' AS code, m.model_name || '/' || g.fold_id || '/' || g.metric_name AS cell FROM (SELECT DISTINCT model_name FROM holes) m, (SELECT DISTINCT fold_id, metric_name FROM holes) g
  WHERE (m.model_name, g.fold_id, g.metric_name) NOT IN (SELECT (model_name, fold_id, metric_name) FROM holes)""")
def score_contract(spark, d):
    hole = (F.col("model_name") == "mean10") & (F.col("fold_id") == "fold-1") & (F.col("metric_name") == "mae")
    return folds.contract(A.scores(daily(spark, d)).where(~hole))


# Backtests.


def _signals(spark, d):
    rows = metrics.with_returns(_obs(spark, d)).withColumnRenamed("as_of", "ts").withColumn("close", F.col("reference_value"))
    return backtest.threshold_signal(rows, 0.1)


_SIG = f"""{OBS}, sig AS (SELECT *, CASE WHEN forecast_return > 0.1 THEN 1 WHEN forecast_return < -0.1 THEN -1 ELSE 0 END AS signal FROM observations),
  pos AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM sig)"""


@query("threshold_signals", f"{_SIG} SELECT instrument_id, as_of AS ts, signal, position FROM pos")
def threshold_signals(spark, d):
    return _signals(spark, d).select("instrument_id", "ts", "signal", "position")


@query("threshold_backtest")
def threshold_backtest(spark, d):
    return rounded(backtest.run_positions(_signals(spark, d)))


@query("backtest_performance")
def backtest_performance(spark, d):
    return rounded(backtest.performance(backtest.run_positions(_signals(spark, d))))


@query("roundtrip_trade_pairing", f"""{_SIG}, turns AS (SELECT instrument_id, as_of AS ts, reference_value AS close, position, coalesce(lag(position) OVER (PARTITION BY instrument_id ORDER BY as_of), 0) AS was FROM pos),
  acts AS (SELECT instrument_id, ts, close, CASE WHEN position > 0 THEN 'BUY' ELSE 'SELL' END AS action FROM turns WHERE position <> was),
  k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, action ORDER BY ts) AS k FROM acts)
  SELECT b.instrument_id, CAST(b.k AS INTEGER) AS k, b.ts AS bought, s.ts AS sold, {r("s.close / b.close - 1", "trade_return")} FROM k b JOIN k s ON b.instrument_id = s.instrument_id AND b.k = s.k AND b.action = 'BUY' AND s.action = 'SELL'""")
def roundtrip_trade_pairing(spark, d):
    from ..operators.bars import by_time

    rows = _signals(spark, d)
    was = F.coalesce(F.lag("position").over(by_time()), F.lit(0))
    acts = rows.withColumn("was", was).where("position <> was").withColumn("action", F.when(F.col("position") > 0, "BUY").otherwise("SELL"))
    return rounded(backtest.round_trips(acts.select("instrument_id", "ts", "close", "action")).select("instrument_id", "k", "bought", "sold", "trade_return"))


@query("forecast_accuracy", f"""{OBS}, x AS (SELECT *, abs(point_forecast - actual_value) / abs(actual_value) AS e, sign(actual_value - lag(actual_value) OVER w) = sign(point_forecast - lag(point_forecast) OVER w) AS same FROM observations
    WINDOW w AS (PARTITION BY instrument_id ORDER BY as_of))
  SELECT instrument_id, {r("avg(e) * 100", "mape")}, {r("avg(CASE WHEN e < 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "within_5pct")}, {r("avg(CAST(CAST(same AS INTEGER) AS DOUBLE))", "direction")},
  {r("corr(actual_value, point_forecast)", "correlation")} FROM x GROUP BY 1""")
def forecast_accuracy(spark, d):
    return rounded(backtest.accuracy(_obs(spark, d).withColumnRenamed("as_of", "ts")))


@query("portfolio_topk_hold")
def portfolio_topk_hold(spark, d):
    bars = A.daily(spark, d, "user_id")
    rows = bars.select(F.concat(F.lit("p"), (F.col("instrument_id") % 3).cast("string")).alias("portfolio"), "ts", F.col("instrument_id").cast("string").alias("instrument_id"), F.col("close").alias("score"))
    return rounded(backtest.top_k_with_hold(rows, k=10, drop=2, hold=3))


# Paths and tokens.


def _paths(spark, d):
    return A.paths(daily(spark, d))


@query("candle_issue_log", f"""{PTH}, flags AS (SELECT series, sample, step, unnest(list_filter([
    CASE WHEN high < greatest(open, close) THEN 'high:high_below_body' END, CASE WHEN low > least(open, close) THEN 'low:low_above_body' END,
    CASE WHEN volume < 0 THEN 'volume:negative' END, CASE WHEN amount < 0 THEN 'amount:negative' END], lambda x: x IS NOT NULL)) AS f FROM paths)
  SELECT series, sample, step, split_part(f, ':', 1) AS field, split_part(f, ':', 2) AS code FROM flags""")
def candle_issue_log(spark, d):
    return paths.issues(_paths(spark, d))


@query("candle_projection", f"""{PTH} SELECT series, sample, step, {r("open")}, {r("greatest(high, open, close)", "high")}, {r("least(low, open, close)", "low")}, {r("close")}, {r("greatest(volume, 0)", "volume")},
  {r("greatest(amount, 0)", "amount")}, CAST((high < greatest(open, close))::INT + (low > least(open, close))::INT + (volume < 0)::INT + (amount < 0)::INT AS INTEGER) AS repairs FROM paths""")
def candle_projection(spark, d):
    return rounded(paths.projected(_paths(spark, d)).withColumn("repairs", F.size("repairs")))


@query("valid_path_membership", f"""{PTH} SELECT series, sample, count(*) AS steps FROM paths GROUP BY 1, 2 HAVING bool_and(high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 AND amount >= 0)""")
def valid_path_membership(spark, d):
    return paths.valid_paths(_paths(spark, d)).groupBy("series", "sample").agg(F.count("*").alias("steps"))


@query("path_summary_quantiles", f"""{PTH}, x AS (SELECT *, close / last_close - 1 AS ret FROM paths)
  SELECT series, step, count(*) AS paths, {r("avg(close)", "mean")}, {r("median(close)", "median")}, {r("quantile_cont(close, 0.05)", "q05")}, {r("quantile_cont(close, 0.5)", "q50")}, {r("quantile_cont(close, 0.95)", "q95")},
  {r("avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "p_up")}, {r("quantile_cont(ret, 0.05)", "tail_return")} FROM x GROUP BY 1, 2""")
def path_summary_quantiles(spark, d):
    bars = daily(spark, d)
    return rounded(paths.summary(A.paths(bars), A.last_closes(bars)))


@query("signal_from_paths", f"""{PTH}, m AS (SELECT series, step, avg(close) AS close, any_value(last_close) AS l FROM paths GROUP BY 1, 2)
  SELECT series, {r("arg_max(close, step) - any_value(l)", "signal_last")}, {r("avg(close) - any_value(l)", "signal_mean")}, {r("max(close) - any_value(l)", "signal_max")}, {r("min(close) - any_value(l)", "signal_min")} FROM m GROUP BY 1""")
def signal_from_paths(spark, d):
    bars = daily(spark, d)
    return rounded(paths.signals(A.paths(bars), A.last_closes(bars)))


@query("signal_matrix_pivot", f"""WITH {bars_sql()} SELECT ts, {", ".join(r(f"max(CASE WHEN instrument_id = '{i}' THEN close END)", i) for i in ("click", "error", "purchase", "signup", "view"))} FROM bars GROUP BY 1""")
def signal_matrix_pivot(spark, d):
    return rounded(paths.pivoted(daily(spark, d), "ts", "instrument_id", "close", ["click", "error", "purchase", "signup", "view"]))


@query("token_pack_unpack", """WITH b AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
  p AS (SELECT vec_id, bits, CAST(list_sum(list_transform(bits, lambda x, i: x * CAST(pow(2, i - 1) AS BIGINT))) AS BIGINT) AS token FROM b)
  SELECT vec_id, token, token // 256 AS coarse, token % 256 AS fine, bits FROM p""")
def token_pack_unpack(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", paths.pack(paths.sign_bits(F.slice("embedding", 1, 16))).alias("token"))
    coarse, fine = paths.split_token(F.col("token"), 8)
    return rows.select("vec_id", "token", coarse.alias("coarse"), fine.alias("fine"), paths.unpack(F.col("token"), 16).alias("bits"))


@query("codebook_entropy", f"""WITH t AS (SELECT CAST(list_sum(list_transform(embedding[1:8], lambda x, i: (CASE WHEN x > 0 THEN 1 ELSE 0 END) * CAST(pow(2, i - 1) AS BIGINT))) AS BIGINT) AS code FROM embeddings),
  c AS (SELECT code, count(*) AS n FROM t GROUP BY 1), g AS (SELECT r.range AS code, n, coalesce(n, 0) + 1e-9 AS m FROM range(256) r LEFT JOIN c ON c.code = r.range), s AS (SELECT sum(m) AS total FROM g)
  SELECT {r("-sum(m / total * ln(m / total))", "entropy")}, count(n) AS used FROM g, s""")
def codebook_entropy(spark, d):
    rows = table(spark, d, "embeddings").select(paths.pack(paths.sign_bits(F.slice("embedding", 1, 8))).alias("token"))
    return rounded(paths.code_entropy(rows, "token", 256))


_LOGITS = """logits AS (SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS token, CAST(embedding[i] AS DOUBLE) * 10 AS logit FROM embeddings, range(1, 65) t(i))"""
_FILTERED = f"""WITH {_LOGITS}, k AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS rk FROM logits),
  e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM k WHERE rk <= 20), s AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e),
  c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY row_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)"""


def _logits(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token", "x"))
    return rows.select("row_id", "token", (F.col("x").cast("double") * 10).alias("logit"))


@query("topk_topp_filter", f"{_FILTERED} SELECT row_id, token, {r('p / sum(p) OVER (PARTITION BY row_id)', 'p')} FROM c WHERE before < 0.9")
def topk_topp_filter(spark, d):
    return rounded(paths.top_k_top_p(_logits(spark, d), k=20, p=0.9).select("row_id", "token", "p"))


@query("greedy_token", f"WITH {_LOGITS} SELECT row_id, arg_max(token, (logit, -token)) AS token FROM logits GROUP BY 1")
def greedy_token(spark, d):
    return paths.greedy(_logits(spark, d))


@query("sampled_token")
def sampled_token(spark, d):
    return paths.sampled(paths.top_k_top_p(_logits(spark, d), k=20, p=0.9), seed=7)


@query("baseline_suite")
def baseline_suite(spark, d):
    return rounded(baselines.suite(daily(spark, d), 5))


@query("full_outer_align", f"""WITH {bars_sql()}, a AS (SELECT instrument_id, ts, close AS actual FROM bars WHERE ts < TIMESTAMP '2024-01-25'), f AS (SELECT instrument_id, ts, close * 1.01 AS forecast FROM bars WHERE ts >= TIMESTAMP '2024-01-20')
  SELECT instrument_id, ts, {r("actual")}, {r("forecast")}, {r("coalesce(actual, forecast)", "combined")} FROM a FULL OUTER JOIN f USING (instrument_id, ts)""")
def full_outer_align(spark, d):
    bars, at = daily(spark, d), F.col("ts")
    forecast = bars.where(at >= F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("close", F.col("close") * 1.01)
    return rounded(pit.aligned(bars.where(at < F.lit("2024-01-25").cast("timestamp_ntz")), forecast, on=("instrument_id", "ts")))
