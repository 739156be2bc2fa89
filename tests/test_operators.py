"""Operators on small fixtures with known results, poisons, metamorphic and plan checks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators import backtest, bars, baselines, costs, evaluation, folds, identity, metrics, paths, pit, rules, splits, windows
from tidemark.sources import readers, replay, writers

DAYS = "SELECT id, timestamp'2020-01-01' + make_dt_interval(cast(7 * floor((id + 2) / 5) + (id + 2) % 5 - 2 as int)) AS ts FROM range(80)"


def series(spark, n=80):
    """80 business days from 2020-01-01 of slowly rising closes."""
    rows = [("A", i, 100 * math.exp(0.001 * i) * (1 + 0.01 * math.sin(i / 4))) for i in range(n)]
    frame = spark.createDataFrame(rows, "instrument_id string, id long, close double")
    return frame.join(spark.sql(DAYS), "id").drop("id"), np.array([r[2] for r in rows])


def values(frame, key="step", value="forecast"):
    return [r[value] for r in frame.orderBy(key).collect()]


def test_closed_forms_of_baselines(spark):
    frame, c = series(spark)
    h = np.arange(1, 6)
    np.testing.assert_allclose(values(baselines.last_value(frame, 5)), c[-1])
    np.testing.assert_allclose(values(baselines.drift(frame, 5)), c[-1] * np.exp(h * (np.log(c[-1]) - np.log(c[0])) / 79))
    np.testing.assert_allclose(values(baselines.seasonal_naive(frame, 5, 3)), c[-3:][(h - 1) % 3])
    np.testing.assert_allclose(values(baselines.rolling_mean(frame, 5, 7)), c[-7:].mean())
    level = c[0]
    for x in c[1:]:
        level = 0.3 * x + 0.7 * level
    np.testing.assert_allclose(values(baselines.exponential_smoothing(frame, 5, 0.3)), level)
    np.testing.assert_allclose(values(baselines.momentum(frame, 5, 4)), c[-1] * np.exp(h * np.log(c[-1] / c[-5]) / 4))
    m = c[-10:].mean()
    np.testing.assert_allclose(values(baselines.mean_reversion(frame, 5, 10, 0.2)), m + (c[-1] - m) * 0.8**h)
    b, a = np.polyfit(np.arange(20), np.log(c[-20:]), 1)
    np.testing.assert_allclose(values(baselines.linear_regression(frame, 5, 20)), np.exp(a + b * (19 + h)))


def test_grouped_baselines(spark):
    frame, c = series(spark)
    low, high = np.diff(np.log(c)).min(), np.diff(np.log(c)).max()
    steps = np.diff(np.log(np.r_[c[-1], values(baselines.autoregression(frame, 5))]))
    assert (steps >= low - 1e-12).all() and (steps <= high + 1e-12).all()
    assert values(baselines.tree(frame, 5)) == values(baselines.tree(frame.repartition(4), 5))
    one, two = (values(baselines.simulated(frame, 5, seed=s)) for s in (1, 1))
    assert one == two != values(baselines.simulated(frame, 5, seed=2))
    assert {r.model_name for r in baselines.suite(frame, 2).select("model_name").distinct().collect()} == set(baselines.REGISTRY)
    with pytest.raises(ValueError):
        baselines.suite(frame, 0)


def test_walk_forward_positions(spark):
    plan = splits.WalkForward(train=10, validation=4, calibration=2, test=3, purge=1, embargo=2, holdout=5)
    rows = splits.fold_positions(spark, 80, plan).orderBy("fold").collect()
    assert len(rows) == 5
    assert list(rows[0])[1:] == [0, 9, 11, 14, 16, 17, 19, 21] and rows[1].train_end == 21 and rows[4].test_end == 69
    rolling = splits.fold_positions(spark, 80, splits.WalkForward(10, 4, 3, mode="rolling", maximum_folds=2)).collect()
    assert len(rolling) == 2 and all(r.train_end - r.train_start == 9 for r in rolling)
    assert splits.fold_positions(spark, 12, plan).count() == 0
    with pytest.raises(ValueError):
        splits.WalkForward(0, 1, 1)
    times = splits.fold_times(splits.fold_positions(spark, 80, plan), splits.numbered(spark.sql(DAYS)))
    assert times.count() == 5 * 8


def clean_bars(spark, n=2, **change):
    rows = [dict(row_no=i, instrument_id="BHP", exchange="XASX", currency="AUD", frequency="1D", open=40.0 + i, high=41.0 + i, low=39.0 + i, close=40.5 + i, volume=1000.0 + i,
                 amount=40500.0 + i, adjustment_factor=1.0, is_adjusted=True, source="fixture", day=2 + i) | change.get(f"r{i}", {}) for i in range(n)]
    schema = "row_no long, instrument_id string, exchange string, currency string, frequency string, open double, high double, low double, close double, volume double, amount double, adjustment_factor double, is_adjusted boolean, source string, day int"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    at = F.make_timestamp(F.lit(2025), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))
    return frame.withColumns({"timestamp_utc": at, "ingested_at": F.lit("2025-01-10").cast("timestamp")}).drop("day")


def codes(frame, **config):
    return {r.code for r in rules.violations(frame, rules.Config(**config)).collect()}


def test_clean_bars_pass_with_warnings(spark):
    frame = clean_bars(spark)
    assert codes(frame) == set() and rules.passes(rules.violations(frame))
    assert {c for c, _ in rules.standing_warnings(frame, rules.Config())} == {"calendar_holidays_unverified", "corporate_action_causality_unverified", "staleness_not_evaluated"}


def test_poisoned_bars_tell_all_codes(spark):
    bad = clean_bars(spark, 3, r1={"day": 2, "high": 1.0, "low": 100.0, "volume": -1.0, "currency": "USD"}, r2={"instrument_id": ""})
    assert {"duplicate_key", "high_below_body", "low_above_body", "negative_volume", "inconsistent_currency", "blank_instrument_id"} <= codes(bad)
    nan = clean_bars(spark, 3, r0={"open": float("nan")}, r1={"close": float("inf")}, r2={"low": -1.0, "frequency": "7x", "exchange": "NOPE"})
    assert {"non_finite_open", "non_finite_close", "non_positive_price", "unsupported_frequency", "unknown_exchange"} <= codes(nan) and "high_below_body" not in codes(nan)
    assert {"stale_bar", "ingested_in_future"} <= codes(clean_bars(spark), as_of="2025-01-09 00:00:00", stale_after=86400)
    assert "unexpected_adjustment" in codes(clean_bars(spark), adjustment="raw")
    gap = codes(clean_bars(spark, 2, r1={"day": 28}))
    assert {"missing_bars", "gap_too_long"} <= gap
    back = clean_bars(spark, 2, r0={"row_no": 5})
    assert "unordered_timestamps" in codes(back)
    report = rules.issue_report(rules.violations(bad)).where("code = 'duplicate_key'").first()
    assert report.n == 2 and report.rows == [0, 1]


SPLITS = [("train", "train", "2025-01-01", "2025-01-31"), ("validation", "validation", "2025-02-03", "2025-02-14"), ("calibration", "calibration", "2025-02-17", "2025-02-21"),
          ("test", "test", "2025-02-24", "2025-02-28"), ("final", "final_holdout", "2025-03-03", "2025-03-07")]


def split_frame(spark, rows=SPLITS):
    frame = spark.createDataFrame(rows, "name string, role string, target_start string, target_end string")
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in ("target_start", "target_end")})


def test_split_audit(spark):
    assert pit.audit_splits(split_frame(spark), embargo_days=1).count() == 0
    bad = [(n, r, "2025-01-30" if n == "validation" else s, e) for n, r, s, e in SPLITS]
    assert {r.code for r in pit.audit_splits(split_frame(spark, bad), embargo_days=1).collect()} == {"split_target_overlap"}
    assert {r.code for r in pit.audit_splits(split_frame(spark, SPLITS[:4])).collect()} == {"final_holdout_missing"}


def test_selection_audit(spark):
    events = spark.createDataFrame([(1, "select", "validation", "2025-02-15"), (2, "final_evaluate", "final", "2025-03-08"), (3, "hyperparameter_search", "final", "2025-03-09")], "event_id long, purpose string, split string, t string")
    events = events.withColumn("occurred_at", F.col("t").cast("timestamp"))
    at = lambda t: F.lit(t).cast("timestamp")
    found = pit.audit_selection(events, split_frame(spark), frozen_at=at("2025-02-22"), audited_at=at("2025-03-10")).collect()
    assert {r.code for r in found} == {"selection_uses_test", "selection_after_freeze", "selection_after_final_evaluation"} and {r.row_id for r in found} == {"3"}


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(4), rng.randrange(50)) for i in range(60)]
    right = [(i, rng.randrange(4), rng.randrange(50)) for i in range(60)]
    a = spark.createDataFrame(left, "id long, k int, t long")
    b = spark.createDataFrame(right, "v long, k int, u long")
    for strict in (False, True):
        got = {r.id: r.v for r in pit.as_of(a, b, by=["k"], left_ts="t", right_ts="u", values=["v"], order=["v"], strict=strict).collect()}
        for i, k, t in left:
            fits = [(u, v) for v, key, u in right if key == k and (u < t or (u == t and not strict))]
            assert got[i] == (max(fits)[1] if fits else None)
    plan = pit.as_of(a, b, by=["k"], left_ts="t", right_ts="u", values=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1


def observations(spark):
    rows = [(f"I{i}", d, d + 1, 1, 100.0 + i, (100.0 + i) * (1 + (i - 2.5) * 0.01 + d * 0.001), 1.0, 1.0 if (i - 2.5) * 0.01 + d * 0.001 > 0 else 0.0, "m", "v", [1.0, 3.0]) for d in range(3) for i in range(6)]
    frame = spark.createDataFrame(rows, "instrument_id string, as_of int, target_ts int, horizon int, reference_value double, actual_value double, scale_error double, probability_positive double, market_regime string, volatility_regime string, samples array<double>")
    return frame.withColumns({"point_forecast": F.col("actual_value"), "q05": F.col("actual_value") - 1, "q50": F.col("actual_value"), "q95": F.col("actual_value") + 1})


def test_perfect_forecast(spark):
    frame = observations(spark)
    total = metrics.scorecard(frame).where("level = 'total'").first()
    assert (total.n, total.mae, total.rmse, total.mase, total.directional_accuracy, total.precision, total.recall) == (18, 0, 0, 0, 1, 1, 1)
    sections = metrics.cross_sections(frame).collect()
    assert len(sections) == 3 and all(abs(s.ic - 1) < 1e-9 and abs(s.rank_ic - 1) < 1e-9 for s in sections)
    probabilistic = metrics.probabilistic(frame).first()
    assert probabilistic.coverage == 1 and probabilistic.brier == 0
    table = metrics.calibration(frame)
    assert table.count() == 10 and abs(metrics.expected_calibration_error(table).first().ece) < 1e-12
    assert frame.select(metrics.crps(F.col("samples"), F.lit(2.0)).alias("x")).first().x == 0.5
    assert not any(metrics.contract(frame).first())
    shuffled = metrics.scorecard(frame.orderBy(F.rand(3)).repartition(5)).where("level = 'total'").first()
    assert shuffled == total


def test_calibration_edges(spark):
    p = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    got = [r.b for r in spark.createDataFrame([(x,) for x in p], "p double").select(metrics.calibration_bin(F.col("p"), 10).alias("b")).collect()]
    edges = np.linspace(0, 1, 11)
    assert got == [min(int(np.searchsorted(edges, x, side="right")) - 1, 9) for x in p]


def test_cost_ledger(spark):
    rows = [(d, i, w, r) for d, (ws, rs) in enumerate([((0.5, -0.5), (0.02, -0.01)), ((0.5, -0.5), (0.01, 0.02)), ((0.0, 0.0), (0.03, -0.02))]) for i, w, r in zip("AB", ws, rs, strict=True)]
    frame = spark.createDataFrame(rows, "d int, instrument_id string, target_weight double, realized_return double")
    frame = frame.selectExpr("d AS decision_ts", "d + 1 AS realization_ts", "instrument_id", "target_weight", "realized_return", "1e8 AS dollar_volume", "'s' AS sector")
    base = costs.Assumptions()
    free = costs.Assumptions("free", commission_bps=0, half_spread_bps=0, slippage_bps=0, impact_bps=0)
    periods = costs.period_ledger(costs.trade_ledger(frame, costs.scenarios(spark, [base, free])))
    rows = periods.where("name = 'base'").orderBy("realization_ts").collect()
    assert [r.turnover for r in rows] == [1, 0, 1]
    np.testing.assert_allclose([r.gross_return for r in rows], [0.015, -0.005, 0], atol=1e-15)
    assert all(abs(r.net_return - (r.gross_return - r.commission - r.half_spread - r.slippage - r.impact)) < 1e-15 for r in rows)
    assert all(r.net_return == r.gross_return for r in periods.where("name = 'free'").collect())
    assert not any(costs.contract(frame).first())
    with pytest.raises(Exception, match="participation cap"):
        costs.trade_ledger(frame.withColumn("dollar_volume", F.lit(1.0)), costs.scenarios(spark, [base])).collect()
    with pytest.raises(ValueError):
        costs.scenarios(spark, [base, base])


def test_fold_comparison(spark):
    mae = {"baseline": (2.0, 2.2, 1.8, 2.1), "candidate": (1.8, 2.0, 1.9, 2.0)}
    rows = [(m, f, "mae", v, False) for m, vs in mae.items() for f, v in zip(("fold-1", "fold-2", "fold-3", "final"), vs, strict=True)]
    frame = spark.createDataFrame(rows, "model_name string, fold_id string, metric_name string, value double, higher_is_better boolean")
    out = folds.paired(frame, "baseline", holdout=["final"]).first()
    assert abs(out.mean_improvement - 0.1) < 1e-12 and (out.improved, out.folds) == (2, 3)
    one, two = (folds.bootstrap(f, "baseline", resamples=500).first() for f in (frame, frame.repartition(3)))
    assert one == two and one.low <= one.mean_improvement <= one.high
    assert folds.contract(frame).count() == 0 and folds.contract(frame.limit(7)).count() >= 1


def test_windows_do_not_see_the_future(spark):
    frame, _ = series(spark)
    cut = F.lit("2020-03-01").cast("timestamp")
    ahead = lambda f: f.withColumn("z", windows.rolling_mean("close", 5))
    assert pit.future_probe(frame.withColumn("row", F.col("ts").cast("string")), ahead, row="row", ts="ts", cutoff=cut, column="close", output="z").count() == 0
    rows = windows.sliding_windows(frame, "close", context=8, horizon=3)
    row = rows.first()
    assert rows.count() == 80 - 8 - 3 + 1 and abs(np.mean(row.context_z)) < 1e-6 and abs(np.std(row.context_z) - 1) < 2e-4


def test_drawdown_variants(spark):
    frame = spark.createDataFrame([("A", i, r) for i, r in enumerate([-0.5, 1.0, 0.2])], "instrument_id string, ts int, r double")
    with_start, without = (windows.wealth(frame, "r", start_peak=p).orderBy("ts").collect() for p in (1.0, None))
    np.testing.assert_allclose([r.drawdown for r in with_start], [-0.5, 0, 0], atol=1e-12)
    np.testing.assert_allclose([r.drawdown for r in without], [0, 0, 0], atol=1e-12)


def test_positions_and_trips(spark):
    rows = [("A", t, p, s) for t, (p, s) in enumerate([(10.0, 1), (12.0, 0), (15.0, -1), (15.0, 1), (30.0, -1)])]
    out = backtest.run_positions(spark.createDataFrame(rows, "instrument_id string, ts int, close double, signal int"), capital=105.0)
    got = out.orderBy("ts").collect()
    assert [(r.action, r.shares) for r in got] == [("BUY", 10), ("HOLD", 10), ("SELL", 0), ("BUY", 10), ("SELL", 0)] and got[-1].equity == 305
    assert [round(r.trade_return, 6) for r in backtest.round_trips(out).orderBy("k").collect()] == [0.5, 1.0]


def test_limits_and_cleaning(spark):
    frame = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 150.0), ("A", 3, 50.0)], "instrument_id string, ts int, close double")
    np.testing.assert_allclose([r.limited for r in bars.clamped_by_limit(frame).orderBy("ts").collect()], [100, 110, 99])
    numbers = spark.createDataFrame([("1,234.5",), ("--",), ("",), ("x",), (None,)], "t string").select(bars.text_number(F.col("t")).alias("n"))
    assert [r.n for r in numbers.collect()] == [1234.5, None, None, None, None]
    with_amount = bars.with_volume_and_amount(spark.createDataFrame([(1.0, 3.0, 1.0, 3.0, 5.0)], "open double, high double, low double, close double, volume double"))
    assert with_amount.first().amount == 10.0


def test_candles(spark):
    rows = [("s", 0, 1, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0), ("s", 1, 1, 3.0, 2.0, 2.5, 1.5, -1.0, 1.0), ("s", 2, 1, float("nan"), 2.0, 1.0, 1.5, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "series string, sample int, step int, open double, high double, low double, close double, volume double, amount double")
    found = {(r.sample, r.field, r.code) for r in paths.issues(frame).collect()}
    assert found == {(1, "high", "high_below_body"), (1, "low", "low_above_body"), (1, "volume", "negative"), (2, "open", "non_finite")}
    fixed = paths.projected(frame).where("sample = 1").first()
    assert (fixed.high, fixed.low, fixed.volume) == (3.0, 1.5, 0.0) and {r.field for r in fixed.repairs} == {"high", "low", "volume"}
    assert [r.sample for r in paths.valid_paths(frame).collect()] == [0]


def test_tokens_and_sampling(spark):
    row = spark.createDataFrame([([1, 0, 1, 1],)], "b array<int>").select(paths.pack(F.col("b")).alias("n"), paths.pack(F.col("b"), most_first=True).alias("m"))
    row = row.select("n", "m", paths.unpack(F.col("n"), 4).alias("b")).first()
    assert (row.n, row.m, row.b) == (13, 11, [1, 0, 1, 1])
    logits = spark.createDataFrame([(0, t, x) for t, x in enumerate([5.0, 4.0, 4.0, 1.0])], "row_id long, token int, logit double")
    assert {r.token for r in paths.top_k_top_p(logits, k=2, p=1.0).collect()} == {0, 1, 2}  # ties at the k-th stay
    assert {r.token for r in paths.top_k_top_p(logits, k=4, p=0.01).collect()} == {0}
    assert paths.greedy(logits).first().token == 0 and paths.sampled(paths.softmax(logits), 1).first().token in range(4)


def test_fingerprints(spark):
    frame = spark.createDataFrame([(i, i * 0.5, None if i % 2 else "x") for i in range(50)], "a int, b double, c string")
    print_ = identity.table_fingerprint(frame).first().fingerprint
    assert print_ == identity.table_fingerprint(frame.orderBy(F.desc("a")).repartition(3)).first().fingerprint
    assert print_ != identity.table_fingerprint(frame.withColumn("b", F.when(F.col("a") == 7, 0.0).otherwise(F.col("b")))).first().fingerprint
    assert identity.ordered_fingerprint(frame, "a", 7).first() == identity.ordered_fingerprint(frame.repartition(4), "a", 7).first()


def test_registry(tmp_path):
    registry = identity.Registry(tmp_path)
    a, b = (registry.register({"model": m, "decision_grade": True}) for m in "ab")
    assert registry.register({"model": "a", "decision_grade": True}) == a
    registry.set_alias("best", a, "2025-01-01T00:00:00Z")
    registry.set_alias("best", b, "2025-01-02T00:00:00Z")
    assert registry.resolve("best") == b and [e["previous"] for e in registry.history("best")] == [None, a]
    with pytest.raises(ValueError):
        registry.set_alias("best", a, "2025-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        registry.set_alias("other", registry.register({"model": "c"}), "2025-01-01T00:00:00Z")
    (tmp_path / "records" / f"{a}.json").write_text("{}")
    with pytest.raises(ValueError):
        registry.get(a)
    with pytest.raises(FileExistsError):
        identity.write_once(tmp_path / "records" / f"{a}.json", b"[]")


GOOD = "timestamps,open,high,low,close,volume\n2025-01-01,1,2,0.5,1.5,10\n2025-01-02,1,2,0.5,1.5,10\n"
BAD = {
    "missing columns": GOOD.replace("close", "klose"), "no rows": GOOD.split("\n")[0] + "\n", "unreadable timestamps": GOOD.replace("2025-01-02", "soon"),
    "timestamps repeat": GOOD.replace("2025-01-02", "2025-01-01"), "timestamps do not rise": GOOD.replace("2025-01-02", "2024-01-02"),
    "unreadable or infinite": GOOD.replace("1.5,10\n2025-01-02", "x,10\n2025-01-02"), "prices must be positive": GOOD.replace(",0.5,", ",-0.5,"),
    "volume and amount": GOOD.replace(",10", ",-10"), "high is below": GOOD.replace(",2,", ",1.2,"), "low is above": GOOD.replace(",0.5,", ",1.3,"), "distinct names": GOOD.replace("volume", "close"),
}


def test_strict_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text(GOOD)
    assert readers.read_strict_csv(spark, tmp_path, "good.csv").count() == 2
    for problem, content in BAD.items():
        (tmp_path / "bad.csv").write_text(content)
        with pytest.raises(ValueError, match=problem):
            readers.read_strict_csv(spark, tmp_path, "bad.csv")
    for name in ("../good.csv", "", "x.csv", "good.txt", ".hidden.csv", "a\\b.csv"):
        with pytest.raises(ValueError):
            readers.resolve(tmp_path, name)
    assert [r.name for r in readers.listing(spark, str(tmp_path)).collect()] == ["bad.csv", "good.csv"]


def test_payloads_and_headers(spark):
    good = '/**/cb({"data":{"klines":["2025-01-02,1,2,3,0.5,10","bad","2025-01-03,1,x,3,0.5"]}});'
    broken = 'cb({"data":{"klines":["2025-01-02,1,2,3,0.5","2025-01-03,1,2,3,0.5,7"],,,'
    rows = readers.jsonp_lines(spark.createDataFrame([("a", good), ("b", broken), ("c", None)], "id string, payload string")).orderBy("id", "ts").collect()
    assert [(r.id, r.close, r.volume) for r in rows] == [("a", 2.0, 10.0), ("b", 2.0, 0.0), ("b", 2.0, 7.0)]
    assert readers.canonical_headers(spark.createDataFrame([(1, 2)], "`开盘` int, other int")).columns == ["open", "other"]
    found = spark.createDataFrame([("600000",), ("000001",), ("",)], "c string").select(readers.market_of(F.col("c")).alias("m"))
    assert [r.m for r in found.collect()] == ["1", "0", "1"]


def test_sources_and_settings(spark, tmp_path):
    def broken():
        raise OSError("down")

    out = readers.first_available(spark, [("a", broken), ("b", lambda: spark.range(0)), ("c", lambda: spark.range(2))])
    assert {r.data_source for r in out.collect()} == {"c"}
    calls = []
    fetch = lambda: calls.append(1) or spark.range(3)
    assert [readers.cached(spark, str(tmp_path / "t"), fetch).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    assert readers.synthetic_bars(spark, 30).where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    walk = readers.random_walk(spark, 200, backwards=True).orderBy("ts").collect()
    assert len(walk) == 200 and abs(walk[-1].close - 100) < 1e-9 and all(30 <= r.close <= 1000 for r in walk)
    config = readers.Settings({"exp_name": "x", "paths": {"out": "/tmp/{exp_name}"}})
    config.update({"paths": {"n": 1}})
    assert config.get("paths.out") == "/tmp/x" and config.get("paths.n") == 1 and config.get("no.such", 5) == 5
    with pytest.raises(ValueError):
        readers.load_pickle("x.pkl")


def test_archive(spark, tmp_path):
    frame = spark.createDataFrame([("AAPL", 1, 1.0), ("名/前", 2, None)], "instrument_id string, t int, x double")
    writers.save_archive(frame, str(tmp_path / "a"))
    assert sorted(map(tuple, readers_rows := writers.load_archive(spark, str(tmp_path / "a")).select("instrument_id", "t", "x").collect()), key=str) and len(readers_rows) == 2
    frame.limit(1).write.mode("append").partitionBy("instrument_id").parquet(str(tmp_path / "a" / "data"))
    with pytest.raises(ValueError):
        writers.load_archive(spark, str(tmp_path / "a"))


def test_source_gate(spark):
    good = {c: True for c in identity.EVIDENCE}
    rows = [("ok", good), *((c, good | {c: False}) for c in identity.EVIDENCE)]
    frame = spark.createDataFrame([(n, *(d[c] for c in identity.EVIDENCE)) for n, d in rows], "source_id string, " + ", ".join(f"{c} boolean" for c in identity.EVIDENCE))
    frame = frame.withColumns({"history_start": F.lit("2010-01-01").cast("date"), "history_end": F.lit("2020-01-01").cast("date")})
    for r in identity.source_gate(frame).collect():
        assert r.passed == (r.source_id == "ok") and r.failed == ([] if r.passed else [r.source_id])


def test_argument_checks():
    assert checks.whole(3, "n") == 3 and checks.finite(0.5, "x", 0, 1) == 0.5 and checks.text("a", "t") == "a" and checks.utc("2025-01-01T00:00:00+00:00", "t")
    for bad in (lambda: checks.whole(True, "n"), lambda: checks.whole(0, "n"), lambda: checks.finite(math.nan, "x"), lambda: checks.text(" ", "t"), lambda: checks.utc("2025-01-01T00:00:00", "t")):
        with pytest.raises(ValueError):
            bad()


def test_replay_source(spark, tmp_path):
    (tmp_path / "600000.csv").write_text("﻿日期,开盘,收盘,最高,最低,成交量\n2025-01-02,1,2,3,0.5,\"1,000\"\n2025-01-03,x,2,3,0.5,5\n", encoding="utf-8")
    (tmp_path / "000001.csv").write_text("ts,open,close\n2025-01-02,1,2\n")
    spark.dataSource.register(replay.ReplaySource)
    rows = spark.read.format("tidemark_replay").option("path", str(tmp_path)).load().orderBy("instrument_id", "ts").collect()
    assert [(r.instrument_id, r.open, r.volume) for r in rows] == [("000001", 1.0, None), ("600000", 1.0, 1000.0), ("600000", None, 5.0)]


def test_evaluation(spark):
    frame = observations(spark).withColumn("model_name", F.lit("a"))
    both = frame.unionByName(frame.withColumn("model_name", F.lit("b")))
    assert evaluation.missing_models(both, ["a", "b", "c"]) == ["c"] and evaluation.truth_mismatch(both).count() == 0
    assert evaluation.truth_mismatch(both.where("NOT (model_name = 'b' AND as_of = 1)")).count() == 6
    scored = evaluation.score_models(both.withColumn("fold_id", F.lit("f"))).collect()
    assert {(r.model_name, r.n, r.mae) for r in scored} == {("a", 18, 0), ("b", 18, 0)}
    folds_ = spark.createDataFrame([("d", "c", "s", 1), ("d", "c", "t", 2)], "dataset_id string, code_commit string, split_hash string, fold int")
    audits = spark.createDataFrame([("d", "c", "s", True, "x")], "dataset_id string, code_commit string, split_hash string, passed boolean, audit_id string")
    done = evaluation.attach_audit(folds_, audits)
    assert {r.fold: r.audited for r in done.collect()} == {1: True, 2: False} and not evaluation.decision_grade(done).first()[0]
