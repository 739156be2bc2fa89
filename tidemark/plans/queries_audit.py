"""Queries: validation rules, point-in-time joins, audits, splits, set operations, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, pit, rules, splits, windows
from . import adapters as A
from .adapters import CANONICAL_SQL, bars_sql, daily, hourly, r, rounded, table
from .registry import query

CAN = f"WITH {CANONICAL_SQL}"
UTC_SESSIONS = {"XNYS": rules.Calendar("UTC", 0, 86399)}


def _found(spark, d):
    return rules.violations(A.canonical(spark, d), rules.Config(as_of="2024-01-31 00:00:00", stale_after=20 * 86400), UTC_SESSIONS)


_ROW = """SELECT code, row_no, instrument_id FROM (SELECT row_no, instrument_id, unnest(list_filter([
    CASE WHEN trim(instrument_id) = '' THEN 'blank_instrument_id' END, CASE WHEN ingested_at < timestamp_utc THEN 'ingested_before_event' END,
    CASE WHEN open IS NULL THEN 'non_finite_open' END, CASE WHEN high < greatest(open, close) THEN 'high_below_body' END, CASE WHEN low > least(open, close) THEN 'low_above_body' END,
    CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
    CASE WHEN adjustment_factor <= 0 THEN 'non_positive_adjustment_factor' END, CASE WHEN is_adjusted IS NULL THEN 'missing_adjusted_flag' END], lambda x: x IS NOT NULL)) AS code FROM canonical)"""
_GROUP = """SELECT code, row_no, instrument_id FROM (SELECT row_no, instrument_id, unnest(list_filter([
    CASE WHEN count(*) OVER (PARTITION BY instrument_id, timestamp_utc) > 1 THEN 'duplicate_key' END, CASE WHEN bool_or(coalesce(back, false)) OVER (PARTITION BY instrument_id) THEN 'unordered_timestamps' END],
    lambda x: x IS NOT NULL)) AS code FROM (SELECT *, timestamp_utc < lag(timestamp_utc) OVER (PARTITION BY instrument_id ORDER BY row_no) AS back FROM canonical))"""
_ATTRIBUTE = """SELECT code, row_no, instrument_id FROM (SELECT row_no, instrument_id, unnest(list_filter([
    CASE WHEN min(exchange) OVER i <> max(exchange) OVER i THEN 'inconsistent_exchange' END, CASE WHEN min(currency) OVER i <> max(currency) OVER i THEN 'inconsistent_currency' END,
    CASE WHEN min(is_adjusted) OVER i <> max(is_adjusted) OVER i THEN 'mixed_adjustment' END],
    lambda x: x IS NOT NULL)) AS code FROM canonical WINDOW i AS (PARTITION BY instrument_id))"""
_CALENDAR = """SELECT code, row_no, instrument_id FROM (SELECT row_no, instrument_id, unnest(list_filter([
    CASE WHEN exchange <> 'XNYS' THEN 'unknown_exchange' END, CASE WHEN exchange = 'XNYS' AND isodow(timestamp_utc) > 5 THEN 'outside_session' END,
    CASE WHEN exchange = 'XNYS' AND gap > 0 THEN 'missing_bars' END, CASE WHEN exchange = 'XNYS' AND gap > 3 THEN 'gap_too_long' END,
    CASE WHEN timestamp_utc < TIMESTAMP '2024-01-11' THEN 'stale_bar' END, CASE WHEN ingested_at > TIMESTAMP '2024-01-31' THEN 'ingested_in_future' END],
    lambda x: x IS NOT NULL)) AS code FROM (SELECT *, coalesce(len(list_filter(generate_series(before + INTERVAL 1 DAY, timestamp_utc - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda t: isodow(t) < 6)), 0) AS gap
      FROM (SELECT *, lag(timestamp_utc) OVER (PARTITION BY instrument_id ORDER BY timestamp_utc) AS before FROM canonical)))"""


def _codes(found, *codes):
    return found.where(F.col("code").isin(*codes)).select("code", "row_no", "instrument_id")


_ROW_CODES = ("blank_instrument_id", "ingested_before_event", "non_finite_open", "high_below_body", "low_above_body", "non_positive_price", "negative_volume", "non_positive_adjustment_factor", "missing_adjusted_flag")


@query("rule_violations", f"{CAN} {_ROW}")
def rule_violations(spark, d):
    return _codes(_found(spark, d), *_ROW_CODES)


@query("duplicate_and_order_rules", f"{CAN} {_GROUP}")
def duplicate_and_order_rules(spark, d):
    return _codes(_found(spark, d), "duplicate_key", "unordered_timestamps")


@query("attribute_consistency", f"{CAN} {_ATTRIBUTE}")
def attribute_consistency(spark, d):
    return _codes(_found(spark, d), "inconsistent_exchange", "inconsistent_currency", "mixed_adjustment")


_UNBLANK = "instrument_id <> ' '"


@query("sessions_gap_report", f"{CAN} SELECT * FROM ({_CALENDAR}) WHERE {_UNBLANK}")
def sessions_gap_report(spark, d):
    found = _codes(_found(spark, d), "unknown_exchange", "outside_session", "missing_bars", "gap_too_long", "stale_bar", "ingested_in_future")
    return found.where(_UNBLANK)  # rows under one blank name have no order of their own


@query("issue_report", f"""{CAN}, f AS ({_ROW} UNION ALL {_GROUP} UNION ALL {_ATTRIBUTE})
  SELECT code, count(*) AS n, list_sort(list(row_no))[1:20] AS rows, list_sort(list(DISTINCT instrument_id))[1:20] AS instruments FROM f GROUP BY 1""")
def issue_report(spark, d):
    codes = (*_ROW_CODES, "duplicate_key", "unordered_timestamps", "inconsistent_exchange", "inconsistent_currency", "mixed_adjustment")
    found = _found(spark, d)
    return rules.issue_report(found.where(F.col("code").isin(*codes))).select("code", "n", "rows", "instruments")


@query("validation_totals", f"{CAN} SELECT count(*) AS rows, count(DISTINCT instrument_id) AS instruments, min(timestamp_utc) AS start, max(timestamp_utc) AS \"end\" FROM canonical")
def validation_totals(spark, d):
    out = rules.totals(A.canonical(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("offending_instrument_semi_join", f"""WITH {bars_sql("day", "user_id")} SELECT instrument_id, ts, {r("close")} FROM bars WHERE instrument_id IN (SELECT instrument_id FROM bars GROUP BY 1 HAVING max(high) > 6 * avg(close))""")
def offending_instrument_semi_join(spark, d):
    rows = daily(spark, d, "user_id")
    bad = rows.groupBy("instrument_id").agg(F.max("high").alias("h"), F.avg("close").alias("c")).where("h > 6 * c")
    return rounded(rows.join(bad, "instrument_id", "left_semi").select("instrument_id", "ts", "close"))


# Point-in-time joins.


@query("asof_last_tick", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts AS qts, value FROM events WHERE event_type <> 'purchase')
  SELECT l.event_id, l.user_id, l.ts, q.qts AS asof_quote_ts, floor((q.value) * 1e6 + 0.5001) / 1e6 AS value FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.ts >= q.qts""")
def asof_last_tick(spark, d):
    ticks = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = ticks.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ticks.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("quote_ts"), "value", F.col("event_id").alias("quote_id"))
    return rounded(pit.as_of(left, right, by=["user_id"], left_ts="ts", right_ts="quote_ts", values=["value"], order=["quote_id"]))


@query("prediction_window_lookup", f"""WITH {bars_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS rn FROM bars),
  o AS (SELECT *, rn - min(CASE WHEN ts >= TIMESTAMP '2024-01-08 12:00:00' THEN rn END) OVER (PARTITION BY instrument_id) AS off FROM n)
  SELECT instrument_id, ts, CAST(off AS INTEGER) AS "offset", CASE WHEN off < 5 THEN 'context' ELSE 'horizon' END AS part FROM o WHERE off BETWEEN 0 AND 7""")
def prediction_window_lookup(spark, d):
    rows = pit.first_at_or_after(daily(spark, d), F.lit("2024-01-08 12:00:00").cast("timestamp_ntz"), context=5, horizon=3)
    return rows.select("instrument_id", "ts", F.col("offset").cast("int").alias("offset"), "part")


_MEMBERS = """rows AS (SELECT o_orderkey, o_custkey AS instrument_id, o_orderdate AS prediction_ts FROM orders),
  firsts AS (SELECT o_custkey AS instrument_id, min(o_orderdate) AS f FROM orders GROUP BY 1),
  intervals AS (SELECT instrument_id, f AS member_from, f + INTERVAL 900 DAY AS member_to, f + INTERVAL 60 DAY AS known_at, instrument_id % 5 <> 0 AS included FROM firsts)"""
_COVERED = "EXISTS (SELECT 1 FROM intervals i WHERE i.instrument_id = rows.instrument_id AND prediction_ts BETWEEN member_from AND member_to AND known_at <= prediction_ts AND included)"


def _members(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select("o_orderkey", F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").alias("prediction_ts"))
    first = F.col("f")
    intervals = orders.groupBy(F.col("o_custkey").alias("instrument_id")).agg(F.min("o_orderdate").alias("f")).select(
        "instrument_id", first.alias("member_from"), (first + F.expr("INTERVAL 900 DAY")).alias("member_to"), (first + F.expr("INTERVAL 60 DAY")).alias("known_at"), (F.col("instrument_id") % 5 != 0).alias("included")
    )
    return rows, intervals


@query("interval_membership_join", f"WITH {_MEMBERS} SELECT o_orderkey, instrument_id, prediction_ts FROM rows WHERE {_COVERED}")
def interval_membership_join(spark, d):
    return pit.member(*_members(spark, d))


@query("interval_membership_anti", f"WITH {_MEMBERS} SELECT o_orderkey, instrument_id, prediction_ts FROM rows WHERE NOT {_COVERED}")
def interval_membership_anti(spark, d):
    return pit.member(*_members(spark, d), anti=True)


_SPLITS = """splits AS (SELECT * FROM (VALUES ('train', 'train', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-12'), ('validation', 'validation', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-18'),
  ('test', 'test', TIMESTAMP '2024-01-18 12:00:00', TIMESTAMP '2024-01-24'), ('final', 'final_holdout', TIMESTAMP '2024-01-26', TIMESTAMP '2024-01-30')) v(name, role, target_start, target_end))"""


def _splits(spark):
    return spark.sql(_SPLITS.replace("splits AS (", "").rstrip(")").replace("TIMESTAMP '", "TIMESTAMP_NTZ '") + ")")


@query("split_label_broadcast_join", f"""WITH {bars_sql()}, {_SPLITS}, w AS (SELECT instrument_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sample_id, CASE WHEN day(ts) <= 12 THEN 'train' WHEN day(ts) <= 18 THEN 'validation' WHEN day(ts) <= 24 THEN 'test' ELSE 'other' END AS split,
    ts + INTERVAL 1 DAY AS ts1, ts + INTERVAL 2 DAY AS ts2 FROM bars)
  SELECT CASE WHEN s.name IS NULL THEN 'sample_split_unknown' ELSE 'sample_label_crosses_split' END AS code, sample_id AS row_id FROM w LEFT JOIN splits s ON w.split = s.name
  WHERE s.name IS NULL OR ts1 < target_start OR ts2 > target_end""")
def split_label_broadcast_join(spark, d):
    day = F.dayofmonth("ts")
    split = F.when(day <= 12, "train").when(day <= 18, "validation").when(day <= 24, "test").otherwise("other")
    later = lambda n: F.col("ts") + F.expr(f"INTERVAL {n} DAY")
    windows_ = daily(spark, d).select(
        F.concat("instrument_id", F.lit("@"), F.to_date("ts").cast("string")).alias("sample_id"), split.alias("split"), F.col("ts").alias("prediction_timestamp"), later(-5).alias("lookback_start"),
        F.col("ts").alias("lookback_end"), F.col("ts").alias("normalization_end"), later(1).alias("target_start"), later(2).alias("target_end"),
    )
    return pit.audit_windows(windows_, _splits(spark)).select("code", "row_id")


@query("split_overlap_embargo", f"""WITH {_SPLITS}, o AS (SELECT *, lag(target_end) OVER (ORDER BY target_start, name) AS before FROM splits)
  SELECT 'split_target_overlap' AS code, name AS row_id FROM o WHERE target_start <= before UNION ALL SELECT 'split_embargo_violation', name FROM o WHERE target_start > before AND target_start < before + INTERVAL 1 DAY""")
def split_overlap_embargo(spark, d):
    return pit.audit_splits(_splits(spark), embargo_days=1).select("code", "row_id")


_EVENTS = """sel AS (SELECT event_id, CASE WHEN event_id % 997 = 0 THEN 'final_evaluate' ELSE 'select' END AS purpose, CASE WHEN event_id % 5 = 0 THEN 'final' WHEN event_id % 5 = 1 THEN 'validation' WHEN event_id % 5 = 2 THEN 'train'
  WHEN event_id % 5 = 3 THEN 'test' ELSE 'unheard' END AS split, ts AS occurred_at FROM events)"""


@query("selection_isolation", f"""WITH {_SPLITS}, {_EVENTS}, j AS (SELECT sel.*, role, purpose = 'final_evaluate' AS fin, min(CASE WHEN purpose = 'final_evaluate' THEN occurred_at END) OVER () AS first_final FROM sel LEFT JOIN splits ON split = name)
  SELECT code, CAST(event_id AS VARCHAR) AS row_id FROM (SELECT event_id, unnest(list_filter([CASE WHEN role IS NULL THEN 'selection_split_unknown' END, CASE WHEN NOT fin AND role IN ('test', 'final_holdout') THEN 'selection_uses_test' END,
    CASE WHEN NOT fin AND occurred_at > TIMESTAMP '2024-01-20' THEN 'selection_after_freeze' END, CASE WHEN fin AND role <> 'final_holdout' THEN 'final_evaluation_wrong_split' END,
    CASE WHEN fin AND occurred_at < TIMESTAMP '2024-01-20' THEN 'final_evaluation_before_freeze' END, CASE WHEN fin AND occurred_at > first_final THEN 'final_evaluation_repeated' END,
    CASE WHEN NOT fin AND occurred_at > first_final THEN 'selection_after_final_evaluation' END, CASE WHEN occurred_at > TIMESTAMP '2024-01-29' THEN 'event_after_audit' END], lambda x: x IS NOT NULL)) AS code FROM j)""")
def selection_isolation(spark, d):
    five, eid = F.col("event_id") % 5, F.col("event_id")
    events = table(spark, d, "events").select(
        "event_id", F.when(eid % 997 == 0, "final_evaluate").otherwise("select").alias("purpose"),
        F.when(five == 0, "final").when(five == 1, "validation").when(five == 2, "train").when(five == 3, "test").otherwise("unheard").alias("split"), F.col("ts").alias("occurred_at"),
    )
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return pit.audit_selection(events, _splits(spark), frozen_at=at("2024-01-20"), audited_at=at("2024-01-29")).select("code", "row_id")


@query("late_knowledge_audit", """SELECT code, CAST(event_id AS VARCHAR) AS row_id FROM (SELECT event_id, unnest(list_filter([CASE WHEN value > 40 THEN 'feature_available_after_prediction' END,
    CASE WHEN event_id % 50 = 0 THEN 'rolling_window_uses_future' END, CASE WHEN event_id % 333 = 0 THEN 'feature_derived_from_target' END], lambda x: x IS NOT NULL)) AS code FROM events)""")
def late_knowledge_audit(spark, d):
    eid, ts = F.col("event_id"), F.col("ts")
    rows = table(spark, d, "events").select(
        eid.alias("sample_id"), ts.alias("prediction_timestamp"), (ts - F.expr("INTERVAL 1 HOUR")).alias("observation_timestamp"),
        F.when(F.col("value") > 40, ts + F.expr("INTERVAL 1 HOUR")).otherwise(ts).alias("available_at"),
        F.when(eid % 50 == 0, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts).alias("window_end"), (eid % 333 == 0).alias("derived_from_target"),
    )
    return pit.audit_features(rows).select("code", "row_id")


@query("corporate_action_audit", """SELECT code, instrument_id AS row_id, count(*) AS n FROM (SELECT event_type AS instrument_id, unnest(list_filter([CASE WHEN event_id % 2 = 0 AND event_id % 10 = 0 THEN 'future_corporate_action_knowledge' END,
    CASE WHEN event_id % 2 = 0 AND event_id % 14 = 0 THEN 'future_effective_action_applied' END], lambda x: x IS NOT NULL)) AS code FROM events) GROUP BY 1, 2""")
def corporate_action_audit(spark, d):
    eid, ts = F.col("event_id"), F.col("ts")
    late = lambda k: F.when(eid % k == 0, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("instrument_id"), ts.alias("prediction_timestamp"), ts.alias("feature_timestamp"), late(14).alias("action_effective_at"), late(10).alias("action_known_at"), (eid % 2 == 0).alias("adjustment_applied")
    )
    return pit.audit_actions(rows).groupBy("code", "row_id").agg(F.count("*").alias("n"))


@query("feature_grid_anti_join", f"""WITH {bars_sql()}, s AS (SELECT instrument_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sample_id, CAST(volume AS BIGINT) AS v FROM bars), n AS (SELECT unnest(['ma5', 'ma20', 'std5']) AS feature_name),
  p AS (SELECT sample_id, feature_name FROM s, n WHERE NOT (v % 3 = 0 AND feature_name = 'ma20')) SELECT s.sample_id, n.feature_name FROM s, n WHERE (s.sample_id, n.feature_name) NOT IN (SELECT (sample_id, feature_name) FROM p)""")
def feature_grid_anti_join(spark, d):
    samples = daily(spark, d).select(F.concat("instrument_id", F.lit("@"), F.to_date("ts").cast("string")).alias("sample_id"), F.col("volume").cast("long").alias("v"))
    names = spark.createDataFrame([("ma5",), ("ma20",), ("std5",)], "feature_name string")
    present = samples.crossJoin(F.broadcast(names)).where(~((F.col("v") % 3 == 0) & (F.col("feature_name") == "ma20")))  # three names
    return pit.missing_cells(samples, names, present)


@query("grid_setdiff", """(SELECT user_id, event_type, 'expected' AS side FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10'))
  UNION ALL (SELECT user_id, event_type, 'actual' FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10'))""")
def grid_setdiff(spark, d):
    ticks, cut = table(spark, d, "events"), F.lit("2024-01-10").cast("timestamp_ntz")
    cells = lambda test: ticks.where(test).select("user_id", "event_type").distinct()
    return pit.unequal(cells(F.col("ts") < cut), cells(F.col("ts") >= cut))


@query("later_rows_only", f"""WITH {bars_sql()}, h AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-20' OR instrument_id = 'view'), f AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-15'),
  m AS (SELECT f.instrument_id, f.ts, f.ts > l.last AS later, bool_or(f.ts > l.last) OVER (PARTITION BY f.instrument_id) AS any_later FROM f JOIN (SELECT instrument_id, max(ts) AS last FROM h GROUP BY 1) l USING (instrument_id))
  SELECT instrument_id, ts FROM m WHERE later OR NOT any_later""")
def later_rows_only(spark, d):
    bars, at = daily(spark, d), lambda t: F.lit(t).cast("timestamp_ntz")
    history = bars.where((F.col("ts") < at("2024-01-20")) | (F.col("instrument_id") == "view"))
    return pit.later_than(history, bars.where(F.col("ts") >= at("2024-01-15"))).select("instrument_id", "ts")


@query("block_window_truth_join", f"""WITH {bars_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS rn FROM bars), b AS (SELECT *, (rn - 10) // 5 AS block FROM n WHERE rn >= 10),
  a AS (SELECT instrument_id, (rn + 1 - 10) // 5 AS block, close AS anchor FROM n WHERE (rn + 1 - 10) % 5 = 0 AND rn >= 9)
  SELECT instrument_id, ts, CAST(block AS BIGINT) AS block, {r("close / anchor - 1", "move")} FROM b JOIN a USING (instrument_id, block)""")
def block_window_truth_join(spark, d):
    from ..operators.bars import by_time

    rows = daily(spark, d).withColumn("rn", F.row_number().over(by_time()) - 1)
    blocks = rows.where("rn >= 10").withColumn("block", F.floor((F.col("rn") - 10) / 5))
    anchors = rows.where("rn >= 9 AND (rn + 1 - 10) % 5 = 0").select("instrument_id", F.floor((F.col("rn") + 1 - 10) / 5).alias("block"), F.col("close").alias("anchor"))
    return rounded(blocks.join(anchors, ["instrument_id", "block"]).select("instrument_id", "ts", "block", (F.col("close") / F.col("anchor") - 1).alias("move")))


@query("sector_theta_match", """WITH hot AS (SELECT * FROM (VALUES ('ring', 0.3::DOUBLE), ('widget', 0.8), ('red', 0.5)) v(sector, momentum))
  SELECT p_partkey, floor((avg(momentum)) * 1e6 + 0.5001) / 1e6 AS mean_momentum, bool_or(momentum > 0.6) AS any_hot, arg_max(sector, momentum) AS main_sector FROM part JOIN hot ON contains(p_name, sector) GROUP BY 1""")
def sector_theta_match(spark, d):
    hot = spark.createDataFrame([("ring", 0.3), ("widget", 0.8), ("red", 0.5)], "sector string, momentum double")
    matched = table(spark, d, "part").join(F.broadcast(hot), F.col("p_name").contains(F.col("sector")))  # three sectors
    return rounded(matched.groupBy("p_partkey").agg(F.avg("momentum").alias("mean_momentum"), F.bool_or(F.col("momentum") > 0.6).alias("any_hot"), F.max_by("sector", "momentum").alias("main_sector")))


# Splits and plans.

_PLAN = splits.WalkForward(train=200, validation=48, test=24, calibration=24, purge=2, embargo=12, holdout=72, stride=96)


@query("walk_forward_folds", f"""WITH {bars_sql("hour")}, idx AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS position FROM (SELECT DISTINCT ts FROM bars)), size AS (SELECT count(*) AS n FROM idx),
  folds AS (SELECT f.range AS fold, f.range * 96 AS s FROM size, range(0, greatest(0, (n - 72 - 12 - 302) // 96 + 1)) f),
  b AS (SELECT fold, unnest(['train_start', 'train_end', 'validation_start', 'validation_end', 'calibration_start', 'calibration_end', 'test_start', 'test_end']) AS bound,
    unnest([0, s + 199, s + 202, s + 249, s + 252, s + 275, s + 278, s + 301]) AS position FROM folds) SELECT fold, bound, position, ts FROM b JOIN idx USING (position)""")
def walk_forward_folds(spark, d):
    index = splits.numbered(hourly(spark, d))
    return splits.fold_times(splits.fold_positions(spark, index.count(), _PLAN), index)


@query("ratio_time_split", f"""WITH {bars_sql("day", "user_id")}, p AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY instrument_id) AS n FROM bars)
  SELECT instrument_id, ts, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM p""")
def ratio_time_split(spark, d):
    return splits.by_ratio(daily(spark, d, "user_id"), train=0.7, validation=0.15).select("instrument_id", "ts", "split")


@query("range_time_split", f"WITH {bars_sql()} SELECT instrument_id, ts, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-15' THEN 'train' WHEN ts BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-24' THEN 'test' END AS split FROM bars")
def range_time_split(spark, d):
    split = splits.by_ranges(F.col("ts"), [("train", "2024-01-01", "2024-01-15"), ("test", "2024-01-17", "2024-01-24")])
    return daily(spark, d).select("instrument_id", "ts", split.alias("split"))


@query("long_history_filter", f"WITH {bars_sql('day', 'user_id')}, n AS (SELECT *, count(*) OVER (PARTITION BY instrument_id) AS n FROM bars) SELECT instrument_id, ts FROM n WHERE n >= 28")
def long_history_filter(spark, d):
    return splits.long_enough(daily(spark, d, "user_id"), 28, ["open", "close"]).select("instrument_id", "ts")


@query("future_perturbation_probe", f"""WITH {bars_sql()} SELECT instrument_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS row_id FROM bars WHERE ts <= TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-14'""")
def future_perturbation_probe(spark, d):
    """A centered mean looks ahead: its last rows before the cutoff change with the future."""
    rows = daily(spark, d).withColumn("row_id", F.concat("instrument_id", F.lit("@"), F.to_date("ts").cast("string")))
    smooth = lambda f: f.withColumn("smooth", windows.centered_mean("close", 5))
    return pit.future_probe(rows, smooth, row="row_id", ts="ts", cutoff=F.lit("2024-01-15").cast("timestamp_ntz"), column="close", output="smooth").select("row_id")


# Identity.


@query("table_fingerprint")
def table_fingerprint(spark, d):
    return identity.table_fingerprint(table(spark, d, "orders"))


@query("ordered_fingerprint")
def ordered_fingerprint(spark, d):
    return identity.ordered_fingerprint(table(spark, d, "orders"), "o_orderkey")


@query("alias_chain_check", """WITH e AS (SELECT event_type AS alias, event_id AS seq, 'x' || CAST(event_id AS VARCHAR) AS experiment FROM events),
  p AS (SELECT *, lag(experiment) OVER (PARTITION BY alias ORDER BY seq) AS was FROM e), q AS (SELECT *, CASE WHEN seq % 100 = 0 THEN 'lost' ELSE was END AS previous FROM p)
  SELECT alias, seq, experiment, previous FROM q WHERE previous IS DISTINCT FROM was""")
def alias_chain_check(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select(F.col("event_type").alias("alias"), F.col("event_id").alias("seq"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("experiment"))
    was = F.lag("experiment").over(Window.partitionBy("alias").orderBy("seq"))
    return identity.broken_chain(rows.withColumn("previous", F.when(F.col("seq") % 100 == 0, "lost").otherwise(was)))


@query("source_gate_checks", """SELECT c_custkey AS source_id, list_filter([CASE WHEN c_nationkey % 2 = 0 THEN 'licence_reviewed' END, CASE WHEN c_acctbal < 0 THEN 'calendar_verified' END,
  CASE WHEN c_custkey % 12 < 8 THEN 'history_too_short' END], lambda x: x IS NOT NULL) AS failed, NOT (c_nationkey % 2 = 0 OR c_acctbal < 0 OR c_custkey % 12 < 8) AS passed FROM customer""")
def source_gate_checks(spark, d):
    rows = table(spark, d, "customer")
    fields = {c: F.lit(True) for c in identity.EVIDENCE} | {"licence_reviewed": F.col("c_nationkey") % 2 != 0, "calendar_verified": F.col("c_acctbal") >= 0}
    years = (F.col("c_custkey") % 12).cast("int")
    rows = rows.select(F.col("c_custkey").alias("source_id"), *(c.alias(k) for k, c in fields.items()), F.lit("2010-01-01").cast("date").alias("history_start"), F.make_date(F.lit(2010) + years, F.lit(1), F.lit(3)).alias("history_end"))
    return identity.source_gate(rows)
