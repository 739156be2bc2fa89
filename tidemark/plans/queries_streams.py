"""Queries that run as streams over all rows that are there; their oracles are batch SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import bars as S
from .adapters import r, rounded, table
from .registry import query


def _folder(spark) -> str:
    """Under spark.checkpoint.dir; where it is unset, a new folder of this machine (no cluster then)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        atexit.register(shutil.rmtree, root := tempfile.mkdtemp(prefix="tidemark-stream-"), True)
    return f"{root}/stream-{uuid.uuid4().hex}"


def _ticks(spark, d):
    schema = table(spark, d, "events").schema
    # a pattern, as a stream cannot read a single file by its plain path; watermarks need a zoned time
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(frame):
    """Times without a zone, as in the tables."""
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in frame.dtypes if kind == "timestamp"})


def _day(column: str) -> str:
    return f"CAST(date_trunc('day', {column}) AS TIMESTAMP)"


@query("stream_tumbling_bars", f"""SELECT event_type AS instrument_id, {_day("e.ts")} AS ts, {r("first(e.value ORDER BY e.ts, e.event_id)", "open")}, {r("max(e.value)", "high")}, {r("min(e.value)", "low")},
  {r("last(e.value ORDER BY e.ts, e.event_id)", "close")}, count(*) AS volume, {r("sum(e.value)", "amount")} FROM events e GROUP BY 1, 2""")
def stream_tumbling_bars(spark, d):
    frame = S.tumbling_bars(_ticks(spark, d), delay="60 days")
    return _plain(rounded(S.latest(spark, frame, ["instrument_id", "ts"], _folder(spark))))


@query("stream_sliding_bars", f"""WITH e AS (SELECT *, unnest([{_day("ts")}, {_day("ts")} - INTERVAL 1 DAY]) AS s FROM events)
  SELECT event_type AS instrument_id, s AS ts, {r("max(value)", "high")}, {r("min(value)", "low")}, count(*) AS volume FROM e GROUP BY 1, 2""")
def stream_sliding_bars(spark, d):
    frame = S.tumbling_bars(_ticks(spark, d), width="2 days", slide="1 day", delay="60 days").select("instrument_id", "ts", "high", "low", "volume")
    return _plain(rounded(S.latest(spark, frame, ["instrument_id", "ts"], _folder(spark))))


@query("session_windows", """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS cut FROM events), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS ticks FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    return _plain(S.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), gap="6 hours"))


@query("stream_dedup", "SELECT event_id, user_id, ts, floor((value) * 1e6 + 0.5001) / 1e6 AS value FROM events")
def stream_dedup(spark, d):
    ticks = _ticks(spark, d).select("event_id", "user_id", "ts", "value")
    twice = ticks.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return _plain(rounded(S.run_available(spark, S.deduplicated(twice, delay="60 days"), "dedup", _folder(spark))))


@query("stream_state_delta", """SELECT event_type, event_id, floor((value - coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), value)) * 1e6 + 0.5001) / 1e6 AS delta FROM events""")
def stream_state_delta(spark, d):
    return rounded(S.run_available(spark, S.deltas(_ticks(spark, d)), "delta", _folder(spark)))


@query("stream_stale_split", """SELECT event_id, ts < TIMESTAMP '2024-01-20' AS stale FROM events""")
def stream_stale_split(spark, d):
    good, bad = S.admissible(_ticks(spark, d), as_of="2024-01-30 00:00:00", stale_after="10 DAYS")
    folder = _folder(spark)
    fresh = S.run_available(spark, good.select("event_id", F.lit(False).alias("stale")), "fresh", folder)
    return fresh.unionByName(S.run_available(spark, bad.select("event_id", F.lit(True).alias("stale")), "stale", folder))
