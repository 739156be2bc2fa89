"""Streaming counterparts: bars, de-duplication, staleness, state by key. Batch frames work too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def tumbling_bars(ticks: DataFrame, *, instrument: str = "event_type", price: str = "value", ts: str = "ts", width: str = "1 day", delay: str = "2 days", slide: str | None = None) -> DataFrame:
    """Bars of tumbling (or, with slide, overlapping) windows under a watermark; late ticks beyond it are dropped."""
    key = F.struct(ts, "event_id")
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        ticks.withWatermark(ts, delay).groupBy(F.col(instrument).alias("instrument_id"), window.alias("w"))
        .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("volume"), F.sum(price).alias("amount"))
        .select("instrument_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")
    )


def sessions(ticks: DataFrame, *, by: str = "user_id", ts: str = "ts", gap: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Runs of ticks of a key without a gap."""
    out = ticks.withWatermark(ts, delay).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("ticks"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks")


def deduplicated(ticks: DataFrame, *, keys: tuple[str, ...] = ("event_id",), ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark's delay; in a batch, one row of each key."""
    if ticks.isStreaming:
        return ticks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return ticks.dropDuplicates(list(keys))


def admissible(ticks: DataFrame, *, as_of: str, stale_after: str, ts: str = "ts", ingested: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that are neither stale nor ingested before their event or after as_of; and all others."""
    limit = F.expr(f"CAST('{as_of}' AS TIMESTAMP)")
    good = F.col(ts) >= limit - F.expr(f"INTERVAL {stale_after}")
    if ingested:
        good &= (F.col(ingested) >= F.col(ts)) & (F.col(ingested) <= limit)
    good = F.coalesce(good, F.lit(False))
    return ticks.where(good), ticks.where(~good)


def known_in_time(predictions: DataFrame, facts: DataFrame, *, by: str, at: str = "prediction_ts", available: str = "available_at") -> DataFrame:
    """Facts that were available when a prediction was made; a stream joins a static table."""
    return predictions.join(facts, by).where(F.col(available) <= F.col(at))


def deltas(ticks: DataFrame, *, by: str = "event_type", value: str = "value", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each tick with its change against the key's tick before, 0 for the first; the state is one value for each key.

    Within a micro-batch ticks go in order; across batches in order of arrival.
    """
    kind = ticks.schema[by].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(list(order))
        before = state.get[0] if state.exists else None
        values = rows[value].to_numpy(float)
        last = [values[0] if before is None else before, *values[:-1]]
        state.update((float(values[-1]),))
        yield pd.DataFrame({by: key[0], "event_id": rows["event_id"].to_numpy(), "delta": values - last})

    columns = list(dict.fromkeys([by, "event_id", value, *order]))
    return ticks.select(*columns).groupBy(by).applyInPandasWithState(
        update, f"{by} {kind}, event_id long, delta double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def run_available(spark: SparkSession, frame: DataFrame, name: str, folder: str) -> DataFrame:
    """Run an appending stream over all that is there into Parquet, and give the result."""
    writer = frame.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-checkpoint")
    writer.outputMode("append").format("parquet").option("path", f"{folder}/{name}").start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")


def latest(spark: SparkSession, frame: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run an updating stream over all that is there, and give the last state of each key.

    Each micro-batch is a folder of its own, written again if it is tried again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = frame.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    columns = frame.columns
    rows = spark.read.schema(StructType([*frame.schema.fields, StructField("_batch", LongType())])).parquet(f"{folder}/rows/batch=*")
    values = [c for c in columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*keys, "v.*").select(*columns)
