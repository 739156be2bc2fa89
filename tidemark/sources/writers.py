"""Sinks: verified Parquet archives, yearly CSV, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import row_digest, table_fingerprint


def save_archive(frame: DataFrame, path: str, *, key: str = "instrument_id") -> None:
    """Parquet by key next to a manifest with rows and a digest of each key; an existing archive is refused."""
    if key not in frame.columns or len(set(frame.columns)) != len(frame.columns):
        raise ValueError("an archive needs its key column and distinct column names")
    frame.repartition(key).sortWithinPartitions(key).write.mode("errorifexists").partitionBy(key).parquet(f"{path}/data")
    _manifest(frame, key).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def _manifest(frame: DataFrame, key: str) -> DataFrame:
    digest = row_digest(frame)
    parts = [F.sum(F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    return frame.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("rows"), *parts)


def load_archive(spark: SparkSession, path: str, *, key: str = "instrument_id", schema: str | None = None) -> DataFrame:
    """The frame of an archive whose members are all listed and unchanged; ValueError otherwise."""
    manifest = spark.read.parquet(f"{path}/manifest")
    frame = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/data")
    frame = frame.withColumn(key, F.col(key).cast("string")) if schema is None else frame
    if not _manifest(frame, key).exceptAll(manifest).isEmpty() or not manifest.exceptAll(_manifest(frame, key)).isEmpty():
        raise ValueError("the archive does not match its manifest")
    return frame


def save_yearly_csv(bars: DataFrame, path: str, ts: str = "ts") -> None:
    bars.withColumn("year", F.year(ts)).repartition("year").write.mode("errorifexists").partitionBy("year").csv(path, header=True)


def save_signals(signals: DataFrame, path: str) -> None:
    """Long signals (signal, ts, instrument_id, value), a folder for each signal."""
    signals.write.mode("errorifexists").partitionBy("signal").parquet(path)


def history_and_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    tagged = history.withColumn("part", F.lit("history"))
    return tagged.unionByName(forecast.withColumn("part", F.lit("forecast")), allowMissingColumns=True)


def save_report(frame: DataFrame, path: str, *, keys: Sequence[str] = ()) -> None:
    """One JSON document for each row; the table's fingerprint stands beside it."""
    frame.orderBy(*keys).write.mode("errorifexists").json(f"{path}/report") if keys else frame.write.mode("errorifexists").json(f"{path}/report")
    table_fingerprint(frame).write.mode("errorifexists").json(f"{path}/fingerprint")


def prediction_report(forecast: DataFrame, last_close: DataFrame) -> DataFrame:
    """Each forecast with its absolute and percent change against the last close."""
    rows = forecast.join(last_close, "instrument_id")
    change = F.col("forecast") - F.col("last_close")
    return rows.withColumns({"change": change, "change_pct": F.try_divide(change, F.col("last_close")) * 100})


def market_report(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each row a JSON report with the notes that apply: strong above 1, weak below -1."""
    notes = F.array_compact(F.array(*(F.when(F.col(n) > 1, F.lit(f"{n}: strong")).when(F.col(n) < -1, F.lit(f"{n}: weak")) for n in names)))
    return scores.withColumn("report", F.to_json(F.struct("instrument_id", *names, notes.alias("notes"))))
