"""Facts about a series: frequency, summaries, window sizes, calendar ranges, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import PRICES, by_time


def steps(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Seconds since the bar before."""
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by_time(ts=ts)).cast("timestamp"))) / 1e6
    return bars.withColumn("step_seconds", seconds)


def frequency(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Most frequent step of each instrument (the smaller of equals), how many steps differ, and whether time always rises."""
    rows = steps(bars, ts).where("step_seconds IS NOT NULL")
    counts = rows.groupBy("instrument_id", "step_seconds").agg(F.count("*").alias("n"))
    out = counts.groupBy("instrument_id").agg(
        F.max_by("step_seconds", F.struct(F.col("n"), -F.col("step_seconds"))).alias("step_seconds"), (F.sum("n") - F.max("n")).alias("other_steps"), F.min(F.col("step_seconds") > 0).alias("rising")
    )
    return out


def timeframe(bars: DataFrame, ts: str = "ts", first: int = 10) -> DataFrame:
    """The mean of the first steps in words: seconds, minutes, hours or days."""
    rows = steps(bars, ts).withColumn("rn", F.row_number().over(by_time(ts=ts))).where(F.col("rn") <= first)
    mean = rows.groupBy("instrument_id").agg(F.avg("step_seconds").alias("s"))
    text = lambda size, word: F.concat(F.round(F.col("s") / size).cast("long").cast("string"), F.lit(f" {word}"))
    words = F.when(F.col("s") < 60, text(1, "seconds")).when(F.col("s") < 3600, text(60, "minutes")).when(F.col("s") < 86400, text(3600, "hours")).otherwise(text(86400, "days"))
    return mean.select("instrument_id", words.alias("timeframe"))


def summary(bars: DataFrame) -> DataFrame:
    """Lowest, highest and last price of each kind, rows and time range of each instrument."""
    aggs = [f(c).alias(f"{n}_{c}") for c in PRICES for n, f in (("min", F.min), ("max", F.max))]
    return bars.groupBy("instrument_id").agg(F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), *aggs, *(F.max_by(c, "ts").alias(f"last_{c}") for c in PRICES))


def statistics(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument_id").agg(
        F.max("close").alias("max_close"), F.min("close").alias("min_close"), F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("std_close"),
        F.avg("volume").alias("mean_volume"), F.max("volume").alias("max_volume"), F.min("volume").alias("min_volume"),
    )


def window_sizes(days: Column, *, horizon_days: int) -> tuple[Column, Column]:
    """Lookback (100 to 400) and horizon (20 to 120) from the number of days with a bar and of calendar days ahead."""
    lookback = F.greatest(F.lit(100), F.least(F.lit(400), F.floor(days * 0.7)))
    horizon = F.greatest(F.lit(20), F.least(F.lit(120), F.floor(F.lit(horizon_days) * 5 / 7)))
    return lookback.cast("int"), horizon.cast("int")


def tick_interval(points: Column) -> Column:
    """Days between axis ticks by the number of points."""
    return F.when(points <= 30, 2).when(points <= 90, 7).when(points <= 180, 14).when(points <= 365, 30).otherwise(60)


def calendar_range(bars: DataFrame, *, begin: str, end: str, before: int, after: int, ts: str = "ts") -> DataFrame:
    """Bars from `before` calendar positions ahead of `begin` to `after` positions behind `end`.

    The calendar is the table of distinct bar times, small next to the bars; its two bounds
    are joined as one row, and the range reaches the scan as a filter where they are literals.
    """
    calendar = bars.select(ts).distinct().withColumn("position", F.row_number().over(Window.orderBy(ts)))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    ends = calendar.agg(F.min(F.when(F.col(ts) >= at(begin), F.col("position"))).alias("b"), F.max(F.when(F.col(ts) <= at(end), F.col("position"))).alias("e"))
    bounds = calendar.crossJoin(F.broadcast(ends)).where(F.col("position").between(F.col("b") - before, F.col("e") + after))  # ends is one row
    limits = bounds.agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))
    return bars.crossJoin(F.broadcast(limits)).where(F.col(ts).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row


def market_vote(trends: DataFrame) -> DataFrame:
    """Mean strength over instruments, and whether at least half of them rise."""
    return trends.agg(F.avg("strength").alias("mean_strength"), (F.count_if(F.col("is_up")) >= F.count("*") / 2).alias("market_up"))
