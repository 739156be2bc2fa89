"""Bars from ticks, derived columns and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FEATURES = (*PRICES, "volume", "amount")


def ohlc_bars(ticks: DataFrame, *, instrument: str, price: str, width: str, ts: str = "ts", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """One bar for each instrument and tumbling window with a tick; one partial and one final aggregation."""
    key = F.struct(ts, *order)
    return (
        ticks.groupBy(F.col(instrument).alias("instrument_id"), F.window(ts, width)["start"].alias("ts"))
        .agg(
            F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
            F.count("*").cast("double").alias("volume"), F.sum(price).alias("amount"),
        )
    )


def by_time(partition: str = "instrument_id", ts: str = "ts"):
    return Window.partitionBy(partition).orderBy(ts)


def time_features(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """minute, hour, weekday (Monday 0), day and month of the bar's time."""
    at = F.col(ts)
    return bars.withColumns({
        "minute": F.minute(at), "hour": F.hour(at), "weekday": F.weekday(at), "day": F.dayofmonth(at), "month": F.month(at),
    })


def returns(bars: DataFrame, *, price: str = "close") -> DataFrame:
    """diff, pct and log_diff against the bar before; amplitude in percent of the open."""
    before = F.lag(price).over(by_time())
    return bars.withColumns({
        "diff": F.col(price) - before, "pct": F.col(price) / before - 1, "log_diff": F.log(price) - F.log(before),
        "amplitude": F.try_divide(F.col("high") - F.col("low"), F.col("open")) * 100,
    })


def rename_known(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns of the mapping that are there."""
    return frame.withColumnsRenamed({a: b for a, b in names.items() if a in frame.columns})


def text_number(column: Column) -> Column:
    """A number out of text with thousands separators; empty text and -- are null."""
    bare = F.trim(F.replace(column, F.lit(","), F.lit("")))
    return F.when(~bare.isin("", "--"), bare.try_cast("double"))


def repaired_open(bars: DataFrame) -> DataFrame:
    """An open that is null or 0 becomes the close before, or else the bar's own close."""
    before = F.lag("close").over(by_time())
    bad = F.col("open").isNull() | (F.col("open") == 0)
    return bars.withColumn("open", F.when(bad, F.coalesce(before, F.col("close"))).otherwise(F.col("open")))


def amount_or_proxy(bars: DataFrame) -> DataFrame:
    """Where all amounts of an instrument are null or 0: close times volume."""
    empty = F.bool_and(F.coalesce(F.col("amount"), F.lit(0.0)) == 0).over(Window.partitionBy("instrument_id"))
    return bars.withColumn("amount", F.when(empty, F.col("close") * F.col("volume")).otherwise(F.col("amount")))


def with_volume_and_amount(bars: DataFrame) -> DataFrame:
    """A missing volume makes volume and amount 0; a missing amount is volume times the mean price."""
    if "volume" not in bars.columns:
        return bars.withColumns({"volume": F.lit(0.0), "amount": F.lit(0.0)})
    if "amount" not in bars.columns:
        return bars.withColumn("amount", F.col("volume") * (sum((F.col(c) for c in PRICES), F.lit(0.0)) / 4))
    return bars


def local_time(bars: DataFrame, zone: str, ts: str = "ts") -> DataFrame:
    return bars.withColumn("local_ts", F.from_utc_timestamp(ts, zone))


def scaled(bars: DataFrame, factor: Column, *, cap: float = 0.1, volume_part: float = 0.3) -> DataFrame:
    """Prices times a factor held within 1 - cap and 1 + cap; volume takes part of the change."""
    held = F.greatest(F.lit(1 - cap), F.least(F.lit(1 + cap), factor))
    return bars.withColumns({**{c: F.col(c) * held for c in PRICES}, "volume": F.col("volume") * (1 + (held - 1) * volume_part)})


def adjustment_factor(scores: Mapping[str, float], low: float = 0.9, high: float = 1.1) -> Column:
    """1 plus the weighted sum of score columns, within bounds; a missing score counts as 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in scores.items()), F.lit(1.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def holiday_uplift(bars: DataFrame, holidays: DataFrame, *, days: int, uplift: float) -> DataFrame:
    """Closes from a holiday's end (`end_date`) on, for some days, times 1 + uplift; applied once."""
    ends = holidays.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("end_date", i))).alias("_day")).distinct()
    joined = bars.join(ends, F.to_date("ts") == F.col("_day"), "left")
    return joined.withColumn("close", F.col("close") * F.when(F.col("_day").isNotNull(), 1 + uplift).otherwise(1.0)).drop("_day")


def shrunk_outliers(frame: DataFrame, value: str, reference: str, *, band: float = 0.3, keep: float = 0.5) -> DataFrame:
    """Values further than the band from the reference move towards it."""
    gap = F.col(value) - F.col(reference)
    far = F.abs(gap) > band * F.abs(F.col(reference))
    return frame.withColumn(value, F.when(far, F.col(reference) + gap * keep).otherwise(F.col(value)))


def reference_band(price: Column, band: float = 0.25, floor: float = 1.0) -> Column:
    return F.struct(F.greatest(F.lit(floor), price * (1 - band)).alias("low"), (price * (1 + band)).alias("high"))


def clamped_by_limit(bars: DataFrame, rate: float = 0.1) -> DataFrame:
    """Closes held within a rate of the close before, itself held: a fold over each instrument's ordered array."""
    ordered = bars.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)["limited"]
        held = F.greatest(last * (1 - rate), F.least(last * (1 + rate), x["close"]))
        return F.concat(done, F.array(F.struct(x["ts"].alias("ts"), x["close"].alias("close"), held.alias("limited"))))

    first = F.struct(F.col("s")[0]["ts"].alias("ts"), F.col("s")[0]["close"].alias("close"), F.col("s")[0]["close"].alias("limited"))
    folded = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.array(first), step)
    return ordered.select("instrument_id", F.inline(folded))


def future_business_days(last: DataFrame, *, count: int, holidays: DataFrame | None = None, instrument: str = "instrument_id", date: str = "last_date") -> DataFrame:
    """The next `count` weekdays after each date that are no holidays, numbered from 1.

    `holidays` has one column day. Enough calendar days are laid out for the weekends and for all holidays.
    """
    extra = holidays.count() if holidays is not None else 0
    span = 7 * ((count + extra) // 5 + 2)
    days = last.select(instrument, F.explode(F.sequence(F.date_add(date, 1), F.date_add(date, span))).alias("day")).where(F.weekday("day") < 5)
    if holidays is not None:
        days = days.join(holidays.select("day"), "day", "left_anti")
    order = Window.partitionBy(instrument).orderBy("day")
    return days.withColumn("step", F.row_number().over(order)).where(F.col("step") <= count)


def continuity_gap(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Absolute and percent gap of the first forecast bar to the last known one, for each price."""
    last = history.groupBy("instrument_id").agg(*(F.max_by(c, "ts").alias(f"last_{c}") for c in PRICES))
    first = forecast.groupBy("instrument_id").agg(*(F.min_by(c, "ts").alias(c) for c in PRICES))
    gaps = {f"{c}_gap": F.abs(F.col(c) - F.col(f"last_{c}")) for c in PRICES}
    gaps |= {f"{c}_gap_pct": F.try_divide(F.abs(F.col(c) - F.col(f"last_{c}")), F.col(f"last_{c}")) * 100 for c in PRICES}
    return first.join(last, "instrument_id").select("instrument_id", *(v.alias(k) for k, v in gaps.items()))
