"""Ordered functions over bars: rolling statistics, smoothing, drawdown, ranks, sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_time


def rolling_mean(column: str, k: int) -> Column:
    """Mean of the last k rows; null before there are k."""
    frame = by_time().rowsBetween(1 - k, 0)
    return F.when(F.count(column).over(frame) == k, F.avg(column).over(frame))


def centered_mean(column: str, k: int) -> Column:
    """Mean of k rows around the row, of fewer at the ends."""
    return F.avg(column).over(by_time().rowsBetween(-(k // 2), (k - 1) // 2))


def forward_fill(column: str) -> Column:
    return F.last(column, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def wealth(bars: DataFrame, simple_return: str, *, start_peak: float | None = 1.0) -> DataFrame:
    """wealth, peak and drawdown of compounded returns.

    start_peak 1.0 counts the start as a peak; None takes the first wealth instead.
    """
    frame = by_time().rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce(F.col(simple_return), F.lit(0.0)))).over(frame)))
    peak = F.max("wealth").over(frame)
    out = out.withColumn("peak", peak if start_peak is None else F.greatest(F.lit(start_peak), peak))
    return out.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def _ordered(frame: DataFrame, column: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("ts", column)))
    return frame.where(F.col(column).isNotNull()).groupBy("instrument_id").agg(F.transform(pairs, lambda x: x[column]).alias("values"))


def exponential_level(bars: DataFrame, alpha: float, column: str = "close") -> DataFrame:
    """The last level of s = alpha x + (1 - alpha) s, from the first value on."""
    tail = F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0)))
    level = F.aggregate(tail, F.col("values")[0], lambda s, x: x * alpha + s * (1 - alpha))
    return _ordered(bars, column).select("instrument_id", level.alias("level"), F.size("values").cast("long").alias("n"))


def ewma_variance(bars: DataFrame, decay: float, column: str = "log_diff", floor: float = 1e-12) -> DataFrame:
    """Variance v = decay v + (1 - decay) r^2 over log returns, from the first square on."""
    tail = F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0)))
    v = F.aggregate(tail, F.col("values")[0] * F.col("values")[0], lambda s, r: s * decay + r * r * (1 - decay))
    return _ordered(bars, column).select("instrument_id", F.greatest(v, F.lit(floor)).alias("variance"))


def average_rank(column: str, by: Sequence[str]) -> Column:
    """Rank from 1; equal values share the mean of their places."""
    order = Window.partitionBy(*by).orderBy(column)
    ties = Window.partitionBy(*by, column)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def sliding_windows(bars: DataFrame, column: str, *, context: int, horizon: int, clip: float = 5.0, epsilon: float = 1e-5) -> DataFrame:
    """A row for each bar with a full context behind it and a full horizon ahead.

    `context_z` holds the context normalised by its own mean and deviation (ddof 0),
    and `target_z` the horizon by the same, so nothing of the future enters; both clipped.
    """
    back, ahead = by_time().rowsBetween(1 - context, 0), by_time().rowsBetween(1, horizon)
    rows = bars.select(
        "instrument_id", "ts", F.collect_list(column).over(back).alias("context"), F.collect_list(column).over(ahead).alias("target"),
        F.avg(column).over(back).alias("mean"), F.stddev_pop(column).over(back).alias("std"),
    ).where((F.size("context") == context) & (F.size("target") == horizon))

    def z(x: Column) -> Column:
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - F.col("mean")) / (F.col("std") + epsilon)))

    return rows.withColumns({"context_z": F.transform("context", z), "target_z": F.transform("target", z)})


def denormalised(z: Column, mean: Column, std: Column, epsilon: float = 1e-5) -> Column:
    return z * (std + epsilon) + mean


def shuffled_start(index: Column, epoch: int, largest: Column) -> Column:
    """A repeatable start position for a sample; the two factors are fixed values."""
    return F.pmod(index * 9973 + (epoch + 1) * 104729, largest + 1)


def market_trend(bars: DataFrame) -> DataFrame:
    """For each instrument's last bar: moving averages, trend strength (-10 to 10) and up flags."""
    order = by_time()
    last_first = Window.partitionBy("instrument_id").orderBy(F.desc("ts"))
    rows = bars.withColumns({f"ma{k}": rolling_mean("close", k) for k in (5, 10, 20)})
    rows = rows.withColumn("volume_ma5", rolling_mean("volume", 5))
    recent, before = order.rowsBetween(-4, 0), order.rowsBetween(-9, -5)
    rows = rows.withColumns({
        "ma_slope": F.try_divide(F.col("ma5"), F.lag("ma5", 9).over(order)) - 1,
        "price_slope": F.try_divide(F.col("close"), F.lag("close", 9).over(order)) - 1,
        "volume_ratio": F.try_divide(F.avg("volume").over(recent), F.avg("volume").over(before)) - 1,
        "rn": F.row_number().over(last_first),
    })
    raw = (F.coalesce("ma_slope", F.lit(0.0)) * 0.4 + F.coalesce("price_slope", F.lit(0.0)) * 0.4 + F.coalesce("volume_ratio", F.lit(0.0)) * 0.2) * 10
    rows = rows.where("rn = 1").withColumn("strength", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), raw)))
    up = (F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")) & (F.col("close") > F.col("ma20"))
    return rows.withColumn("is_up", F.coalesce(up, F.lit(False)))


def recent_slope(bars: DataFrame, n: int, bound: float = 0.1) -> DataFrame:
    """Slope of a line through the last n closes, over their range, within bounds."""
    last_first = Window.partitionBy("instrument_id").orderBy(F.desc("ts"))
    tail = bars.withColumn("rn", F.row_number().over(last_first)).where(F.col("rn") <= n)
    agg = tail.groupBy("instrument_id").agg((-F.regr_slope("close", "rn")).alias("slope"), (F.max("close") - F.min("close")).alias("spread"))
    held = F.greatest(F.lit(-bound), F.least(F.lit(bound), F.coalesce(F.try_divide("slope", "spread"), F.lit(0.0))))
    return agg.select("instrument_id", held.alias("trend"))
