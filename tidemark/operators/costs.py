"""Paper trading: trade, period and sector ledgers and economic metrics.

Decisions: decision_ts, realization_ts, instrument_id, target_weight, realized_return,
dollar_volume, sector.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Assumptions:
    """Costs in basis points of the traded value; impact grows with participation to a power."""

    name: str = "base"
    notional: float = 1_000_000.0
    commission_bps: float = 1.0
    half_spread_bps: float = 2.0
    slippage_bps: float = 1.0
    impact_bps: float = 10.0
    impact_exponent: float = 0.5
    participation_cap: float = 0.1

    def __post_init__(self) -> None:
        if self.notional <= 0 or not 0 < self.participation_cap <= 1:
            raise ValueError("notional must be positive and the cap in (0, 1]")
        if min(self.commission_bps, self.half_spread_bps, self.slippage_bps, self.impact_bps, self.impact_exponent) < 0:
            raise ValueError("costs must not be negative")


COSTS = ("commission", "half_spread", "slippage", "impact")


def scenarios(spark, items: list[Assumptions]) -> DataFrame:
    """Assumption sets as a table, one row each; names must differ."""
    if len({a.name for a in items}) != len(items):
        raise ValueError("scenario names must differ")
    return spark.createDataFrame([{k: v if k == "name" else float(v) for k, v in asdict(a).items()} for a in items])


def trade_ledger(decisions: DataFrame, assumptions: DataFrame, *, enforce_cap: bool = True) -> DataFrame:
    """Each decision under each scenario with its trade, participation and costs.

    One window by scenario and instrument gives the weight before, 0 at the start. A trade
    above the participation cap fails the query, unless enforce_cap is false.
    """
    rows = decisions.crossJoin(F.broadcast(assumptions))  # scenarios are driver values, a few rows
    order = Window.partitionBy("name", "instrument_id").orderBy("realization_ts")
    rows = rows.withColumn("delta", F.col("target_weight") - F.lag("target_weight", 1, 0.0).over(order))
    traded = F.abs("delta")
    rows = rows.withColumn("traded", traded).withColumn("participation", F.coalesce(F.try_divide(F.col("traded") * F.col("notional"), "dollar_volume"), F.lit(0.0)))
    if enforce_cap:
        over = F.col("participation") > F.col("participation_cap") + 1e-15
        rows = rows.withColumn("participation", F.when(over, F.raise_error(F.lit("a trade is above the participation cap")).cast("double")).otherwise(F.col("participation")))
    bps = F.col("traded") / 10_000
    return rows.withColumns({
        "commission": bps * F.col("commission_bps"), "half_spread": bps * F.col("half_spread_bps"), "slippage": bps * F.col("slippage_bps"),
        "impact": bps * F.col("impact_bps") * F.pow("participation", "impact_exponent"), "gross": F.col("target_weight") * F.col("realized_return"),
    })


def period_ledger(trades: DataFrame) -> DataFrame:
    weight = F.col("target_weight")
    total = sum((F.sum(c) for c in COSTS), F.lit(0.0))
    return trades.groupBy("name", "realization_ts").agg(
        F.sum("gross").alias("gross_return"), *(F.sum(c).alias(c) for c in COSTS), (F.sum("gross") - total).alias("net_return"),
        F.sum("traded").alias("turnover"), F.sum(F.abs(weight)).alias("gross_exposure"), F.sum(weight).alias("net_exposure"),
        F.max(F.abs(weight)).alias("max_position"), F.sum(weight * weight).alias("concentration"), F.min("dollar_volume").alias("min_dollar_volume"),
        F.max("participation").alias("max_participation"),
    )


def sector_ledger(trades: DataFrame) -> DataFrame:
    return trades.groupBy("name", "realization_ts", "sector").agg(F.sum("target_weight").alias("net_exposure"), F.sum(F.abs("target_weight")).alias("gross_exposure"))


def economic_metrics(periods: DataFrame, *, per_year: int = 252) -> DataFrame:
    """One row for each scenario: compounded returns, turnover, costs, drawdown, volatility, Sharpe-like ratio."""
    order = Window.partitionBy("name").orderBy("realization_ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = periods.withColumn("_wealth", F.exp(F.sum(F.log1p("net_return")).over(order)))
    rows = rows.withColumn("_drawdown", F.col("_wealth") / F.greatest(F.lit(1.0), F.max("_wealth").over(order)) - 1)
    vol = F.stddev_samp("net_return") * F.sqrt(F.lit(float(per_year)))
    return rows.groupBy("name").agg(
        F.count("*").alias("periods"), (F.exp(F.sum(F.log1p("gross_return"))) - 1).alias("gross_total"), (F.exp(F.sum(F.log1p("net_return"))) - 1).alias("net_total"),
        F.sum("turnover").alias("turnover"), F.avg("turnover").alias("mean_turnover"), *(F.sum(c).alias(c) for c in COSTS),
        F.min("_drawdown").alias("max_drawdown"), vol.alias("volatility"), F.try_divide(F.avg("net_return") * per_year, vol).alias("sharpe"),
        F.max("gross_exposure").alias("max_gross_exposure"), F.max("max_participation").alias("max_participation"),
    )


def contract(decisions: DataFrame) -> DataFrame:
    """One row: which parts of the contract are broken anywhere."""
    checks: dict[str, Column] = {
        "blank_instrument": F.col("instrument_id").isNull(), "weight_missing": F.col("target_weight").isNull(), "return_below_minus_one": F.col("realized_return") <= -1,
        "dollar_volume_not_positive": F.col("dollar_volume") <= 0, "realized_before_decided": F.col("realization_ts") <= F.col("decision_ts"),
    }
    flags = decisions.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in checks.items()))
    doubled = decisions.groupBy("realization_ts", "instrument_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("duplicate_key"))
    per_period = decisions.groupBy("realization_ts").agg(F.count_distinct("instrument_id").alias("n"), F.sum(F.xxhash64("instrument_id") % 1_000_003).alias("h"))
    same = per_period.agg((F.count_distinct("n", "h") > 1).alias("universe_changes"))
    return flags.crossJoin(doubled).crossJoin(same)
