"""Signals, position backtests and their performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_time


def threshold_signal(rows: DataFrame, threshold: float, *, forecast_return: str = "forecast_return") -> DataFrame:
    """signal 1, -1 or 0 by a return threshold; position carries the last signal that is not 0."""
    value = F.col(forecast_return)
    signal = F.when(value > threshold, 1).when(value < -threshold, -1).otherwise(0)
    out = rows.withColumn("signal", signal)
    held = F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("position", F.coalesce(held, F.lit(0)))


def run_positions(rows: DataFrame, *, capital: float = 100_000.0, long_only: bool = True) -> DataFrame:
    """All-in whole-share trading by `signal` at `close`, one fold over each instrument's ordered array.

    A buy spends what whole shares allow, a sale returns shares times price, and cash is
    never lost. Gives (instrument_id, ts, close, action, shares, cash, equity).
    """
    ordered = rows.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ts", "close", "signal"))).alias("s"))

    def step(state: Column, x: Column) -> Column:
        price, shares, cash = x["close"], state["shares"], state["cash"]
        buys = (x["signal"] > 0) & (shares <= 0)
        sells = (x["signal"] < 0) & (shares > 0) if long_only else (x["signal"] < 0) & (shares >= 0)
        worth = cash + shares * price
        after = F.when(buys, F.floor(worth / price)).when(sells, F.lit(0) if long_only else -F.floor(worth / price)).otherwise(shares).cast("long")
        left = F.when(buys | sells, worth - after * price).otherwise(cash)
        row = F.struct(
            x["ts"].alias("ts"), price.alias("close"), F.when(buys, "BUY").when(sells, "SELL").otherwise("HOLD").alias("action"),
            after.alias("shares"), left.alias("cash"), (left + after * price).alias("equity"),
        )
        return F.struct(after.alias("shares"), left.alias("cash"), F.concat(state["rows"], F.array(row)).alias("rows"))

    kind = rows.schema["ts"].dataType.simpleString()
    none = F.array().cast(f"array<struct<ts:{kind},close:double,action:string,shares:bigint,cash:double,equity:double>>")
    start = F.struct(F.lit(0).cast("long").alias("shares"), F.lit(capital).alias("cash"), none.alias("rows"))
    return ordered.select("instrument_id", F.inline(F.aggregate("s", start, step, lambda z: z["rows"])))


def round_trips(trades: DataFrame) -> DataFrame:
    """The k-th buy with the k-th sale of an instrument, and the return between them."""
    order = Window.partitionBy("instrument_id", "action").orderBy("ts")
    rows = trades.where(F.col("action").isin("BUY", "SELL")).withColumn("k", F.row_number().over(order))
    buys = rows.where("action = 'BUY'").select("instrument_id", "k", F.col("ts").alias("bought"), F.col("close").alias("paid"))
    sales = rows.where("action = 'SELL'").select("instrument_id", "k", F.col("ts").alias("sold"), F.col("close").alias("got"))
    return buys.join(sales, ["instrument_id", "k"]).withColumn("trade_return", F.col("got") / F.col("paid") - 1)


def performance(equity: DataFrame, *, per_year: int = 252, risk_free: float = 0.03, value: str = "equity") -> DataFrame:
    """Total and yearly return, volatility, Sharpe ratio, largest drawdown from the first value on, buy and hold, excess."""
    order = by_time()
    rows = equity.withColumn("r", F.col(value) / F.lag(value).over(order) - 1)
    rows = rows.withColumn("dd", F.col(value) / F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    total = F.max_by(value, "ts") / F.min_by(value, "ts") - 1
    hold = F.max_by("close", "ts") / F.min_by("close", "ts") - 1
    yearly = F.pow(1 + total, F.lit(float(per_year)) / F.count("*")) - 1
    vol = F.stddev_samp("r") * F.sqrt(F.lit(float(per_year)))
    return rows.groupBy("instrument_id").agg(
        total.alias("total_return"), yearly.alias("annual_return"), vol.alias("volatility"), F.try_divide(yearly - risk_free, vol).alias("sharpe"),
        F.min("dd").alias("max_drawdown"), hold.alias("buy_and_hold"), (total - hold).alias("excess"),
    )


def accuracy(rows: DataFrame, *, actual: str = "actual_value", forecast: str = "point_forecast") -> DataFrame:
    """MAPE, share within 5 percent, agreement in direction and correlation, for each instrument."""
    order = by_time()
    error = F.abs(F.col(forecast) - F.col(actual)) / F.abs(F.col(actual))
    both = F.signum(F.col(actual) - F.lag(actual).over(order)) == F.signum(F.col(forecast) - F.lag(forecast).over(order))
    out = rows.withColumns({"_e": error, "_same": both})
    return out.groupBy("instrument_id").agg(
        (F.avg("_e") * 100).alias("mape"), F.avg((F.col("_e") < 0.05).cast("double")).alias("within_5pct"), F.avg(F.col("_same").cast("double")).alias("direction"),
        F.try_divide(F.covar_pop(actual, forecast), F.stddev_pop(actual) * F.stddev_pop(forecast)).alias("correlation"),
    )


def top_k_with_hold(scores: DataFrame, *, k: int, drop: int, hold: int) -> DataFrame:
    """Daily top-k portfolio that replaces at most `drop` names a day and keeps each for at least `hold` days.

    Scores: portfolio, ts, instrument_id, score. The state runs over the days of a portfolio, so its
    names are one group; portfolios run side by side.
    """
    import pandas as pd

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for day, rows in frame.sort_values(["ts", "score", "instrument_id"], ascending=[True, False, True]).groupby("ts", sort=True):
            ranked = rows["instrument_id"].tolist()
            place = {x: i for i, x in enumerate(ranked)}
            free = [x for x, age in held.items() if age >= hold]
            worst = sorted(free, key=lambda x: -place.get(x, len(ranked)))[:drop]
            leave = [x for x in worst if place.get(x, len(ranked)) >= k]
            for x in leave:
                del held[x]
            for x in ranked:
                if len(held) >= k:
                    break
                held.setdefault(x, 0)
            held = {x: age + 1 for x, age in held.items()}
            out += [(day, x, 1.0 / len(held)) for x in sorted(held)]
        return pd.DataFrame([(key[0], *row) for row in out], columns=["portfolio", "ts", "instrument_id", "weight"])

    kind = scores.schema["ts"].dataType.simpleString()
    rows = scores.select("portfolio", "ts", "instrument_id", "score")
    return rows.groupBy("portfolio").applyInPandas(one, f"portfolio string, ts {kind}, instrument_id string, weight double")
