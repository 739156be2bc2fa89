"""Baseline forecasters: a history of closes for each instrument to `horizon` steps ahead.

Each takes bars (instrument_id, ts, close) and gives (instrument_id, step, forecast).
Those with a closed form are expressions over one aggregation by instrument; the tree, the
autoregression and the simulated paths are grouped functions on one instrument's closes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _closes(bars: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "close")))
    return bars.groupBy("instrument_id").agg(F.transform(ordered, lambda x: x["close"]).alias("c")).withColumn("n", F.size("c"))


def _steps(per_instrument: DataFrame, horizon: int, forecast: Column) -> DataFrame:
    rows = per_instrument.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return rows.select("instrument_id", "step", forecast.alias("forecast"))



def last_value(bars: DataFrame, horizon: int) -> DataFrame:
    last = bars.groupBy("instrument_id").agg(F.max_by("close", "ts").alias("last"))
    return _steps(last, horizon, F.col("last"))


def drift(bars: DataFrame, horizon: int) -> DataFrame:
    ends = bars.groupBy("instrument_id").agg(F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"), F.count("*").alias("n"))
    slope = (F.log("last") - F.log("first")) / (F.col("n") - 1)
    return _steps(ends.where("n > 1"), horizon, F.col("last") * F.exp(F.col("step") * slope))


def seasonal_naive(bars: DataFrame, horizon: int, period: int = 5) -> DataFrame:
    rows = _closes(bars).where(F.col("n") >= period)
    return _steps(rows, horizon, F.element_at("c", F.col("n") - period + 1 + F.pmod(F.col("step") - 1, F.lit(period))))


def _tail(k: int) -> Column:
    return F.slice("c", F.col("n") - k + 1, F.lit(k))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def rolling_mean(bars: DataFrame, horizon: int, k: int = 10) -> DataFrame:
    return _steps(_closes(bars).where(F.col("n") >= k).withColumn("m", _mean(_tail(k))), horizon, F.col("m"))


def exponential_smoothing(bars: DataFrame, horizon: int, alpha: float = 0.3) -> DataFrame:
    level = F.aggregate(F.slice("c", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.col("c")[0], lambda s, x: x * alpha + s * (1 - alpha))
    return _steps(_closes(bars).withColumn("level", level), horizon, F.col("level"))


def momentum(bars: DataFrame, horizon: int, k: int = 5) -> DataFrame:
    rows = _closes(bars).where(F.col("n") > k)
    slope = (F.log(F.element_at("c", -1)) - F.log(F.element_at("c", -(k + 1)))) / k
    return _steps(rows, horizon, F.element_at("c", -1) * F.exp(F.col("step") * slope))


def mean_reversion(bars: DataFrame, horizon: int, k: int = 10, speed: float = 0.2) -> DataFrame:
    rows = _closes(bars).where(F.col("n") >= k).withColumn("m", _mean(_tail(k)))
    return _steps(rows, horizon, F.col("m") + (F.element_at("c", -1) - F.col("m")) * F.pow(F.lit(1 - speed), F.col("step")))


def linear_regression(bars: DataFrame, horizon: int, k: int = 20) -> DataFrame:
    rows = _closes(bars).where(F.col("n") >= k).select("instrument_id", F.posexplode(_tail(k)).alias("x", "c"))
    line = rows.groupBy("instrument_id").agg(F.regr_slope(F.log("c"), "x").alias("b"), F.regr_intercept(F.log("c"), "x").alias("a"))
    return _steps(line, horizon, F.exp(F.col("a") + F.col("b") * (k - 1 + F.col("step"))))


def historical_volatility(bars: DataFrame, log_return: str = "log_diff") -> DataFrame:
    return bars.groupBy("instrument_id").agg(F.stddev_samp(log_return).alias("volatility"))


Path = Callable[[np.ndarray, int], np.ndarray]


def _grouped(bars: DataFrame, horizon: int, path: Path, least: int) -> DataFrame:
    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        closes = frame.sort_values("ts")["close"].to_numpy(float)
        if len(closes) < least:
            return pd.DataFrame({"instrument_id": [], "step": [], "forecast": []})
        return pd.DataFrame({"instrument_id": key[0], "step": np.arange(1, horizon + 1), "forecast": path(closes, horizon)})

    kind = bars.schema["instrument_id"].dataType.simpleString()
    return bars.select("instrument_id", "ts", "close").groupBy("instrument_id").applyInPandas(one, f"instrument_id {kind}, step int, forecast double")


def _features(c: np.ndarray) -> np.ndarray:
    """Of each position from 20 on: last log return, mean and deviation of five, gap to the mean of 20."""
    r = np.diff(np.log(c))
    at = np.arange(20, len(c) + 1)
    last5 = np.stack([r[at - 2 - k] for k in range(5)])
    means = np.array([c[t - 20 : t].mean() for t in at])
    return np.column_stack([r[at - 2], last5.mean(axis=0), last5.std(axis=0), c[at - 1] / means - 1])


def _best_split(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[float, int, float] | None:
    """Smallest squared loss over evenly spread thresholds; the first feature and threshold among equals."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mids = (values[1:] + values[:-1]) / 2
        for t in mids[np.unique(np.linspace(0, len(mids) - 1, 32).round().astype(int))] if len(mids) else ():
            left = x[:, f] <= t
            if leaf <= left.sum() <= len(y) - leaf:
                loss = sum(((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left))
                if best is None or loss < best[0] - 1e-15:
                    best = loss, f, t
    return best


def _grow(x: np.ndarray, y: np.ndarray, depth: int, leaf: int):
    found = _best_split(x, y, leaf) if depth else None
    if found is None:
        return float(y.mean())
    _, f, t = found
    left = x[:, f] <= t
    return f, t, _grow(x[left], y[left], depth - 1, leaf), _grow(x[~left], y[~left], depth - 1, leaf)


def tree(bars: DataFrame, horizon: int, leaf: int = 2) -> DataFrame:
    """A regression tree of depth two on the next log return, rolled forward step by step."""

    def path(c: np.ndarray, steps: int) -> np.ndarray:
        x = _features(c)
        model = _grow(x[:-1], np.diff(np.log(c))[19:], 2, leaf)
        out = list(c)
        for _ in range(steps):
            row, node = _features(np.array(out[-21:]))[-1], model
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            out.append(out[-1] * np.exp(node))
        return np.array(out[-steps:])

    return _grouped(bars, horizon, path, 25)


def autoregression(bars: DataFrame, horizon: int, order: int = 3, ridge: float = 1e-6) -> DataFrame:
    """Ridge regression of log returns on the last ones, the constant free; steps stay within the seen range."""

    def path(c: np.ndarray, steps: int) -> np.ndarray:
        r = np.diff(np.log(c))
        x = np.column_stack([np.ones(len(r) - order), *(r[order - 1 - k : len(r) - 1 - k] for k in range(order))])
        keep = np.eye(order + 1) * ridge
        keep[0, 0] = 0
        beta = np.linalg.solve(x.T @ x + keep, x.T @ r[order:])
        past, out, level = list(r[-order:]), [], c[-1]
        for _ in range(steps):
            new = float(np.clip(beta[0] + sum(beta[1 + k] * past[-1 - k] for k in range(order)), r.min(), r.max()))
            past.append(new)
            out.append(level := level * np.exp(new))
        return np.array(out)

    return _grouped(bars, horizon, path, order + 6)


def simulated(bars: DataFrame, horizon: int, samples: int = 50, decay: float = 0.94, seed: int = 123) -> DataFrame:
    """Mean of seeded lognormal paths with the exponentially weighted variance of log returns."""
    if samples * horizon > 5_000_000:
        raise ValueError("at most 5,000,000 generated values")

    def path(c: np.ndarray, steps: int) -> np.ndarray:
        r = np.diff(np.log(c))
        v = r[0] ** 2
        for x in r[1:]:
            v = decay * v + (1 - decay) * x * x
        v = max(v, np.finfo(float).tiny)
        z = np.random.default_rng(seed).standard_normal((samples, steps))
        return (c[-1] * np.exp(np.cumsum(-v / 2 + np.sqrt(v) * z, axis=1))).mean(axis=0)

    return _grouped(bars, horizon, path, 3)


#: name -> function; own forecasters can be added. A suite runs all of them or fails.
REGISTRY: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "last_value": last_value, "drift": drift, "seasonal_naive": seasonal_naive, "rolling_mean": rolling_mean,
    "exponential_smoothing": exponential_smoothing, "momentum": momentum, "mean_reversion": mean_reversion,
    "linear_regression": linear_regression, "tree": tree, "autoregression": autoregression, "simulated": simulated,
}


def suite(bars: DataFrame, horizon: int) -> DataFrame:
    """All registered forecasters in one frame with model_name."""
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    out = None
    for name, fn in REGISTRY.items():
        one = fn(bars, horizon).withColumn("model_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
