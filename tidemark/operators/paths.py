"""Generated candle paths, their checks and summaries; tokens and sampling filters.

Paths: series, sample, step, open, high, low, close, volume, amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "amount")


def _infinite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def issues(paths: DataFrame) -> DataFrame:
    """(series, sample, step, field, code) for each bad cell; of a row with a non-finite cell only those are told."""
    infinite = [F.when(_infinite(c), F.struct(F.lit(c).alias("field"), F.lit("non_finite").alias("code"))) for c in FIELDS]
    broken = F.lit(False)
    for c in FIELDS:
        broken |= _infinite(c)
    body_high, body_low = F.greatest("open", "close"), F.least("open", "close")

    def when(test: Column, field: str, code: str) -> Column:
        return F.when(~broken & test, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))

    rules = [when(F.col(c) <= 0, c, "non_positive") for c in PRICES]
    rules += [when(F.col("high") < body_high, "high", "high_below_body"), when(F.col("low") > body_low, "low", "low_above_body")]
    rules += [when(F.col(c) < 0, c, "negative") for c in ("volume", "amount")]
    found = F.explode(F.array_compact(F.array(*infinite, *rules))).alias("i")
    return paths.select("series", "sample", "step", found).select("series", "sample", "step", "i.*")


def projected(paths: DataFrame) -> DataFrame:
    """Highs and lows widened to the body, volumes floored at 0; rows with a non-finite cell stay.

    `repairs` lists the changed fields with the value before and after.
    """
    broken = F.lit(False)
    for c in FIELDS:
        broken |= _infinite(c)
    new = {
        "high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"),
        "volume": F.greatest(F.col("volume"), F.lit(0.0)), "amount": F.greatest(F.col("amount"), F.lit(0.0)),
    }
    fixed = {c: F.when(broken, F.col(c)).otherwise(v) for c, v in new.items()}
    repairs = F.array_compact(F.array(*(F.when(F.col(c) != v, F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), v.alias("after"))) for c, v in fixed.items())))
    return paths.select("series", "sample", "step", "open", fixed["high"].alias("high"), fixed["low"].alias("low"), "close", fixed["volume"].alias("volume"), fixed["amount"].alias("amount"), repairs.alias("repairs"))


def valid_paths(paths: DataFrame) -> DataFrame:
    """Paths (series, sample) without any issue, found by one anti-join."""
    bad = issues(paths).select("series", "sample").distinct()
    return paths.join(bad, ["series", "sample"], "left_anti")


def summary(paths: DataFrame, last_close: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), tail: float = 0.05) -> DataFrame:
    """For each series and step: mean, median and quantiles of closes, P(return > 0) and the low return quantile."""
    rows = paths.join(last_close, "series").withColumn("r", F.col("close") / F.col("last_close") - 1)
    return rows.groupBy("series", "step").agg(
        F.count("*").alias("paths"), F.avg("close").alias("mean"), F.median("close").alias("median"),
        *(F.percentile("close", q).alias(f"q{round(q * 100):02d}") for q in quantiles),
        F.avg((F.col("r") > 0).cast("double")).alias("p_up"), F.percentile("r", tail).alias("tail_return"),
    )


def signals(paths: DataFrame, last_close: DataFrame) -> DataFrame:
    """Of the mean path of each series: last, mean, highest and lowest close less the last known close."""
    mean_path = paths.groupBy("series", "step").agg(F.avg("close").alias("close"))
    agg = mean_path.groupBy("series").agg(F.max_by("close", "step").alias("last"), F.avg("close").alias("mean"), F.max("close").alias("max"), F.min("close").alias("min"))
    return agg.join(last_close, "series").select("series", *((F.col(c) - F.col("last_close")).alias(f"signal_{c}") for c in ("last", "mean", "max", "min")))


def pivoted(frame: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    return frame.groupBy(row).pivot(column, names).agg(F.first(value))


# Binary tokens.


def sign_bits(values: Column) -> Column:
    """1 for a positive and 0 for any other component."""
    return F.transform(values, lambda x: F.when(x > 0, 1).otherwise(0))


def pack(bits: Column, *, most_first: bool = False) -> Column:
    """Bits to a whole number; the first bit is the least one, or the most one."""
    ordered = F.reverse(bits) if most_first else bits
    weighted = F.transform(ordered, lambda b, i: b.cast("long") * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda s, x: s + x)


def unpack(number: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.getbit(number, i).cast("int"))


def split_token(token: Column, fine_bits: int) -> tuple[Column, Column]:
    """Coarse and fine part of a composite token."""
    return F.shiftright(token, fine_bits), token.bitwiseAND((1 << fine_bits) - 1)


def merge_token(coarse: Column, fine: Column, fine_bits: int) -> Column:
    return F.shiftleft(coarse, fine_bits) + fine


def quantised(values: Column) -> Column:
    """Unit-length signs: plus or minus 1 / sqrt(size)."""
    return F.transform(values, lambda x: F.when(x > 0, 1.0).otherwise(-1.0) / F.sqrt(F.size(values)))


def code_entropy(tokens: DataFrame, column: str, size: int, epsilon: float = 1e-9) -> DataFrame:
    """Entropy in nats of the code histogram over all `size` codes, and how many occur."""
    counts = tokens.groupBy(F.col(column).cast("long").alias("code")).agg(F.count("*").alias("n"))
    grid = tokens.sparkSession.range(size).withColumnRenamed("id", "code").join(counts, "code", "left")
    n = F.coalesce(F.col("n").cast("double"), F.lit(0.0)) + epsilon
    total = grid.agg(F.sum(n).alias("total"))
    p = n / F.col("total")
    return grid.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"), F.count("n").alias("used"))  # total is one row


# Sampling filters over (row_id, token, logit).


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    row = Window.partitionBy("row_id")
    scaled = logits.withColumn("_l", F.col("logit") / temperature)
    e = F.exp(F.col("_l") - F.max("_l").over(row))
    return scaled.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(row)).drop("_l", "_e")


def top_k_top_p(logits: DataFrame, *, k: int, p: float) -> DataFrame:
    """Tokens at least as likely as the k-th, of these the smallest most likely part that reaches p; renormalised."""
    row = Window.partitionBy("row_id")
    kept = logits.withColumn("_r", F.rank().over(row.orderBy(F.desc("logit")))).where(F.col("_r") <= k).drop("_r")
    soft = softmax(kept)
    before = F.sum("p").over(row.orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1))
    out = soft.withColumn("_before", F.coalesce(before, F.lit(0.0))).where(F.col("_before") < p).drop("_before")
    return out.withColumn("p", F.col("p") / F.sum("p").over(row))


def greedy(logits: DataFrame) -> DataFrame:
    return logits.groupBy("row_id").agg(F.max_by("token", F.struct(F.col("logit"), -F.col("token"))).alias("token"))


def sampled(probabilities: DataFrame, seed: int) -> DataFrame:
    """One token for each row by the inverse distribution; the draw depends on seed and row_id only."""
    row = Window.partitionBy("row_id").orderBy("token")
    draw = F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    rows = probabilities.withColumn("_c", F.sum("p").over(row)).withColumn("_u", draw)
    found = rows.groupBy("row_id").agg(F.min(F.when(F.col("_c") > F.col("_u"), F.col("token"))).alias("a"), F.max("token").alias("b"))
    return found.select("row_id", F.coalesce("a", "b").alias("token"))
