"""Readers: strict CSV, header mapping, JSONP and text k-line payloads, named datasets, generators."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_ROWS = 64 << 20, 250_000
TIME_COLUMNS = ("timestamps", "timestamp", "date")
PRICES = ("open", "high", "low", "close")
#: Headers of vendor files and the canonical names they stand for; fixed values.
HEADERS = {
    "日期": "ts", "开盘": "open", "开盘价": "open", "最高": "high", "最高价": "high", "最低": "low", "最低价": "low",
    "收盘": "close", "收盘价": "close", "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "pct", "涨跌额": "diff", "换手率": "turnover",
}


def resolve(folder: str | Path, name: str, *, suffixes: Sequence[str] = (".csv",), limit: int = MAX_BYTES) -> Path:
    """A plain file of the folder by its bare name; separators, links that lead out and large files are refused."""
    if not name or name != Path(name).name or "\\" in name or name.startswith("."):
        raise ValueError("not a plain file name")
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if path.parent != root or path.suffix.lower() not in suffixes or not path.is_file():
        raise ValueError("no such data file")
    if path.stat().st_size > limit:
        raise ValueError("the file is too large")
    return path


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder: name, bytes and readable size, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    size = F.when(F.col("length") < 1024, F.concat(F.col("length"), F.lit(" B"))).when(
        F.col("length") < 1 << 20, F.format_string("%.1f KB", F.col("length") / 1024)
    ).otherwise(F.format_string("%.1f MB", F.col("length") / (1 << 20)))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", size.alias("size")).orderBy("name")


def parse_time(column: Column) -> Column:
    """A UTC time from ISO text or yyyy/M/d H:mm; null if neither."""
    return F.coalesce(F.try_to_timestamp(column), F.try_to_timestamp(column, F.lit("yyyy/M/d H:mm")), F.try_to_timestamp(column, F.lit("yyyy/M/d")))


def bars_from_text(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """Text columns of a CSV (with `row_no`) as typed bars, and the missing columns, if any."""
    times = [c for c in TIME_COLUMNS if c in raw.columns]
    missing = [] if len(times) == 1 else ["exactly one of timestamps, timestamp, date"]
    missing += [c for c in PRICES if c not in raw.columns]
    if missing:
        return raw, missing
    numbers = [*PRICES, *(c for c in ("volume", "amount") if c in raw.columns)]
    return raw.select("row_no", parse_time(F.col(times[0])).alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in numbers)), []


def first_problem(bars: DataFrame) -> str | None:
    """The first broken rule of a strict bar table, in fixed order, by one aggregation and one window."""
    from pyspark.sql import Window

    numbers = [c for c in (*PRICES, "volume", "amount") if c in bars.columns]
    before = F.lag("ts").over(Window.orderBy("row_no"))  # the reader admits no more than MAX_ROWS rows
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    any_bad = F.lit(False)
    for c in numbers:
        any_bad |= bad(c)
    rules = {
        "no rows": F.count("*") == 0,
        "too many rows": F.count("*") > MAX_ROWS,
        "unreadable timestamps": F.bool_or(F.col("ts").isNull()),
        "timestamps repeat": F.count_distinct("ts") < F.count("ts"),
        "timestamps do not rise": F.bool_or(F.col("ts") <= F.col("_before")),
        "unreadable or infinite numbers": F.bool_or(any_bad),
        "prices must be positive": F.bool_or(F.least(*PRICES) <= 0),
        "volume and amount must not be negative": F.bool_or(F.least(F.lit(0.0), *(c for c in numbers if c not in PRICES)) < 0) if len(numbers) > 4 else F.lit(False),
        "high is below open or close": F.bool_or(F.col("high") < F.greatest("open", "close")),
        "low is above open or close": F.bool_or(F.col("low") > F.least("open", "close")),
    }
    flags = F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()))
    return bars.withColumn("_before", before).agg(F.get(F.array_compact(flags), F.lit(0)).alias("p")).first()["p"]


def read_strict_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A checked CSV of bars in time order; ValueError tells the first problem."""
    path = resolve(folder, name)
    with path.open(encoding="utf-8-sig") as file:
        header = [h.strip() for h in file.readline().rstrip("\n").split(",")]
    if len(set(header)) != len(header) or not all(header):
        raise ValueError("columns must have distinct names")
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = spark.read.csv(f"file://{path}", schema=schema, header=True, encoding="UTF-8")
    raw = raw.withColumn("row_no", F.monotonically_increasing_id())
    bars, missing = bars_from_text(raw)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    if problem := first_problem(bars):
        raise ValueError(problem)
    return bars.drop("row_no").orderBy("ts")


def canonical_headers(frame: DataFrame, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    return frame.withColumnsRenamed({a: b for a, b in headers.items() if a in frame.columns})


_LINE = ("ts", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct", "diff", "turnover")


def jsonp_lines(payloads: DataFrame, text: str = "payload", *, path: str = "$.data.klines") -> DataFrame:
    """Rows of a JSONP answer whose lines are comma-separated text.

    A leading comment goes, the JSON stands between the first and the last bracket, and
    where it does not parse the lines are cut out of the text. Lines without a time and
    four prices are skipped; later fields that are missing are 0.
    """
    bare = F.regexp_replace(text, r"^\s*/\*.*?\*/", "")
    body = F.when(F.instr(bare, "(") > 0, F.regexp_extract(bare, r"(?s)\((.*)\)", 1)).otherwise(bare)
    parsed = F.from_json(F.get_json_object(body, path), "array<string>")
    by_hand = F.regexp_extract(F.col(text), r'"klines"\s*:\s*\[\s*"?(.*?)"?\s*\]', 1)
    lines = F.coalesce(parsed, F.when(by_hand != "", F.split(by_hand, r'"\s*,\s*"')))
    fields = F.split("line", ",")
    out = payloads.select("*", F.explode(lines).alias("line")).select(
        "*", F.try_to_timestamp(F.get(fields, F.lit(0))).alias("ts"),
        *((F.get(fields, F.lit(i)).try_cast("double") if i < 5 else F.coalesce(F.get(fields, F.lit(i)).try_cast("double"), F.lit(0.0))).alias(c) for i, c in enumerate(_LINE) if i),
    )
    return out.where(F.col("ts").isNotNull() & (F.size(F.split("line", ",")) >= 5)).dropna(subset=["open", "close", "high", "low"]).drop("line", text)


def market_of(code: Column) -> Column:
    """Market prefix by the first digit: 0, 2 and 3 are 0; all others 1."""
    return F.when(F.substring(code, 1, 1).isin("0", "2", "3"), "0").otherwise("1")


def first_available(spark: SparkSession, sources: Sequence[tuple[str, Callable[[], DataFrame]]], *, attempts: int = 3) -> DataFrame:
    """The first source that gives rows, tried several times, with data_source."""
    problems = []
    for name, read in sources:
        for _ in range(attempts):
            try:
                found = read()
                if not found.isEmpty():
                    return found.withColumn("data_source", F.lit(name))
                break
            except Exception as problem:  # noqa: BLE001 - the next source stands in
                problems.append(f"{name}: {problem}")
    raise LookupError("no source gave rows: " + "; ".join(problems))


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at a path, fetched and written there if it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        fetch().write.parquet(path)
    return spark.read.parquet(path)


def synthetic_bars(spark: SparkSession, rows: int, *, start: str = "2024-01-01 00:00:00", base: float = 100.0) -> DataFrame:
    """Hourly bars with a slow drift and a sine, the same at each run."""
    i = F.col("id")
    close = F.lit(base) + i * 0.02 + F.sin(i / 7.0)
    opened = F.lit(base) + (i - 1) * 0.02 + F.sin((i - 1) / 7.0)
    return spark.range(rows).select(
        F.lit("SYN").alias("instrument_id"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))).alias("ts"), opened.alias("open"),
        (F.greatest(opened, close) + 0.2).alias("high"), (F.least(opened, close) - 0.2).alias("low"), close.alias("close"),
        (F.lit(1000.0) + 50 * F.sin(i / 5.0)).alias("volume"), (close * (F.lit(1000.0) + 50 * F.sin(i / 5.0))).alias("amount"),
    )


def random_walk(spark: SparkSession, rows: int, *, seed: int = 42, drift: float = 0.0003, volatility: float = 0.02, base: float = 100.0, backwards: bool = False) -> DataFrame:
    """Business-day closes of a random walk held within 0.3 and 10 times the base; backwards, the last close is the base.

    Steps are hashed from seed and position, so partitions do not matter; the walk is a running sum.
    """
    from pyspark.sql import Window

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    steps = spark.range(rows).withColumn("r", F.lit(drift) + F.lit(volatility) * normal)
    order = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    walk = steps.withColumn("s", F.sum("r").over(order))
    total = F.sum("r").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    walk = walk.withColumn("s", F.col("s") - total) if backwards else walk
    close = F.greatest(F.lit(0.3 * base), F.least(F.lit(10 * base), base * F.exp("s")))
    day = F.date_add(F.lit("2015-01-05").cast("date"), (F.floor(F.col("id") / 5) * 7 + F.col("id") % 5).cast("int"))
    return walk.select(F.lit("WALK").alias("instrument_id"), day.cast("timestamp_ntz").alias("ts"), close.alias("close"))


class Settings:
    """Nested settings with dotted reads, updates and {name} references to top-level values."""

    def __init__(self, values: Mapping[str, object]):
        self.values = json.loads(json.dumps(values))

    def get(self, path: str, default: object = None) -> object:
        node: object = self.values
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return self._filled(node)

    def _filled(self, value: object) -> object:
        if isinstance(value, str):
            for k, v in self.values.items():
                value = value.replace("{" + k + "}", str(v)) if isinstance(v, str | int | float) else value
        return value

    def update(self, other: Mapping[str, object]) -> None:
        def merge(a: dict, b: Mapping) -> None:
            for k, v in b.items():
                if isinstance(v, Mapping) and isinstance(a.get(k), dict):
                    merge(a[k], v)
                else:
                    a[k] = v

        merge(self.values, other)


def load_pickle(path: str) -> None:
    raise ValueError("pickled frames run code when read; convert them to Parquet")
