"""Bar validation: a catalogue of rules, violations in long form, and the issue report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

ERROR, WARNING = "error", "warning"
#: The canonical columns of a bar table, after row_no, the physical order of the rows.
BAR_SCHEMA = StructType(
    [StructField("row_no", LongType())]
    + [StructField("instrument_id", StringType()), StructField("timestamp_utc", TimestampType())]
    + [StructField(c, StringType()) for c in ("exchange", "currency", "frequency")]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "adjustment_factor")]
    + [StructField("is_adjusted", BooleanType()), StructField("source", StringType()), StructField("ingested_at", TimestampType())]
)
TEXTS = ("instrument_id", "exchange", "currency", "frequency", "source")
PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume", "amount", "adjustment_factor")
FREQUENCIES = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "1D": 86400}


@dataclass(frozen=True)
class Calendar:
    """Session times of an exchange in its zone, in seconds of the day; both ends belong to it."""

    zone: str
    opens: int
    closes: int
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)
    holidays: tuple[str, ...] = ()
    authoritative: bool = False


CALENDARS: dict[str, Calendar] = {
    "XASX": Calendar("Australia/Sydney", 36000, 57600),
    "XNYS": Calendar("America/New_York", 34200, 57600),
    "XNAS": Calendar("America/New_York", 34200, 57600),
}


@dataclass(frozen=True)
class Config:
    """adjustment: raw, adjusted or declared. stale_after in seconds, as_of a UTC timestamp text."""

    adjustment: str = "declared"
    as_of: str | None = None
    stale_after: int | None = None
    max_gap_multiple: float = 3.0
    require_verified_holidays: bool = False

    def __post_init__(self) -> None:
        if self.adjustment not in ("raw", "adjusted", "declared"):
            raise ValueError("adjustment must be raw, adjusted or declared")


def finite(column: Column) -> Column:
    """NaN and infinities as null, so that comparisons with them are no true statements."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def missing_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in BAR_SCHEMA if f.name not in frame.columns]


def row_rules() -> dict[str, Column]:
    """Rules that a row breaks on its own, by code; all on raw columns."""
    body_high, body_low = F.greatest(*(finite(F.col(c)) for c in ("open", "close"))), F.least(*(finite(F.col(c)) for c in ("open", "close")))
    rules = {f"blank_{c}": F.col(c).isNull() | (F.trim(c) == "") for c in TEXTS}
    rules |= {f"missing_{c}": F.col(c).isNull() for c in ("timestamp_utc", "ingested_at")}
    rules["ingested_before_event"] = F.col("ingested_at") < F.col("timestamp_utc")
    rules |= {f"non_finite_{c}": finite(F.col(c)).isNull() for c in NUMBERS}
    rules["non_positive_price"] = F.least(*(finite(F.col(c)) for c in PRICES)) <= 0
    rules["high_below_body"] = finite(F.col("high")) < body_high
    rules["low_above_body"] = finite(F.col("low")) > body_low
    rules |= {f"negative_{c}": finite(F.col(c)) < 0 for c in ("volume", "amount")}
    rules["non_positive_adjustment_factor"] = finite(F.col("adjustment_factor")) <= 0
    rules["missing_adjusted_flag"] = F.col("is_adjusted").isNull()
    return rules


def group_rules(config: Config) -> dict[str, Column]:
    """Rules over the rows of one instrument or key."""
    key = Window.partitionBy("instrument_id", "timestamp_utc")
    instrument = Window.partitionBy("instrument_id")
    rules = {"duplicate_key": F.count("*").over(key) > 1}
    rules["unordered_timestamps"] = F.max(F.coalesce(F.col("_backwards"), F.lit(False))).over(instrument) & ~F.max(F.col("timestamp_utc").isNull()).over(instrument)
    for c in ("exchange", "currency", "frequency"):
        rules[f"inconsistent_{c}"] = F.min(c).over(instrument) != F.max(c).over(instrument)
    if config.adjustment == "declared":
        rules["mixed_adjustment"] = F.min("is_adjusted").over(instrument) != F.max("is_adjusted").over(instrument)
    else:
        rules["unexpected_adjustment"] = F.col("is_adjusted") != F.lit(config.adjustment == "adjusted")
    known = F.create_map(*(F.lit(x) for pair in FREQUENCIES.items() for x in pair))
    rules["unsupported_frequency"] = F.col("frequency").isNotNull() & F.try_element_at(known, F.col("frequency")).isNull()
    return rules


def _is_session(calendar: Calendar) -> Callable[[Column], Column]:
    def test(day: Column) -> Column:
        on = F.weekday(day).isin(*calendar.weekdays)
        return on & ~day.cast("string").isin(*calendar.holidays) if calendar.holidays else on

    return test


def calendar_rules(calendars: Mapping[str, Calendar], config: Config) -> dict[str, Column]:
    """Unknown exchanges, bars outside sessions, and gaps against the bar before."""
    exchange = F.col("exchange")
    unknown = exchange.isNotNull() & ~exchange.isin(*calendars)
    outside, daily_gap = F.lit(False), F.lit(None).cast("double")
    seconds = F.try_element_at(F.create_map(*(F.lit(x) for pair in FREQUENCIES.items() for x in pair)), F.col("frequency"))
    before = F.lag("timestamp_utc").over(Window.partitionBy("instrument_id").orderBy("timestamp_utc"))
    intraday_gap, misfit = F.lit(None).cast("double"), F.lit(False)
    for name, c in calendars.items():
        local, local_before = (F.from_utc_timestamp(t, c.zone) for t in (F.col("timestamp_utc"), before))
        day, day_before = F.to_date(local), F.to_date(local_before)
        clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
        session = _is_session(c)(day)
        inside = F.when(seconds >= 86400, session).otherwise(session & clock.between(c.opens, c.closes))
        outside = F.when(exchange == name, ~inside).otherwise(outside)
        missing = F.when(F.datediff(day, day_before) > 1, F.size(F.filter(F.sequence(F.date_add(day_before, 1), F.date_sub(day, 1)), _is_session(c)))).otherwise(0).cast("double")
        daily_gap = F.when((exchange == name) & (seconds >= 86400), missing).otherwise(daily_gap)
        ratio = (F.unix_micros(F.col("timestamp_utc").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6 / seconds
        same_day = (exchange == name) & (seconds < 86400) & (day == day_before)
        intraday_gap = F.when(same_day, ratio - 1).otherwise(intraday_gap)
        misfit = F.when(same_day, ratio != F.floor(ratio)).otherwise(misfit)
    gap = F.coalesce(daily_gap, F.when(~misfit, intraday_gap))
    return {
        "unknown_exchange": unknown, "outside_session": outside, "off_grid_interval": misfit,
        "missing_bars": gap > 0, "gap_too_long": gap > config.max_gap_multiple,
    }


def staleness_rules(config: Config) -> dict[str, Column]:
    if config.as_of is None:
        return {}
    as_of = F.lit(config.as_of).cast("timestamp")
    rules = {"ingested_in_future": F.col("ingested_at") > as_of}
    if config.stale_after is not None:
        rules["stale_bar"] = F.col("timestamp_utc") < as_of - F.make_dt_interval(secs=F.lit(config.stale_after).cast("decimal(18,6)"))
    return rules


WARNINGS = ("missing_bars",)


def violations(bars: DataFrame, config: Config = Config(), calendars: Mapping[str, Calendar] = CALENDARS) -> DataFrame:
    """(code, severity, row_no, instrument_id): a row for each broken rule.

    All rules of rows, keys and instruments are flags of one projection over windows by
    instrument; the flags are exploded once.
    """
    order = Window.partitionBy("instrument_id").orderBy("row_no")
    marked = bars.select(*BAR_SCHEMA.fieldNames()).withColumn("_backwards", F.col("timestamp_utc") < F.lag("timestamp_utc").over(order))
    rules = row_rules() | group_rules(config) | calendar_rules(calendars, config) | staleness_rules(config)
    flags = F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()))
    rows = marked.withColumn("_flags", flags).select("row_no", "instrument_id", F.explode(F.array_compact("_flags")).alias("code"))
    severity = F.when(F.col("code").isin(*WARNINGS), WARNING).otherwise(ERROR)
    return rows.select("code", severity.alias("severity"), "row_no", "instrument_id")


def issue_report(found: DataFrame, *, rows: int = 20, instruments: int = 20) -> DataFrame:
    """For each code: how many, the first rows and the first instruments in order.

    The row lists are cut by a ranking that keeps its first places only, so no
    task collects all rows of a code.
    """
    counts = found.groupBy("code", "severity").agg(F.count("*").alias("n"))
    by_row = found.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy("row_no"))).where(F.col("_k") <= rows)
    by_row = by_row.groupBy("code").agg(F.array_sort(F.collect_list("row_no")).alias("rows"))
    names = found.select("code", "instrument_id").distinct().where("instrument_id IS NOT NULL")
    names = names.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy("instrument_id"))).where(F.col("_k") <= instruments)
    names = names.groupBy("code").agg(F.array_sort(F.collect_list("instrument_id")).alias("instruments"))
    out = counts.join(by_row, "code").join(names, "code", "left")
    return out.withColumn("instruments", F.coalesce("instruments", F.array().cast("array<string>")))


def standing_warnings(bars: DataFrame, config: Config, calendars: Mapping[str, Calendar] = CALENDARS) -> list[tuple[str, str]]:
    """Codes that concern the whole table: what could not be verified."""
    out = [] if config.stale_after is not None and config.as_of is not None else [("staleness_not_evaluated", WARNING)]
    exchanges = {r[0] for r in bars.where(F.col("exchange").isin(*calendars)).select("exchange").distinct().collect()}
    if any(e in calendars and not calendars[e].authoritative for e in exchanges):
        out.append(("calendar_holidays_unverified", ERROR if config.require_verified_holidays else WARNING))
    if config.adjustment != "raw":
        out.append(("corporate_action_causality_unverified", WARNING))
    return out


def passes(found: DataFrame) -> bool:
    return found.where(F.col("severity") == ERROR).isEmpty()


def totals(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count("*").alias("rows"), F.count_distinct("instrument_id").alias("instruments"), F.min("timestamp_utc").alias("start"), F.max("timestamp_utc").alias("end")
    )
