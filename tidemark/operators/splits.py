"""Time splits and walk-forward plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_ranges(ts: Column, ranges: Sequence[tuple[str, str, str]]) -> Column:
    """The name of the closed range (name, start, end) that a time lies in; ranges must not overlap."""
    ordered = sorted(ranges, key=lambda r: r[1])
    if any(a[2] >= b[1] for a, b in zip(ordered, ordered[1:], strict=False)):
        raise ValueError("ranges overlap")
    out = F.lit(None).cast("string")
    for name, start, end in ranges:
        out = F.when((ts >= F.lit(start).cast("timestamp_ntz")) & (ts <= F.lit(end).cast("timestamp_ntz")), name).otherwise(out)
    return out


def by_ratio(rows: DataFrame, *, train: float, validation: float, ts: str = "ts") -> DataFrame:
    """train, validation or test by position in time; bounds are truncated, that of validation from the summed ratio."""
    key = Window.partitionBy("instrument_id")
    at = F.row_number().over(key.orderBy(ts)) - 1
    size = F.count("*").over(key)
    first, second = F.floor(size * F.lit(train)), F.floor(size * F.lit(train + validation))
    return rows.withColumn("split", F.when(at < first, "train").when(at < second, "validation").otherwise("test"))


def long_enough(rows: DataFrame, least: int, columns: Sequence[str]) -> DataFrame:
    """Complete rows of instruments that have at least so many of them."""
    full = rows.dropna(subset=list(columns))
    return full.withColumn("_n", F.count("*").over(Window.partitionBy("instrument_id"))).where(F.col("_n") >= least).drop("_n")


@dataclass(frozen=True)
class WalkForward:
    """Sizes in positions of a sorted time index; mode is expanding or rolling."""

    train: int
    validation: int
    test: int
    calibration: int = 0
    purge: int = 0
    embargo: int = 0
    holdout: int = 0
    stride: int | None = None
    mode: str = "expanding"
    maximum_folds: int | None = None

    def __post_init__(self) -> None:
        if min(self.train, self.validation, self.test) < 1 or min(self.calibration, self.purge, self.embargo, self.holdout) < 0:
            raise ValueError("train, validation and test need a row each; other sizes must not be negative")
        if self.mode not in ("expanding", "rolling"):
            raise ValueError("mode must be expanding or rolling")

    @property
    def span(self) -> int:
        """Positions of a fold from its first training row to its last test row."""
        gaps = 2 + (self.calibration > 0)
        return self.train + self.validation + self.calibration + self.test + gaps * self.purge

    @property
    def step(self) -> int:
        return self.stride or max(self.test, self.validation + self.calibration + self.test + (2 + (self.calibration > 0)) * self.purge)


def fold_positions(spark: SparkSession, size: int, plan: WalkForward) -> DataFrame:
    """fold and, for each part, its first and last position; empty where the index is too short."""
    usable = size - plan.holdout - (plan.embargo if plan.holdout else 0)
    count = max(0, (usable - plan.span) // plan.step + 1) if usable >= plan.span else 0
    skip = max(0, count - plan.maximum_folds) if plan.maximum_folds else 0
    shift = F.col("id") * plan.step
    train_start = shift if plan.mode == "rolling" else F.lit(0).cast("long")
    train_end = shift + plan.train - 1
    validation_start = train_end + 1 + plan.purge
    validation_end = validation_start + plan.validation - 1
    calibration_start = validation_end + 1 + plan.purge
    calibration_end = calibration_start + plan.calibration - 1
    test_start = (calibration_end if plan.calibration else validation_end) + 1 + plan.purge
    none = F.lit(None).cast("long")
    columns = {
        "train_start": train_start, "train_end": train_end, "validation_start": validation_start, "validation_end": validation_end,
        "calibration_start": calibration_start if plan.calibration else none, "calibration_end": calibration_end if plan.calibration else none,
        "test_start": test_start, "test_end": test_start + plan.test - 1,
    }
    return spark.range(skip, count).select(F.col("id").alias("fold"), *(c.cast("long").alias(n) for n, c in columns.items()))


def fold_times(positions: DataFrame, index: DataFrame, *, ts: str = "ts") -> DataFrame:
    """The times of all fold positions, in long form: (fold, bound, position, ts); two shuffles of fold rows."""
    bounds = [c for c in positions.columns if c != "fold"]
    rows = positions.unpivot("fold", bounds, "bound", "position").where("position IS NOT NULL")
    return rows.join(index.select("position", ts), "position").select("fold", "bound", "position", ts)


def numbered(index: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct times with their position from 0. The index of bar times is small next to the bars."""
    return index.select(ts).distinct().withColumn("position", F.row_number().over(Window.orderBy(ts)).cast("long") - 1)
