"""Fingerprints of tables, manifests and the experiment registry.

Digests are of this package's own form, version 1: each row as JSON of its columns in
name order with nulls kept, SHA-256 of it, and of all rows a sum of 60-bit parts (free of
order) or, on request, a hash chain over sorted row digests in blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = 1


def row_digest(frame: DataFrame, columns: Sequence[str] | None = None) -> Column:
    names = sorted(columns or frame.columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows and fingerprint; any order of rows gives the same. Partial sums only, no sort."""
    digest = row_digest(frame, columns)
    parts = [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    out = frame.agg(F.count("*").alias("rows"), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)))
    whole = F.concat_ws("|", F.lit(f"v{VERSION}"), F.lit(",".join(sorted(columns or frame.columns))), "rows", *(F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in range(4)))
    return out.select("rows", F.sha2(whole, 256).alias("fingerprint"))


def ordered_fingerprint(frame: DataFrame, order: str, block: int = 100_000) -> DataFrame:
    """One row that depends on the order by a number column: digests of blocks of rows, then of the blocks."""
    rows = frame.select(F.col(order).alias("_o"), row_digest(frame).alias("_d"))
    blocks = rows.groupBy(F.floor(F.col("_o") / block).alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_d"))), lambda x: x["_d"]), ""), 256).alias("_d"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), ""), 256).alias("fingerprint"))


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_once(path: str | Path, content: bytes) -> bool:
    """Publish by rename; equal content again is no change (false), other content is refused."""
    path = Path(path)
    if path.exists():
        if path.read_bytes() != content:
            raise FileExistsError(f"{path} holds something else")
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        os.link(temporary, path)
    finally:
        os.unlink(temporary)
    return True


def manifest(bars: DataFrame, *, source: str, passed: bool, parameters: Mapping[str, object]) -> dict:
    """Identity record of a validated bar table; a table with errors gets none."""
    if not passed:
        raise ValueError("the table has validation errors")
    print_ = table_fingerprint(bars).first()
    about = bars.agg(F.min("timestamp_utc").cast("string"), F.max("timestamp_utc").cast("string"), F.sort_array(F.collect_set("frequency")), F.count_distinct("instrument_id")).first()
    body = {"source": source, "rows": print_["rows"], "fingerprint": print_["fingerprint"], "start": about[0], "end": about[1], "frequencies": about[2], "instruments": about[3], "parameters": dict(parameters), "version": VERSION}
    return body | {"dataset_id": "tds-" + digest(body)[:32]}


class Registry:
    """Experiments and aliases in a folder: records by their own digest, alias events in a chain."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def register(self, record: Mapping[str, object]) -> str:
        content = canonical(record)
        name = "texp-" + hashlib.sha256(content.encode()).hexdigest()[:32]
        write_once(self.root / "records" / f"{name}.json", content.encode())
        return name

    def get(self, name: str) -> dict:
        """The record, if its content still has its digest."""
        content = (self.root / "records" / f"{name}.json").read_bytes()
        if name != "texp-" + hashlib.sha256(content).hexdigest()[:32]:
            raise ValueError(f"{name} has been changed")
        return json.loads(content)

    def store_artifact(self, path: str | Path) -> str:
        content = Path(path).read_bytes()
        key = hashlib.sha256(content).hexdigest()
        write_once(self.root / "artifacts" / key[:2] / key, content)
        return key

    def set_alias(self, alias: str, name: str, updated_at: str) -> None:
        """Point an alias to a decision-grade record; times must rise."""
        if not re.fullmatch(r"[a-z][a-z0-9-]{0,62}", alias):
            raise ValueError("an alias is lower-case letters, digits and dashes")
        if not self.get(name).get("decision_grade"):
            raise ValueError("aliases point to decision-grade experiments only")
        events = self.history(alias)
        if events and updated_at <= events[-1]["updated_at"]:
            raise ValueError("the time is not after that of the last event")
        event = {"alias": alias, "experiment": name, "previous": events[-1]["experiment"] if events else None, "updated_at": updated_at}
        write_once(self.root / "aliases" / alias / f"{len(events):08d}.json", canonical(event).encode())

    def history(self, alias: str) -> list[dict]:
        """All events, if each names the one before it."""
        events = [json.loads(p.read_bytes()) for p in sorted((self.root / "aliases" / alias).glob("*.json"))]
        for a, b in zip([{"experiment": None}, *events], events, strict=False):
            if b["previous"] != a["experiment"]:
                raise ValueError("the chain of alias events is broken")
        return events

    def resolve(self, alias: str) -> str:
        return self.history(alias)[-1]["experiment"]


def broken_chain(events: DataFrame) -> DataFrame:
    """Alias events (alias, seq, experiment, previous) that do not name the event before them."""
    before = F.lag("experiment").over(Window.partitionBy("alias").orderBy("seq"))
    return events.withColumn("_before", before).where(~F.col("previous").eqNullSafe(F.col("_before"))).drop("_before")


#: Evidence that a data source needs, by field of its assessment.
EVIDENCE = ("licence_reviewed", "terms_archived", "timestamps_documented", "timezone_documented", "adjustments_documented", "revisions_documented", "delistings_included", "identifiers_stable", "calendar_verified", "sample_reconciled", "point_in_time")


def source_gate(assessments: DataFrame, *, least_years: float = 8.0) -> DataFrame:
    """Each source with its failed checks in fixed order; it passes without any."""
    years = F.datediff("history_end", "history_start") / 365.2425
    failed = [F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in EVIDENCE] + [F.when(~F.coalesce(years >= least_years, F.lit(False)), F.lit("history_too_short"))]
    out = assessments.select("source_id", F.array_compact(F.array(*failed)).alias("failed"))
    return out.withColumn("passed", F.size("failed") == 0)
