"""A data source that replays landed vendor files, as vendor services cannot be reached from a query.

spark.dataSource.register(ReplaySource); spark.read.format("tidemark_replay").option("path", folder).load()
Each file of the folder is one partition, so executors read files side by side; the folder
must be one that they share.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .readers import HEADERS

FIELDS = ("open", "high", "low", "close", "volume", "amount")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.csv"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        def number(text: str | None) -> float | None:
            try:
                return float((text or "").replace(",", ""))
            except ValueError:
                return None

        if partition is None:
            return
        with open(partition.path, encoding="utf-8-sig", newline="") as file:
            for row in csv.DictReader(file):
                known = {HEADERS.get(k, k): v for k, v in row.items()}
                yield (Path(partition.path).stem, known.get("ts"), *(number(known.get(c)) for c in FIELDS))


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_replay"

    def schema(self) -> str:
        return "instrument_id string, ts string, " + ", ".join(f"{c} double" for c in FIELDS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])
