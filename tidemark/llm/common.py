"""Pieces that several corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(column, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new one (single machines only)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (folder := spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def broadcast_if_small(frame: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast if a written table has at most `limit` rows; else it is joined by a shuffle."""
    return F.broadcast(frame) if frame.count() <= limit else frame


def compiled(key: object, make: Callable[[], object]) -> object:
    """What make() returns; a process keeps that of the last key for its later tasks."""
    if getattr(sys, "_tidemark_compiled", (None,))[0] != key:
        sys._tidemark_compiled = None, None  # freed before the next one is made
        sys._tidemark_compiled = key, make()
    return sys._tidemark_compiled[1]


def give_back() -> None:
    """Return memory that is free to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that frees what another stage has left in its process, and its own memory at the end of a task.

    Spark's Python processes outlive a stage and stand idle beside the next ones.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys._tidemark_compiled = None, None
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    They last until drop() or the end of the session.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session has ended already
            pass
