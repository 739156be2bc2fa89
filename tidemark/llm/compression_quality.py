"""Quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text that is like the good texts is compressed better with their dictionary. The
difference of both compressed sizes, divided by the size without a dictionary,
goes through a logistic function together with the plain ratio (junk that repeats
itself is small under any dictionary) and the length.

The labelled sample is split by a hash of doc_id: one half trains the
dictionaries, the other calibrates the score on texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from . import common
from .learning import fit_logistic, labelled_sample, logistic

#: Documents of each class in the sample, and bytes of each class that train a dictionary.
MAX_EXAMPLES, MAX_BYTES = 3000, 8 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    beta: tuple[float, ...]


class _Sizes:
    """Compressed sizes of a text: plain, with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.tools = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)]
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))

    def measure(self, text: str) -> tuple[float, ...]:
        """Normalised difference, plain ratio, log of length, and products of these."""
        content = text.encode()
        plain, good, bad = (len(t.compress(content)) for t in self.tools)
        difference, ratio = (bad - good) / plain, plain / max(len(content), 1)
        size = np.log2(len(content) + 1) / 10
        return difference, difference * size, min(ratio, 2.0), min(ratio, 2.0) * size, size


FEATURES = 5


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of few texts, the texts themselves."""
    import zstandard

    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"        "


def _bounded(rows: list, limit: int = MAX_BYTES) -> list[str]:
    out, size = [], 0
    for row in sorted(rows, key=lambda r: (r["pick"], r["doc_id"])):
        if (size := size + len(row["text"])) > limit:
            break
        out.append(row["text"])
    return out


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", *, where: Column | None = None, max_examples: int = MAX_EXAMPLES) -> Model | None:
    """Dictionaries and calibration from at most about `max_examples` texts of each class.

    Equal texts count once for a dictionary. None without labels of both classes.
    """
    sample, weight = labelled_sample(documents, labels, label, max_examples, where=where)
    if len(weight) < 2:
        return None
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)) == 0
    size = F.length("text")
    share = {}
    for k in (0, 1):  # a few very long texts must not fill the driver
        share[k] = sample.where(half & (F.col("label") == k)).dropDuplicates(["text"]).where(size <= MAX_BYTES // 64).collect()
    good, bad = (_dictionary(_bounded(share[k])) for k in (1, 0))
    rows = _measured(sample.where(~half).select("text", "label"), good, bad).collect()
    if len({r["label"] for r in rows}) < 2:
        rows = _measured(sample.select("text", "label"), good, bad).collect()
    x = np.array([r["measures"] for r in rows], float).reshape(-1, FEATURES)
    y = np.array([r["label"] for r in rows], float)
    beta = fit_logistic(x, y, np.array([weight[int(v)] for v in y]), ridge=0.01)
    return Model(good, bad, tuple(beta.tolist()))


def _measured(frame: DataFrame, good: bytes, bad: bytes, beta: tuple[float, ...] | None = None, text: str = "text") -> DataFrame:
    spark = frame.sparkSession
    names = ("measures", "score")
    out = [c for c in frame.columns if c not in names and c != text]
    content = spark.sparkContext.broadcast((good, bad))
    schema = spark.createDataFrame([], "measures array<double>, score double").schema
    schema = type(schema)([*frame.select(*out).schema.fields, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(*content.value)
        for batch in batches:
            x = np.array([sizes.measure(t or "") for t in batch.column(text).to_pylist()], float).reshape(-1, FEATURES)
            p = logistic(x, np.array(beta)) if beta is not None else np.full(len(x), 0.5)
            made = [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *made], names=[*out, *names])

    return frame.select(*out, text).mapInArrow(run, schema)


def score(documents: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """Each row without its text, with measures and score (0 to 1, higher is better).

    A map without shuffle; dictionaries have a fixed size and are broadcast. A null
    text counts as empty, and an empty one is scored like any other. Without a model
    each score is 0.5. Repeated rows stay, other columns pass through (those named
    like added ones are replaced), and an empty table gives an empty result.
    """
    if model is None:
        return _measured(documents, b" " * 8, b" " * 8, None, text)
    return _measured(documents, model.good, model.bad, model.beta, text)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(documents, common.table(spark, sf_dir, "labels"), where=fold != 0)
    held_out = F.coalesce(fold == 0, F.lit(False)).cast(BooleanType())
    return score(documents, model).select(
        "doc_id", held_out.alias("held_out"), F.col("score").cast(DoubleType()).alias("score"),
        (F.col("score") >= 0.3).cast(IntegerType()).alias("predicted"),
    )


QUERIES = {"op8_compression_quality": op8}
