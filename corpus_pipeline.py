"""Corpus preparation: quality rules, line and near deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of docs, whatever these are beyond doc_id and
text. Rows that repeat a doc_id and text are one document for near deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_fst


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged; those without text go."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; n_chars, if there, follows.

    A document that loses its last line with a word goes: all of it stands in others.
    """
    return line_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return near_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text and whether they decode to it."""
    return sentencepiece_fst.encoded_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("decontamination", benchmark),
    ("sentencepiece", encode),
]

#: The tokenisers' output cannot be expressed in SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name.replace(' ', '-')}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0].replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
