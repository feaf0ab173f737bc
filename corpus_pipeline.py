"""Corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, best-fit packing.

Each stage takes all that its predecessor kept, acts on it and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertframe.llm import bag_minhash, line_dedup, packing, positional_index, quality_rules
from alertframe.llm.common import NOT_WS, table, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy keeps."""
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier passages; those left without a word go."""
    done = line_dedup.line_dedup(docs)
    changed = F.col(f"`{done.columns[-1]}`").isNotNull()
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    emptied = changed & ~F.col("text").rlike(NOT_WS)
    return done.filter(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return bag_minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return positional_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, each with its sequence and offset."""
    return packing.pack(docs, size=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", pack),
]

#: Near duplicates and packing can't be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
