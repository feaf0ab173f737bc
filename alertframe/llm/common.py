"""Helpers shared by the pipeline operators: input normalisation, expression helpers, shared-folder tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word separator run and "has a word", as Java and RE2 regexes alike.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []


def workdir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one in local mode only."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="alertframe-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below workdir(); it is deleted when the process ends, or earlier by drop_path()."""
    path = f"{workdir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def write_table(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, str]:
    """df as a written table in the shared folder (this cuts its lineage), and the table's path."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def id_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text alone (null text: empty), so that extra columns can't clash with computed ones."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
