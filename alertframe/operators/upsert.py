"""Keyed tables on plain Parquet: hash-skipping upsert, keyed replace, ordered deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def record_hash(*cols: str) -> Column:
    """sha1 of the columns' JSON in alphabetical order."""
    return F.sha1(F.to_json(F.struct(*sorted(cols))))


def upsert(current: DataFrame, incoming: DataFrame, key: str, *content: str, newest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The new version of current (with record_hash) and the rows that changed it; equal content is no change.

    Of incoming rows of one key the last by `newest` counts, of equal ones that with the greatest hash.
    """
    fresh = incoming.withColumn("record_hash", record_hash(*content))
    order = F.struct(*([newest] if newest else []), "record_hash")
    fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")
    changed = fresh.join(current.select(key, "record_hash"), [key, "record_hash"], "left_anti")
    kept = current.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True), changed


def latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key: the newest, of equally new ones that with the greatest hash of its JSON."""
    tie = F.xxhash64(F.to_json(F.struct(*df.columns)))
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), tie.desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def event_bridge(circulars: DataFrame) -> DataFrame:
    """circular_id, event_norm, is_primary: every name of a bulletin once."""
    subject, body = F.col("subject"), F.col("body")
    primary = S.normal_event(S.primary_event(F.col("event_id"), subject, body))
    named = F.concat(F.array_compact(F.array(primary)), S.event_names(S.clean_text(subject)), S.event_names(S.clean_text(body)))
    rows = circulars.select("circular_id", primary.alias("p"), F.explode(F.array_distinct(named)).alias("event_norm"))
    return rows.select("circular_id", "event_norm", F.coalesce(F.col("event_norm") == F.col("p"), F.lit(False)).alias("is_primary"))
