"""The extraction store: a Parquet table with pushed-down keys, and the queries it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_event
from .sky import cone
from .upsert import latest

KEY = ["circular_id", "extractor_id", "model_id", "prompt_version"]


def rows(found: DataFrame, created_at: int) -> DataFrame:
    """Extractions as store rows: key, primary event and position beside the typed record."""
    record = F.struct(*[c for c in found.columns if c != "circular_id"])
    return found.select(
        "circular_id", F.col("extraction_meta.extractor").alias("extractor_id"), F.coalesce("extraction_meta.model_id", F.lit("")).alias("model_id"), F.coalesce("extraction_meta.prompt_version", F.lit("")).alias("prompt_version"),
        normal_event(F.get("event.event_name", F.lit(0))).alias("primary_event"), F.col("localization.ra").alias("ra"), F.col("localization.dec").alias("dec"), record.alias("record"), F.lit(created_at).cast("long").alias("created_at"),
    )


def put(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """The store's next version: new rows replace those of the same key."""
    return latest(store.unionByName(new, allowMissingColumns=True) if store is not None else new, KEY, "created_at")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions in a folder, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    found = [s.getPath() for s in files.listStatus(hadoop) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def save(spark: SparkSession, store: DataFrame, path: str) -> int:
    """Writes the store as a new version beside the older ones, which the plan may be reading; its number."""
    number = max(versions(spark, path), default=0) + 1
    store.write.mode("overwrite").partitionBy("extractor_id").parquet(f"{path}/version={number}")
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or a given one."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no store in {path}")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/version={version or known[-1]}")


def count(store: DataFrame) -> int:
    return store.count()


def get(store: DataFrame, circular_id: int, extractor_id: str, model_id: str = "", prompt_version: str = "") -> DataFrame:
    return store.filter((F.col("circular_id") == circular_id) & (F.col("extractor_id") == extractor_id) & (F.col("model_id") == model_id) & (F.col("prompt_version") == prompt_version))


def by_event(store: DataFrame, event: str, extractor_id: str | None = None) -> DataFrame:
    """An event's rows, newest first."""
    hits = store.filter(F.col("primary_event") == normal_event(F.lit(event)))
    hits = hits.filter(F.col("extractor_id") == extractor_id) if extractor_id else hits
    return hits.orderBy(F.desc("created_at"), "circular_id")


def circular_ids(store: DataFrame, extractor_id: str | None = None) -> DataFrame:
    hits = store.filter(F.col("extractor_id") == extractor_id) if extractor_id else store
    return hits.select("circular_id").distinct().orderBy("circular_id")


def redshift_of(store: DataFrame, event: str, extractor_id: str | None = "regex") -> DataFrame:
    """The newest redshift that any of the event's rows has."""
    z = F.col("record.redshift")
    return by_event(store, event, extractor_id).filter(z.isNotNull()).agg(F.max_by(z, F.struct("created_at", -F.col("circular_id"))).alias("redshift"))


def classification_of(store: DataFrame, event: str, extractor_id: str | None = "regex") -> DataFrame:
    kind = F.col("record.classification")
    return by_event(store, event, extractor_id).filter(kind.isNotNull()).agg(F.max_by(kind, F.struct("created_at", -F.col("circular_id"))).alias("classification"))


def photometry_of(store: DataFrame, event: str, extractor_id: str | None = "regex") -> DataFrame:
    return by_event(store, event, extractor_id).select("circular_id", F.posexplode("record.photometry").alias("row", "p")).select("circular_id", "row", "p.*")


def counterparts(store: DataFrame, event: str) -> DataFrame:
    return by_event(store, event).select("circular_id", "extractor_id", "record.follow_up")


def by_position(store: DataFrame, ra: float, dec: float, radius_arcsec: float, limit: int = 50) -> DataFrame:
    return cone(store, ra, dec, radius_arcsec, limit).withColumn("sep_arcsec", F.round("sep_arcsec", 4))
