"""Streaming: tolerant stateful deduplication and the per-batch event update."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events, extract, fusion
from ..shipping import ship

TOLERANCE_DAYS = events.TOLERANCE_DAYS
POINT = "obj_id string, filter string, mjd double"


def _keeper(tolerance: float) -> Callable:
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        out = []
        for t in rows["mjd"]:
            if all(abs(t - s) > tolerance for s in seen):
                seen.append(float(t))
                out.append((key[0], key[1], float(t)))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["obj_id", "filter", "mjd"])

    return keep


def dedup_stream(points: DataFrame, tolerance: float = TOLERANCE_DAYS) -> DataFrame:
    """Points (obj_id, filter, mjd[, ord]) that no remembered point of their object and filter is within tolerance of.

    Rows of a batch are taken in the order of ord (arrival), or in time order without one; state is kept for good.
    """
    ship(points.sparkSession)
    order = F.col("ord" if "ord" in points.columns else "mjd").cast("double").alias("ord")
    own = points.select("obj_id", "filter", F.col("mjd").cast("double").alias("mjd"), order)
    return own.groupBy("obj_id", "filter").applyInPandasWithState(_keeper(tolerance), POINT, "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def dedup_batch(points: DataFrame, tolerance: float = TOLERANCE_DAYS) -> DataFrame:
    """The same over a table: a fold over each key's sorted times that remembers the last kept one."""
    kept = F.aggregate(
        F.sort_array(F.collect_list("mjd")),
        F.array().cast("array<double>"),
        lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > tolerance), F.array_append(a, t)).otherwise(a),
    )
    return points.groupBy("obj_id", "filter").agg(kept.alias("kept")).select("obj_id", "filter", F.explode("kept").alias("mjd"))


Prime = Callable[[DataFrame], DataFrame]
Post = Callable[[DataFrame, DataFrame, int], None]


def update(new: DataFrame, corpus: DataFrame, state: str, epoch: int, instruments: dict[str, int], default_instrument: int | None = None, hops: int = 1, prime: Prime | None = None) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: (events, points) that its bulletins make new.

    A bulletin that comes again with the same body is the same one; another body replaces the bulletin in the corpus.
    Each new bulletin's event is gathered again by cross reference and fused as a whole, so that a retraction takes the
    event's points, and points pass that none posted before, in order of arrival, is near to. What was posted is kept in
    the folder `state`, a part per epoch, so that an epoch that is run again gives the same. An object that is met for
    the first time is primed: prime(obj_id rows) gives the points that the downstream system has of it.
    """
    spark = new.sparkSession
    fresh = new.withColumn("body_sha1", F.sha1(F.coalesce("body", F.lit("")))).dropDuplicates(["circular_id", "body_sha1"])
    fresh = fresh.groupBy("circular_id").agg(F.max_by(F.struct(*[c for c in corpus.columns if c != "circular_id"]), F.struct(*[c for c in ("created_on",) if c in new.columns], "body_sha1")).alias("r")).select("circular_id", "r.*")
    known = corpus.join(fresh.select("circular_id"), "circular_id", "left_anti").unionByName(fresh.select(*corpus.columns))
    groups = fusion.walk(fusion.xref_edges(known), known, fresh.select("circular_id"), hops)
    found = extract.extract(known.join(groups.select("circular_id").distinct(), "circular_id", "left_semi"))
    seen_events, points = events.fuse(found, known, groups, instruments, default_instrument)
    points = points.join(seen_events.filter("status = 'posted'").select("seed"), "seed", "left_semi")
    past = f"{state}/points"
    schema = f"{POINT}, primed boolean, epoch long"
    held = spark.read.schema(schema).parquet(past).filter(F.col("epoch") < epoch) if _exists(spark, past) else spark.createDataFrame([], schema)
    if prime is not None:
        first = points.select("obj_id").distinct().join(held.select("obj_id").distinct(), "obj_id", "left_anti")
        held = held.unionByName(prime(first).select("obj_id", "filter", "mjd").withColumns({"primed": F.lit(True), "epoch": F.lit(epoch).cast("long")}))
    kept = events.new_points(points, held, "seed", "hop", "circular_id", "row_ord")
    out = f"{past}/epoch={epoch}"
    mine = kept.select("obj_id", F.col("band").alias("filter"), F.col("obs_mjd").alias("mjd"), F.lit(False).alias("primed"))
    mine.unionByName(held.filter(F.col("primed") & (F.col("epoch") == epoch)).select("obj_id", "filter", "mjd", "primed")).write.mode("overwrite").parquet(out)
    posted = kept.groupBy("seed").agg(F.count(F.lit(1)).alias("posted"))
    done = seen_events.join(posted, "seed", "left").withColumn("posted", F.coalesce("posted", F.lit(0)))
    return done.withColumn("repeated", F.when(F.col("status") == "posted", F.col("n_points") - F.col("posted")).otherwise(0)).drop("comments"), kept  # comments would come again with every bulletin


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def consume(records: DataFrame, corpus: DataFrame, post: Post, checkpoint: str, instruments: dict[str, int], default_instrument: int | None = None, hops: int = 1, prime: Prime | None = None) -> StreamingQuery:
    """update() per micro-batch of bulletins; post gets its events (with status, posted and repeated points) and points."""

    def batch(new: DataFrame, epoch: int) -> None:
        post(*update(new, corpus, f"{checkpoint}/posted", epoch, instruments, default_instrument, hops, prime), epoch)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
