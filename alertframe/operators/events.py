"""Event fusion as one operation: what a group of bulletins says of its event, and what of that can be posted."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fusion

#: A position's error from which on it is a region, and the tolerance for one measurement reported at several times.
TOLERANCE_DAYS = 0.02


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a table in the folder that spark.checkpoint.dir names, else kept by the executors (tests)."""
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _earliest(value: Column, order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), order))


def bulletin_comments(found: DataFrame, acted: DataFrame, by: str = "seed") -> DataFrame:
    """by, circular_id and comments: what a bulletin says that isn't posted as a value, in a fixed order.

    found has the event's name and position in place of the bulletin's own; acted is fusion.actions(found).
    """
    # The comments' wordings.
    error, obj = F.array_max("localization.ra_dec_error"), fusion.object_id(F.col("event.event_name"))
    region = F.concat(F.lit("Position is an error region ("), F.format_string("%.3f", error), F.lit(" deg), not a counterpart; no source created."))
    nowhere = F.concat(F.lit("Source "), obj, F.lit(" not created: no RA/Dec in this circular (position comes from the discovery circular)."))
    whole = F.col("localization.ra").isNotNull() & F.col("localization.dec").isNotNull()
    source = (
        F.when(F.col("retraction"), "This circular withdraws the trigger; no source created and no photometry posted.")
        .when(error > fusion.MAX_ERROR_DEG, region)
        .when(obj.isNotNull() & ~F.coalesce(whole, F.lit(False)), nowhere)
    )
    notes = F.transform(F.coalesce("extraction_meta.notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("Note (not posted as a value): "), n))
    counts = acted.filter("reason is not null").groupBy(by, "circular_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x.n.cast("string"), F.lit("x "), x.reason))
    dropped = counts.groupBy(by, "circular_id").agg(F.sum("n").alias("n"), F.array_join(listed, ", ").alias("why"))
    lost = F.concat(F.col("n").cast("string"), F.lit(" photometry row(s) could not be posted ("), F.col("why"), F.lit("); kept in the extraction only."))
    rows = found.select(by, "circular_id", source.alias("s"), notes.alias("notes")).join(dropped, [by, "circular_id"], "left")
    return rows.select(by, "circular_id", F.array_compact(F.concat(F.array("s"), "notes", F.array(lost))).alias("comments"))


def fuse(found: DataFrame, texts: DataFrame, groups: DataFrame, instruments: dict[str, int], default_instrument: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, points) from extractions, their texts (circular_id, subject, body) and groups (seed, circular_id, hop).

    events: a row per seed with name, obj_id, source (has a position good enough), ra, dec, the best redshift, first-named
    comments without repeats, skipped rows, withdrawn bulletins and status. points: seed, what fusion.actions gives of
    measurements that can be posted, once each; none of an event that any of its bulletins withdraws.
    """
    own = settled(groups.select("seed", "circular_id", "hop").join(found, "circular_id").join(texts.select("circular_id", fusion.position_score(F.col("subject"), F.col("body")).alias("score")), "circular_id"))
    order, name = F.struct("hop", "circular_id"), F.when(F.size("event.event_name") > 0, F.col("event.event_name"))
    place = F.col("localization")
    z = F.when(F.col("redshift.redshift").isNotNull(), F.col("redshift"))
    weight = F.struct(-fusion.rank(fusion.MEASURE_RANK, z["redshift_measure"]), -fusion.rank(fusion.TYPE_RANK, z["redshift_type"]), "hop", "circular_id")
    fused = own.groupBy("seed").agg(
        _earliest(name, order).alias("name"),
        F.min_by(place, F.when(place.isNotNull(), F.struct(-F.col("score"), "hop", "circular_id"))).alias("place"),
        F.min_by(z, F.when(z.isNotNull(), weight)).alias("z"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("retraction"), order))), lambda x: x.circular_id).alias("withdrawn"),
    )
    given = own.drop("event", "localization", "score").join(fused, "seed")
    event = F.when(F.col("name").isNotNull(), F.struct(F.col("name").alias("event_name")))
    given = given.withColumns({"event": event, "localization": F.col("place")})
    acted = settled(fusion.actions(given.filter("not retraction"), instruments, default_instrument, keep=("seed", "hop", "withdrawn")))
    good = acted.filter("reason is null and size(withdrawn) = 0").withColumns({"circ_ord": F.struct("hop", "circular_id"), "mag_system": F.col("mag_system")})
    w = Window.partitionBy("seed", "obj_id", "band", "mag_system", F.bround("obs_mjd", 5), "mag", "flux").orderBy("circ_ord", "row_ord")
    points = good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "circ_ord", "withdrawn")
    said = bulletin_comments(given, acted).join(groups.select("seed", "circular_id", "hop"), ["seed", "circular_id"])
    comments = said.groupBy("seed").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hop", "circular_id", "comments"))), lambda x: x.comments))).alias("comments"))
    skipped = acted.groupBy("seed").agg(F.count("reason").alias("skipped"))
    n_points = points.groupBy("seed").agg(F.count(F.lit(1)).alias("n_points"))
    obj, error = fusion.object_id(F.col("name")), F.array_max("place.ra_dec_error")
    source = obj.isNotNull() & F.col("place.ra").isNotNull() & F.col("place.dec").isNotNull() & F.coalesce(error <= fusion.MAX_ERROR_DEG, F.lit(True))
    events = fused.join(comments, "seed", "left").join(skipped, "seed", "left").join(n_points, "seed", "left")
    ids = F.array_join(F.transform("withdrawn", lambda c: F.concat(F.lit("GCN "), c.cast("string"))), ", ")
    note = F.concat(F.lit("A circular withdraws this counterpart ("), ids, F.lit("); no photometry posted."))
    every = F.array_compact(F.concat(F.coalesce("comments", F.array().cast("array<string>")), F.array(F.when(F.size("withdrawn") > 0, note))))
    some = F.coalesce(F.col("n_points") > 0, F.lit(False)) | F.col("z").isNotNull()
    return events.select(
        "seed", F.col("name").alias("event_name"), obj.alias("obj_id"), F.coalesce(source, F.lit(False)).alias("source"), F.col("place.ra").alias("ra"), F.col("place.dec").alias("dec"),
        F.col("z.redshift").alias("redshift"), F.get("z.redshift_error", F.lit(0)).alias("redshift_error"), F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
        every.alias("comments"), "withdrawn", F.when(F.coalesce(source, F.lit(False)) & some, "posted").otherwise("nothing-postable").alias("status"),
    ), points


def new_points(points: DataFrame, seen: DataFrame, *order: str, tolerance: float = TOLERANCE_DAYS) -> DataFrame:
    """points (obj_id, band, obs_mjd, order columns) that no seen one (obj_id, filter, mjd) of their object and band, and no
    earlier one in that order, is within tolerance of: arrival order decides, as a message at a time would."""
    known = seen.groupBy("obj_id", F.col("filter").alias("band")).agg(F.collect_list("mjd").alias("seen"))
    rows = points.groupBy("obj_id", "band").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*points.columns).alias("row")))).alias("rows"))
    none = F.array().cast("array<double>")
    start = F.struct(F.coalesce("seen", none).alias("seen"), F.array().cast(rows.schema["rows"].dataType).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        t = x["row"]["obs_mjd"]
        new = F.struct(F.array_append(a["seen"], t).alias("seen"), F.array_append(a["kept"], x).alias("kept"))
        return F.when(F.exists(a["seen"], lambda s: F.abs(s - t) <= tolerance), a).otherwise(new)

    kept = rows.join(known, ["obj_id", "band"], "left").select(F.explode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("x"))
    return kept.select("x.row.*")
