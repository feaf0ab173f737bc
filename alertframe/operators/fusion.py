"""Events from bulletins: the cross-reference walk, the choice of position and redshift, and downstream rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..text.cues import pattern

# What marks a refined and a coarse position; the ranks of redshifts, and downstream policies.
REFINED = "(?iU)" + pattern("counterpart*", "afterglow*", "optical transient*", "ot", "arcsec*", "uvot", "xrt position*", "enhanced xrt", "refined position*|localization*", "discover*")
COARSE = "(?iU)" + pattern("gbm", "grm", "eclairs", "real time localization*", "realtime localization*", "initial localization*", "error radius|circle of 0*|1*|2*|3*|4*|5*|6*|7*|8*|9*", "gamma ray localization*|detection*", "gamma ray burst localization*|detection*", "gammaray localization*|detection*")
MEASURE_RANK = {"spectroscopic": 2, "photometric": 1}
TYPE_RANK = {"emission": 2, "absorption": 2, "host": 1}
MAX_ERROR_DEG, ASSUMED_ERROR = 0.02, 0.2


def xref_edges(circulars: DataFrame) -> DataFrame:
    """src, dst, pos: who cites whom, in order of mention."""
    return circulars.select(F.col("circular_id").alias("src"), F.posexplode(S.xrefs(F.coalesce("body", F.lit("")))).alias("pos", "dst")).select("src", "dst", "pos")


def walk(edges: DataFrame, known: DataFrame, seeds: DataFrame, max_hops: int = 1) -> DataFrame:
    """seed, circular_id, hop: bulletins that exist (column circular_id of known) within max_hops of each seed.

    Breadth first, so hop is the least; 0 hops is the seed itself. Each hop joins the frontier alone.
    """
    live = edges.join(known.select(F.col("circular_id").alias("dst")), "dst", "left_semi")
    seen = seeds.select(F.col("circular_id").alias("seed"), "circular_id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(live, frontier["circular_id"] == live["src"]).select("seed", F.col("dst").alias("circular_id")).distinct()
        frontier = step.join(seen, ["seed", "circular_id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def position_score(subject: Column, body: Column) -> Column:
    text = F.concat_ws(" ", subject, body)
    return F.when(text.rlike(REFINED), 1).otherwise(0) - F.when(text.rlike(COARSE), 1).otherwise(0)


def rank(table: dict[str, int], x: Column) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return F.coalesce(out, F.lit(0))


def best_position(rows: DataFrame, group: str, order: str) -> DataFrame:
    """ra and dec of the best-scored row (columns score, ra, dec), the earliest of equals."""
    best = F.max_by(F.struct("ra", "dec"), F.struct(F.col("score"), -F.col(order)))
    return rows.filter("ra is not null").groupBy(group).agg(best.alias("b")).select(group, "b.ra", "b.dec")


def best_redshift(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The redshift with the highest measure and then type, the earliest of equals."""
    key = F.struct(rank(MEASURE_RANK, F.col("redshift_measure")), rank(TYPE_RANK, F.col("redshift_type")), -F.col(order))
    return rows.filter("redshift is not null").groupBy(group).agg(F.max_by("redshift", key).alias("redshift"))


def first_value(rows: DataFrame, group: str, column: str, order: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column))


def dedup_points(points: DataFrame) -> DataFrame:
    """Points once per object, filter, system, time (5 decimals), magnitude and flux; the first in (circ_ord, row_ord)."""
    w = Window.partitionBy("obj_id", "filter", "mag_system", F.bround("obs_mjd", 5), "mag", "flux").orderBy("circ_ord", "row_ord")
    return points.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without_retracted(rows: DataFrame, flags: DataFrame, group: str) -> DataFrame:
    """rows of groups none of whose bulletins (flags: group, retraction) withdraws the report."""
    bad = flags.groupBy(group).agg(F.bool_or("retraction").alias("bad")).filter("bad").select(group)
    return rows.join(bad, group, "left_anti")


def object_id(event_names: Column) -> Column:
    """An AT or SN name if there is one, else the first, without spaces."""
    plain = F.transform(event_names, lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.coalesce(F.get(F.filter(plain, lambda x: x.rlike(r"^(?:AT|SN)\d{4}")), F.lit(0)), F.get(plain, F.lit(0)))


def source_rows(found: DataFrame) -> DataFrame:
    """obj_id, ra, dec: only positions whose stated error is small enough."""
    error = F.array_max("localization.ra_dec_error")
    rows = found.select("circular_id", object_id(F.col("event.event_name")).alias("obj_id"), "localization.ra", "localization.dec", error.alias("error"))
    return rows.filter("obj_id is not null and ra is not null and dec is not null").filter(F.coalesce(F.col("error") <= MAX_ERROR_DEG, F.lit(True)))


def actions(found: DataFrame, instruments: dict[str, int], default_instrument: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per measurement: kind, point fields, the columns in keep, and reason if it can't be posted.

    Optical rows need a bandpass, a time, an object and an instrument, asked in that order; flux rows an object, a
    time, a band, an instrument and a unit. Missing errors are assumed at 20 %, missing limits at the magnitude; both
    are flagged.
    """
    pairs = F.create_map(*(F.lit(x) for kv in instruments.items() for x in kv)) if instruments else None
    known = lambda c: F.try_element_at(pairs, c) if pairs is not None else F.lit(None).cast("int")
    p = found.select("circular_id", *keep, object_id(F.col("event.event_name")).alias("obj_id"), F.posexplode("photometry").alias("row_ord", "p")).select("circular_id", *keep, "obj_id", "row_ord", "p.*")
    energy = F.coalesce("energy_flux", "limiting_energy_flux").isNotNull()
    radio = F.coalesce("flux_density", "limiting_flux_density").isNotNull()
    kind = F.when(energy, "xray").when(radio, "radio").otherwise("optical")
    band = F.coalesce(F.when(energy | radio, F.col("bandpass")), S.bandpass(F.col("filter")), F.col("bandpass"))
    value = F.when(energy, S.energy_to_ujy(F.col("energy_flux"), F.col("energy_band_kev"))).otherwise(S.to_ujy(F.col("flux_density"), F.col("flux_density_unit")))
    limit = F.when(energy, S.energy_to_ujy(F.col("limiting_energy_flux"), F.col("energy_band_kev"))).otherwise(S.to_ujy(F.col("limiting_flux_density"), F.col("flux_density_unit")))
    stated = F.when(energy, S.energy_to_ujy(F.col("energy_flux_error"), F.col("energy_band_kev"))).otherwise(S.to_ujy(F.col("flux_density_error"), F.col("flux_density_unit")))
    error = F.coalesce(stated, value * ASSUMED_ERROR, limit / F.coalesce("limiting_mag_sigma", F.lit(3.0)))
    rows = p.withColumns({"kind": kind, "band": band}).withColumn("instrument_id", F.coalesce(known(F.col("band")), known(F.col("telescope_canonical")), F.lit(default_instrument).cast("int")))
    rows = rows.withColumns({"flux": value, "flux_error": F.when(F.col("kind") != "optical", error), "error_assumed": stated.isNull() & value.isNotNull()})
    rows = rows.withColumns({"limit_mag": F.coalesce("limiting_mag", "mag"), "limiting_mag_assumed": F.col("limiting_mag").isNull() & F.col("mag").isNotNull()})
    lacks = lambda c, why: (F.col(c).isNull(), why)
    no_flux = (F.coalesce("flux", "flux_error").isNull(), "unit")
    optical = [lacks("band", "bandpass"), lacks("obs_mjd", "mjd"), lacks("obj_id", "obj_id"), lacks("instrument_id", "instrument")]
    fluxes = [lacks("obj_id", "obj_id"), lacks("obs_mjd", "mjd"), lacks("band", "bandpass"), lacks("instrument_id", "instrument"), no_flux]

    def first(checks: list[tuple[Column, str]]) -> Column:
        return F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in checks))

    return rows.withColumn("reason", F.when(F.col("kind") == "optical", first(optical)).otherwise(first(fluxes)))


def drop_reasons(acted: DataFrame) -> DataFrame:
    """Per bulletin: its drop reasons with counts, alphabetical, as one text."""
    counts = acted.filter("reason is not null").groupBy("circular_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("circular_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x.reason, F.lit(": "), x.n.cast("string"))), ", ").alias("dropped"))


def unique_instruments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for exactly one instrument."""
    ids = rows.groupBy(key).agg(F.collect_set(value).alias("ids"))
    return ids.filter(F.size("ids") == 1).select(key, F.get("ids", F.lit(0)).alias(value))
