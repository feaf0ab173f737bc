"""The registered queries and the SQL that states their results independently.

Bulletins are written from the driver's order tables (synth); what a query must find in their texts is stated by the
oracle from those tables' columns, without reading a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify, evaluate, events, extract, fusion, labels, sampling, search, sky, store, upsert
from ..sources import readers
from ..streaming import consume
from ..synth import circulars, circulars_sql, facts, facts_sql, lines_sql, register, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FACTS = facts_sql(True)
BAND = "case band when 1 then 'r' when 2 then 'g' when 3 then 'R' else 'i' end"
UNIT = "case t_unit when 0 then 's' when 1 then 'm' when 2 then 'h' else 'd' end"
EVENT = "replace(event, ' ', '')"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _extracted(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return extract.extract(circulars(spark, sf_dir), fields=fields or extract.FIELDS)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders")
    return spark.sql(facts_sql(False))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"select {EVENT} as event, circular_id, z_milli / 1000.0 as redshift from ({FACTS}) where odd <> 2 qualify row_number() over (partition by event order by case z_kind when 0 then 2 when 1 then 1 else 0 end desc, case z_kind when 2 then 1 else 0 end desc, circular_id) = 1")
def redshift_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: bulletins to records, and each event's best redshift with where it was stated."""
    found = _extracted(spark, sf_dir, "event", "redshift").select("circular_id", S.normal_event(F.get("event.event_name", F.lit(0))).alias("event"), "redshift.*").filter("redshift is not null")
    key = F.struct(fusion.rank(fusion.MEASURE_RANK, F.col("redshift_measure")), fusion.rank(fusion.TYPE_RANK, F.col("redshift_type")), -F.col("circular_id"))
    return found.groupBy("event").agg(F.max_by(F.struct("circular_id", "redshift"), key).alias("b")).select("event", "b.circular_id", "b.redshift")


@query(circulars_sql(True))
def synth_circulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulars(spark, sf_dir)


@query(f"select circular_id, case when where_named = 0 then event else {EVENT} end as primary_event from ({FACTS})")
def event_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulars(spark, sf_dir).select("circular_id", S.primary_event(F.col("event_id"), F.col("subject"), F.col("body")).alias("primary_event"))


@query(f"select circular_id, {EVENT} as event_norm, true as is_primary from ({FACTS})")
def event_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.event_bridge(circulars(spark, sf_dir))


@query(f"select circular_id as src, cites as dst, 0 as pos from ({FACTS})")
def xref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.xref_edges(circulars(spark, sf_dir))


@query(f"""with recursive e as (select circular_id as src, cites as dst from ({FACTS}) where cites in (select circular_id from ({FACTS}))),
w(seed, circular_id, hop) as (select circular_id, circular_id, 0 from ({FACTS}) where circular_id % 50 = 0
  union select w.seed, e.dst, w.hop + 1 from w join e on w.circular_id = e.src where w.hop < 3)
select seed, circular_id, min(hop)::int as hop from w group by seed, circular_id""")
def xref_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = circulars(spark, sf_dir)
    return fusion.walk(fusion.xref_edges(c), c, c.filter("circular_id % 50 = 0"), 3)


@query(f"select circular_id, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec from ({FACTS})")
def coords_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "localization").select("circular_id", "localization.ra", "localization.dec")


@query(f"select circular_id, 15.0 * (hh + mi / 60.0 + ss / 3600.0)::double as ra, -((mi + hh / 60.0 + ss / 3600.0))::double as dec from ({FACTS})")
def coords_sexagesimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    body = F.concat(F.lit("RA (J2000) = "), two("hh"), F.lit("h"), two("mi"), F.lit("m"), two("ss"), F.lit("s, Dec (J2000) = -"), two("mi"), F.lit("d"), two("hh"), F.lit("m"), two("ss"), F.lit("s"))
    found = extract.extract(facts(spark, sf_dir).select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("localization",))
    return found.select("circular_id", F.col("localization.ra").alias("ra"), F.col("localization.dec").alias("dec"))


ORACLES["coords_sexagesimal"] = f"select circular_id, 0.0 + round(15.0::double * (hh::double + mi::double / 60.0 + ss::double / 3600.0), 6) as ra, 0.0 + round(-(mi::double + hh::double / 60.0 + ss::double / 3600.0), 6) as dec from ({FACTS})"
QUERIES["coords_sexagesimal"] = lambda spark, sf_dir, f=QUERIES["coords_sexagesimal"]: f(spark, sf_dir).select("circular_id", (F.round("ra", 6) + 0.0).alias("ra"), (F.round("dec", 6) + 0.0).alias("dec"))


@query(f"select circular_id, ra_milli / 1000.0 as ra, (mi + 1) / 4.0 as major, (ss + 1) / 120.0 as minor from ({FACTS})")
def ipn_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra = F.concat(F.expr("ra_milli div 1000").cast("string"), F.lit("."), F.lpad((F.col("ra_milli") % 1000).cast("string"), 3, "0"))
    size = F.concat(F.expr("(mi + 1) div 2").cast("string"), F.when((F.col("mi") + 1) % 2 == 1, ".5").otherwise(".0"))
    body = F.concat(F.lit("Center:\n "), ra, F.lit(" (0h) +12.5 (12d)\n its maximum dimension is "), size, F.lit(" deg (the minimum one is "), (F.col("ss") + 1).cast("string"), F.lit(" arcmin)"))
    found = extract.extract(facts(spark, sf_dir).select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("localization",))
    at = F.col("localization.ra_dec_error")
    return found.select("circular_id", "localization.ra", F.get(at, F.lit(0)).alias("major"), F.get(at, F.lit(1)).alias("minor"))


MAG = f"select circular_id, {BAND} as filter, case when odd <> 1 then mag_centi / 100.0 end as mag, case when odd <> 1 then err_centi / 100.0 end as mag_error, case when odd = 1 then mag_centi / 100.0 end as limiting_mag, odd <> 1 as is_detection from ({FACTS})"


@query(MAG)
def mags_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.photometry_rows(_extracted(spark, sf_dir, "photometry")).filter("filter is not null").select("circular_id", "filter", "mag", "mag_error", "limiting_mag", "is_detection")


def _tabled(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return extract.photometry_rows(extract.extract(tables(spark, sf_dir, form), fields=("photometry",)))


TABLE = f"select circular_id, cast(row_number() over (partition by circular_id order by line) - 1 as int) as row, {BAND} as filter, mag_centi / 100.0 as mag, err_centi / 100.0 as mag_error from ({lines_sql(True)})"


@query(TABLE)
def mags_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tabled(spark, sf_dir, "pipe").select("circular_id", "row", "filter", "mag", "mag_error")


@query(TABLE.replace("as mag_error", "as mag_error, cast(epoch(timestamp '2024-01-01') / 86400 as bigint) + 40587 + line::double as obs_mjd"))
def mags_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tabled(spark, sf_dir, "spaced").select("circular_id", "row", "filter", "mag", "mag_error", "obs_mjd")


@query(TABLE.replace("as mag_error", "as mag_error, concat('2024-01-', lpad((1 + line)::varchar, 2, '0'), 'T03:04:05Z') as obs_time") + " qualify row <= 2")
def mags_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of this template count within three lines of their header."""
    return _tabled(spark, sf_dir, "fixed").select("circular_id", "row", "filter", "mag", "mag_error", "obs_time")


@query(f"select circular_id, {BAND} as filter, case band when 1 then 'sdssr' when 2 then 'sdssg' when 3 then 'bessellr' else 'sdssi' end as bandpass, case band when 3 then 'Vega' else 'AB' end as mag_system from ({FACTS})")
def bandpass_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select("circular_id", F.expr(BAND).alias("filter"))
    return rows.select("circular_id", "filter", S.bandpass(F.col("filter")).alias("bandpass"), S.mag_system(F.col("filter")).alias("mag_system"))


GHZ = "case ghz_k when 0 then 6.0 when 1 then 10.0 else 22.0 end"


@query(f"select circular_id, flux::double as flux_density, 5.0::double as flux_density_error, 'uJy' as flux_density_unit, {GHZ}::double as frequency_ghz, case ghz_k when 0 then 'radio-6GHz' when 1 then 'radio-10GHz' else 'radio-22GHz' end as bandpass from ({FACTS}) where odd = 3")
def radio_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.photometry_rows(_extracted(spark, sf_dir, "photometry"))
    return rows.filter("flux_density is not null").select("circular_id", "flux_density", "flux_density_error", "flux_density_unit", "frequency_ghz", "bandpass")


@query(f"select circular_id, flux as flux_e16, 0.5::double as low, 10.0::double as high, 'epfxt' as bandpass from ({FACTS})")
def xray_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("EP-FXT measured a 0.5-10 keV flux of "), F.col("flux").cast("string"), F.lit("e-16 erg/cm^2/s."))
    rows = extract.photometry_rows(extract.extract(facts(spark, sf_dir).select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("photometry",)))
    return rows.select("circular_id", F.round(F.col("energy_flux") * 1e16).cast("int").alias("flux_e16"), F.get("energy_band_kev", F.lit(0)).alias("low"), F.get("energy_band_kev", F.lit(1)).alias("high"), "bandpass")


@query(f"select circular_id, flux * case ghz_k when 0 then 1.0::double when 1 then 1000.0::double else 1000000.0::double end as ujy from ({FACTS})")
def ujy_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("ghz_k") == 0, "uJy").when(F.col("ghz_k") == 1, "mJy").otherwise("Jy")
    return _facts(spark, sf_dir).select("circular_id", S.to_ujy(F.col("flux").cast("double"), unit).alias("ujy"))


@query(f"select circular_id, case when odd <> 2 then z_milli / 1000.0 end as redshift, case when odd = 2 then concat('z < ', (z_milli // 1000)::varchar, '.', lpad((z_milli % 1000)::varchar, 3, '0')) end as bound from ({FACTS})")
def redshift_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    return circulars(spark, sf_dir).select("circular_id", S.redshift_point(body).alias("redshift"), S.redshift_bound(body).alias("bound"))


@query(f"select circular_id, case z_kind when 0 then 'spectroscopic' when 1 then 'photometric' end as measure, case z_kind when 2 then 'absorption' end as type from ({FACTS}) where odd <> 2")
def redshift_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _extracted(spark, sf_dir, "redshift").filter("redshift is not null")
    return z.select("circular_id", F.col("redshift.redshift_measure").alias("measure"), F.col("redshift.redshift_type").alias("type"))


CLASS = ["type Ia", "SN Ib", "kilonova", "TDE", "SN IIn"]
_KINDS = ["Ia", "Ib", "kilonova", "Tidal Disruption Event", "IIn"]
_SN = "Time-domain Source/Stellar variable/Cataclysmic/Supernova"
_PLACES = [f"{_SN}/Type I/Ia", f"{_SN}/Type I/Ib", "Time-domain Source/Stellar variable/Cataclysmic/compact merger/DNS/kilonova", "Time-domain Source/Nonstellar/Galactic Nuclei/Tidal Disruption Event", f"{_SN}/Type II/IIn"]
_CLASS_SQL, _PATH_SQL = (" ".join(f"when {k} then '{x}'" for k, x in enumerate(xs)) for xs in (_KINDS, _PLACES))


@query(f"select circular_id, case circular_id % {len(CLASS)} {_CLASS_SQL} end as classification, case circular_id % {len(CLASS)} {_PATH_SQL} end as path from ({FACTS})")
def class_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, CLASS)), (F.col("circular_id") % len(CLASS) + 1).cast("int"))
    rows = facts(spark, sf_dir).select("circular_id", F.lit("").alias("subject"), F.concat(F.lit("The spectrum is consistent with a "), named, F.lit(" at early times.")).alias("body"))
    return extract.extract(rows, fields=("classification",)).select("circular_id", "classification.classification", F.array_join("classification.taxonomy_path", "/").alias("path"))


@query(f"select circular_id, t_off::double as value, {UNIT} as unit, 'trigger' as reference, t_off * case t_unit when 0 then 1.0::double when 1 then 60.0::double when 2 then 3600.0::double else 86400.0::double end as seconds from ({FACTS}) where odd <> 1")
def time_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir, "time_offsets").select("circular_id", F.explode("time_offsets").alias("o")).select("circular_id", "o.*")
    return rows.withColumn("seconds", S.offset_seconds(F.col("value"), F.col("unit")))


@query(f"select circular_id, concat(day, 'T', lpad(hh::varchar, 2, '0'), ':', lpad(mi::varchar, 2, '0'), ':', lpad(ss::varchar, 2, '0'), 'Z') as obs_time from ({FACTS})")
def epoch_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    body = F.concat(F.lit("We observed the field on "), F.col("day"), F.lit(" "), two("hh"), F.lit(":"), two("mi"), F.lit(":"), two("ss"), F.lit(" UT.\nr = 18.50 +/- 0.10"))
    rows = extract.photometry_rows(extract.extract(facts(spark, sf_dir).select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("photometry",)))
    return rows.select("circular_id", "obs_time")


_DATED = "round(epoch(day::timestamp + to_seconds(t_off * case t_unit when 0 then 1 when 1 then 60 when 2 then 3600 else 86400 end)) / 86400.0 + 40587.0, 6)"


@query(f"select circular_id, case when odd = 1 then null else {_DATED} end as obs_mjd from ({FACTS}) union all select circular_id, {_DATED} from ({FACTS}) where odd = 3")
def epoch_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements dated by their offset from a trigger at midnight of the order's day; those without an offset stay undated."""
    dated = circulars(spark, sf_dir, "day").withColumn("trigger_time", F.to_timestamp("day"))
    rows = extract.photometry_rows(extract.extract(dated, fields=("photometry",)))
    return rows.select("circular_id", F.round("obs_mjd", 6).alias("obs_mjd"))


@query(f"select circular_id, odd = 0 as retraction from ({FACTS})")
def retraction_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulars(spark, sf_dir).select("circular_id", S.is_retraction(F.col("subject")).alias("retraction"))


@query(f"select circular_id, case when z_kind = 0 and odd <> 2 then 'spec_z_classification' when odd = 1 then null else 'single_row_mag' end as stratum from ({FACTS})")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulars(spark, sf_dir).select("circular_id", sampling.stratum(F.col("body")).alias("stratum"))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by sha1(concat('7', doc_id::varchar)), doc_id) as n from documents) where n <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_table(spark, sf_dir, "documents"), "source", "doc_id", 5, "7").select("source", "doc_id")


@query("select toxic, doc_id from (select toxic, doc_id, row_number() over (partition by toxic order by doc_id) - 1 as n from labels) where n % 7 = 0")
def harvest_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stride(_table(spark, sf_dir, "labels"), "toxic", "doc_id", 7).select("toxic", "doc_id")


@query("select doc_id, case when (row_number() over (partition by quality order by doc_id) - 1) % 10 = 0 then 'val' else 'train' end as split from labels")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(_table(spark, sf_dir, "labels"), "quality", "doc_id", 10).select("doc_id", "split")


@query("select sha1(text) as body_sha1, min(doc_id) as doc_id, count(*)::bigint as n from documents group by 1")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.groupBy(F.sha1("text").alias("body_sha1")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 5 <> 0 union all select c_custkey, c_acctbal + 1 from customer where c_custkey % 15 = 0 union all select c_custkey, c_acctbal from customer where c_custkey % 5 = 0 and c_custkey % 3 <> 0")
def hash_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer comes in changed, the others as they are: only the changed ones are replaced."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    now = c.withColumn("record_hash", upsert.record_hash("c_acctbal"))
    new = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return upsert.upsert(now, new, "c_custkey", "c_acctbal")[0].select("c_custkey", "c_acctbal")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def keyed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return upsert.latest(e, ["user_id", "event_type"], "event_id")


@query(f"""with c as ({circulars_sql(True)}) select circular_id, 1::bigint as score, created_on from c
where contains(body, 'radio flux density') order by created_on desc, circular_id::varchar desc limit 20""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = circulars(spark, sf_dir)
    return search.search(search.index(c), upsert.event_bridge(c), "the radio flux density", limit=20).select("circular_id", "score", "created_on")


@query(f"""select circular_id, 3::bigint as score, (1700000000000 + circular_id * 60000)::bigint as created_on from ({FACTS})
where event = (select event from ({FACTS}) order by circular_id limit 1) order by created_on desc, circular_id::varchar desc limit 10""")
def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletins of the event that the first order names."""
    event = _facts(spark, sf_dir).orderBy("circular_id").select("event").first().event
    c = circulars(spark, sf_dir)
    return search.search(search.index(c), upsert.event_bridge(c), event).select("circular_id", "score", "created_on")


@query("select term, count(*)::bigint as df, sum(n)::bigint as tf from (select doc_id, term, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[\\pL\\pN]+')) as term from documents) group by all) group by term")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequencies of every term of all documents, from the inverted index."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("circular_id"), F.lit("").alias("subject"), F.col("text").alias("body"))
    return search.postings(d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("tf"))


_SEP = "degrees(atan2(sqrt(pow(cos(radians(dec2)) * sin(radians(ra2 - ra)), 2) + pow(cos(radians(dec)) * sin(radians(dec2)) - sin(radians(dec)) * cos(radians(dec2)) * cos(radians(ra2 - ra)), 2)), sin(radians(dec)) * sin(radians(dec2)) + cos(radians(dec)) * cos(radians(dec2)) * cos(radians(ra2 - ra)))) * 3600"


@query(f"select circular_id, ra, dec, round(sep, 4) as sep_arcsec from (select circular_id, ra, dec, {_SEP} as sep from (select circular_id, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec, 1.0 as ra2, -83.5 as dec2 from ({FACTS}))) where sep <= 18000 order by sep limit 50")
def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _facts(spark, sf_dir).select("circular_id", (F.col("ra_milli") / 1000.0).alias("ra"), (F.col("dec_milli") / 1000.0).alias("dec"))
    return sky.cone(points, 1.0, -83.5, 18000.0).withColumn("sep_arcsec", F.round("sep_arcsec", 4))


@query(f"with p as (select circular_id, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec from ({FACTS})), pairs as (select a.circular_id as a, b.circular_id as b, {_SEP} as sep from p a, (select circular_id, ra as ra2, dec as dec2 from p where circular_id % 50 = 0) b where abs(a.dec - b.dec2) <= 1) select a, b, round(sep, 4) as sep_arcsec from pairs where sep <= 3600")
def cone_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _facts(spark, sf_dir).select("circular_id", (F.col("ra_milli") / 1000.0).alias("ra"), (F.col("dec_milli") / 1000.0).alias("dec"))
    b = p.filter("circular_id % 50 = 0").select(F.col("circular_id").alias("b"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return sky.cone_join(p.withColumnRenamed("circular_id", "a"), b, 3600.0).select("a", "b", F.round("sep_arcsec", 4).alias("sep_arcsec"))


ORACLES["cone_join"] = ORACLES["cone_join"].replace("with p as", "with p as materialized").replace("a.circular_id as a, b.circular_id as b, " + _SEP, "a.circular_id as a, b.circular_id as b, " + _SEP.replace("(dec)", "(a.dec)").replace("- ra)", "- a.ra)"))


@query(f"select cust, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec from ({FACTS}) qualify row_number() over (partition by cust order by case when odd = 3 then 1 else 0 end desc, circular_id) = 1")
def fuse_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the position of the best-scored bulletin; here texts with a radio flux are marked as counterparts."""
    facts = _facts(spark, sf_dir)
    body = F.when(F.col("odd") == 3, "an optical counterpart is seen").otherwise("no cue here")
    rows = facts.select("cust", "circular_id", (F.col("ra_milli") / 1000.0).alias("ra"), (F.col("dec_milli") / 1000.0).alias("dec"), fusion.position_score(F.lit(""), body).alias("score"))
    return fusion.best_position(rows, "cust", "circular_id")


@query(f"select cust, z_milli / 1000.0 as redshift from ({FACTS}) where odd <> 2 qualify row_number() over (partition by cust order by case z_kind when 0 then 2 when 1 then 1 else 0 end desc, case z_kind when 2 then 1 else 0 end desc, circular_id) = 1")
def fuse_redshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _extracted(spark, sf_dir, "redshift").select("circular_id", "redshift.*")
    return fusion.best_redshift(z.join(_facts(spark, sf_dir).select("circular_id", "cust"), "circular_id"), "cust", "circular_id")


@query(f"select obj_id, filter, mag, circ_ord from (select cust::varchar as obj_id, {BAND} as filter, (mag_centi // 50)::bigint as mag, circular_id as circ_ord from ({FACTS})) qualify row_number() over (partition by obj_id, filter, mag order by circ_ord) = 1")
def fuse_photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _facts(spark, sf_dir).selectExpr("cast(cust as string) as obj_id", f"{BAND} as filter", "cast(mag_centi div 50 as bigint) as mag", "'AB' as mag_system", "60000.0 as obs_mjd", "cast(null as double) as flux", "circular_id as circ_ord", "0 as row_ord")
    return fusion.dedup_points(p).select("obj_id", "filter", "mag", "circ_ord")


@query(f"select circular_id, cust from ({FACTS}) f where not exists (select 1 from ({FACTS}) g where g.cust = f.cust and g.odd = 0)")
def retracted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    flags = f.join(circulars(spark, sf_dir), "circular_id").select("cust", S.is_retraction(F.col("subject")).alias("retraction"))
    return fusion.without_retracted(f.select("circular_id", "cust"), flags, "cust")



@query(f"select circular_id, {EVENT} as obj_id, 'optical' as kind, 'mjd' as reason from ({FACTS}) union all select circular_id, {EVENT}, 'radio', 'mjd' from ({FACTS}) where odd = 3")
def actions_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each measurement becomes downstream; without trigger times none can be posted yet."""
    return fusion.actions(_extracted(spark, sf_dir, "event", "localization", "photometry"), {"sdssr": 1, "NOT": 2}).select("circular_id", "obj_id", "kind", "reason")


@query(f"select circular_id, case when odd = 3 then 'mjd: 2' else 'mjd: 1' end as dropped from ({FACTS})")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.drop_reasons(fusion.actions(_extracted(spark, sf_dir, "event", "localization", "photometry"), {}))


@query("select l_orderkey, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey having count(distinct l_suppkey) = 1")
def instrument_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a whole table: orders that one supplier alone delivers."""
    return fusion.unique_instruments(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


_DEDUP = """with recursive e as (select user_id::varchar as obj_id, event_type as filter, epoch_us(ts) / 86400e6 as mjd from events),
o as (select *, row_number() over (partition by obj_id, filter order by mjd) as n from e),
k(obj_id, filter, n, mjd, last) as (select obj_id, filter, n, mjd, mjd from o where n = 1
  union all select o.obj_id, o.filter, o.n, o.mjd, case when o.mjd - k.last > 0.25 then o.mjd else k.last end from k join o on o.obj_id = k.obj_id and o.filter = k.filter and o.n = k.n + 1)
select obj_id, filter, mjd from k where mjd = last and not exists (select 1 from k p where p.obj_id = k.obj_id and p.filter = k.filter and p.n = k.n - 1 and p.last = k.last)"""


@query(_DEDUP)
def tolerant_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator's rule over a whole table."""
    e = _table(spark, sf_dir, "events")
    return consume.dedup_batch(e.select(F.col("user_id").cast("string").alias("obj_id"), F.col("event_type").alias("filter"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6)).alias("mjd")), 0.25)


_NB = """with w as (select label, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as u from (select doc_id, toxic::varchar as label, text from documents join labels using (doc_id))),
t as (select label, unnest(list_concat(u, list_transform(range(1, greatest(len(u), 1)), lambda i: concat(u[i], '_', u[i + 1])))) as token from w),
c as (select label, token, count(*)::bigint as c from t group by all),
v as (select token from c group by token having sum(c) >= 2),
k as (select c.* from c join v using (token))"""


@query(f"{_NB} select label, token, c from k")
def nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the classifier is fitted to: words and pairs that occur twice or more."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").cast("string").alias("label"), "text")
    return classify.counts(rows)


_NB_MODEL = f"""{_NB}, n as (select label, sum(c) as n from k group by label), s as (select count(*) as v from v),
p as (select label, round(ln(count(*) / sum(count(*)) over ()), 4) as prior from w group by label),
m as (select label, prior, round(ln(1.0::double / (n + v)), 4) as unknown from n cross join s join p using (label)),
f as (select label, token, round(ln((c + 1)::double / (n + v)), 4) as logp from k join n using (label) cross join s)"""


@query(f"""{_NB_MODEL}, d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as u from documents),
e as (select doc_id, unnest(list_concat(u, list_transform(range(1, greatest(len(u), 1)), lambda i: concat(u[i], '_', u[i + 1])))) as token from d),
z as (select doc_id, count(*) as n from e group by doc_id),
g as (select e.doc_id, f.label, sum(f.logp - m.unknown) as gain from e join f using (token) join m on m.label = f.label group by all),
r as (select d.doc_id, m.label, m.prior + coalesce(z.n, 0) * m.unknown + coalesce(g.gain, 0) as score from d cross join m left join z using (doc_id) left join g on g.doc_id = d.doc_id and g.label = m.label)
select doc_id, label as predicted from r qualify row_number() over (partition by doc_id order by round(score, 6) desc, label) = 1""")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes labels of all documents from a fit on the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("label")), "doc_id")
    scores = classify.score(docs, classify.fit(known), "doc_id")
    return classify.predict(scores.withColumn("score", F.round("score", 6)), "doc_id")


@query(f"{_NB_MODEL} select label, token, logp from f")
def nb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").cast("string").alias("label"), "text")
    return classify.fit(rows)["feature"]


@query(f"{_NB_MODEL} select label, prior, unknown from m")
def nb_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").cast("string").alias("label"), "text")
    model = classify.fit(rows)
    return model["prior"].withColumnRenamed("logp", "prior").join(model["default"].withColumnRenamed("logp", "unknown"), "label")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and perturbed predictions: some missing, some near, some far."""
    return _facts(spark, sf_dir).selectExpr(
        "circular_id", "case when odd = 0 then null else z_milli end as gold", "case when odd = 1 then null when odd < 5 then z_milli + 5 when odd = 5 then z_milli + 100 when odd = 0 then null else z_milli end as pred", "z_kind"
    )


_PAIRS = f"select circular_id, case when odd = 0 then null else z_milli end as gold, case when odd = 1 then null when odd < 5 and odd > 0 then z_milli + 5 when odd = 5 then z_milli + 100 when odd = 0 then (case when 0 < 5 then z_milli + 5 end) else z_milli end as pred, z_kind from ({FACTS})"
_OUTCOME = f"select circular_id, z_kind, case when gold is null and pred is null then 'TN' when gold is null then 'FP' when pred is null then 'FN' when abs(gold - pred) <= 10 then 'TP' else 'MM' end as outcome from ({_PAIRS})"


@query(f"select circular_id, outcome from ({_OUTCOME})")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("circular_id", evaluate.number_outcome(F.col("gold"), F.col("pred"), 10).alias("outcome"))


@query(f"""with c as (select z_kind, count(*) filter (where outcome = 'TP')::bigint as tp, count(*) filter (where outcome in ('FP', 'MM'))::bigint as fp, count(*) filter (where outcome in ('FN', 'MM'))::bigint as fn, count(*) filter (where outcome = 'TN')::bigint as tn from ({_OUTCOME}) group by z_kind),
r as (select *, case when tp + fp <> 0 then tp / (tp + fp) end as precision, case when tp + fn <> 0 then tp / (tp + fn) end as recall from c)
select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) end as f1, tp + fn as support from r""")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("z_kind", evaluate.number_outcome(F.col("gold"), F.col("pred"), 10).alias("outcome"))
    return evaluate.metrics(rows, "z_kind")


@query(f"""with recursive r as (select circular_id, line, {BAND} as filter, mag_centi / 100.0::double as mag, line % 3 as k from ({lines_sql(True)})),
g as (select circular_id, list({{'line': line, 'filter': filter, 'mag': mag}} order by line, filter, mag) as gold, list({{'line': line, 'filter': filter, 'mag': mag + k * 0.04::double}} order by line, filter, mag + k * 0.04::double) as pred from r group by circular_id),
m(circular_id, i, used, tp) as (select circular_id, 0, []::bigint[], 0 from g
  union all select circular_id, i + 1, case when j is null then used else list_append(used, j) end, tp + (j is not null)::int from (
    select m.circular_id, m.i, m.used, m.tp, list_filter(range(1, len(g.pred) + 1), lambda x: not list_contains(m.used, x) and g.pred[x].filter = g.gold[m.i + 1].filter and abs(g.gold[m.i + 1].mag - g.pred[x].mag) <= 0.05)[1] as j
    from m join g using (circular_id) where m.i < len(g.gold)) s)
select circular_id, tp, (len(pred) - tp)::int as fp, (len(gold) - tp)::int as fn from m join g using (circular_id) where i = len(gold)""")
def eval_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a bulletin matched one to one with shifted ones, greedily in order."""
    register(spark, sf_dir, "lineitem")
    rows = spark.sql(f"select circular_id, line, {BAND} as filter, mag_centi / 100.0D as mag, line % 3 as k from ({lines_sql(False)})")
    row = lambda m: F.struct("line", "filter", m.alias("mag"), F.lit(None).cast("double").alias("lim"))
    per = rows.groupBy("circular_id").agg(F.array_sort(F.collect_list(row(F.col("mag")))).alias("gold"), F.array_sort(F.collect_list(row(F.col("mag") + F.col("k") * 0.04))).alias("pred"))
    return per.select("circular_id", evaluate.greedy_matches(F.col("gold"), F.col("pred")).alias("m")).select("circular_id", "m.*")


@query("select event_type, list_sort(list(value))[len(list(value)) // 2 + 1] as p50, list_sort(list(value))[least(len(list(value)) - 1, len(list(value)) * 95 // 100) + 1] as p95 from events where value is not null group by event_type")
def telemetry_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(_table(spark, sf_dir, "events"), "event_type", "value")


@query("select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0) as spent from lineitem) where spent < 60")
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return evaluate.within_budget(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 60).select("l_orderkey", "l_linenumber")


@query("""with recursive d as (select doc_id, replace(text, chr(10), concat(chr(10), chr(10))) as t from documents),
p as (select doc_id, string_split(t, concat(chr(10), chr(10))) as ps from d where length(t) > 2000),
f(doc_id, i, now, k, done) as (select doc_id, 1, ps[1], 0, null::varchar from p
  union all select doc_id, i + 1, case when length(grown) > 1000 then concat(substr(now, greatest(length(now) - 99, 1), 100), chr(10), chr(10), q) else grown end,
    k + (length(grown) > 1000)::int, case when length(grown) > 1000 then now end
  from (select f.doc_id, f.i, f.now, f.k, p.ps[f.i + 1] as q, concat(f.now, chr(10), chr(10), p.ps[f.i + 1]) as grown from f join p using (doc_id) where f.i < len(p.ps)) s),
c as (select doc_id, 0 as k, t as chunk from d where length(t) <= 2000 union all select doc_id, k - 1, done from f where done is not null
  union all select f.doc_id, f.k, f.now from f join p using (doc_id) where f.i = len(p.ps))
select doc_id, k, length(chunk)::int as size, md5(chunk) as chunk_md5 from c""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as paragraphs, folded into overlapping chunks."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return d.select("doc_id", F.posexplode(labels.chunks(F.col("text"), 2000, 1000, 100)).alias("k", "chunk")).select("doc_id", "k", F.length("chunk").alias("size"), F.md5("chunk").alias("chunk_md5"))


@query(f"select circular_id, 'redshift.redshift' as path, concat('z = ', (z_milli // 1000)::varchar, '.', lpad((z_milli % 1000)::varchar, 3, '0')) as snippet from ({FACTS}) where odd <> 2")
def label_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = labels.label_view(_extracted(spark, sf_dir, "redshift"), {"redshift.redshift": "redshift.redshift"})
    return view.select("circular_id", "path", "snippet")


@query(f"select circular_id, 0::bigint as broken from ({FACTS})")
def span_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No provenance span differs from the text it points at."""
    told = _extracted(spark, sf_dir).select("circular_id", "provenance").join(circulars(spark, sf_dir).select("circular_id", "body"), "circular_id")
    found = told.select("circular_id", "body", F.explode("provenance").alias("path", "span")).select("circular_id", "body", "span.*")  # bulletins meet their texts, not spans
    text = F.substring(F.col("body"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.groupBy("circular_id").agg(F.sum(F.when(text == F.col("snippet"), 0).otherwise(1)).alias("broken"))


@query(f"select circular_id, {EVENT} as primary_event, case when odd <> 2 then z_milli / 1000.0 end as redshift from ({FACTS})")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows after the same extractions came in twice."""
    found = events.settled(_extracted(spark, sf_dir, "event", "redshift"))
    kept = store.put(store.rows(found, 1), store.rows(found, 2))
    return kept.select("circular_id", "primary_event", F.col("record.redshift.redshift").alias("redshift"))


@query("select a.n_nationkey, a.n_name, count(*)::bigint as customers from nation a join customer on c_nationkey = n_nationkey group by all having count(*) > 1")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("customers")).filter("customers > 1")


@query(f"select circular_id, {EVENT} as event from ({FACTS}) where event = (select event from ({FACTS}) order by circular_id desc limit 1)")
def event_circulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bulletins of the event that the last order names."""
    event = _facts(spark, sf_dir).orderBy(F.desc("circular_id")).select("event").first().event
    c = circulars(spark, sf_dir)
    return search.event_circulars(c, upsert.event_bridge(c), event).select("circular_id", F.lit(event.replace(" ", "")).alias("event"))


# Written names and their classes, read off the taxonomy by hand.
SPELT = {
    "sn ia": "Ia", "ia-p": "Ia", "1991t-like": "Ia-91T", "2002cx-like": "Ia-02cx", "super chandra": "Ia-03fg", "hypernova": "Ic-BL", "slsn-i": "Ic-SLSN", "slsn ii": "II-SLSN", "snii": "II-norm",
    "sn ii-l": "IIL", "tde": "Tidal Disruption Event", "sso": "Solar System Object", "kn": "kilonova", "ns-ns": "DNS", "xrf": "X-ray Flash", "lgrb": "long GRB", "felt": "FBOT", "lrn": "Luminous Red Nova",
    "psr": "Pulsar", "flare star": "UV Ceti", "lbv": "S Doradus", "w uma": "W Ursae Maj", "beta per": "Algol", "rrab": "RRab", "ogle small-amplitude red giant": "OSARG", "cwb": "BL Her", "53 persei": "SPB",
    "lens with planet": "lens with planet", "qso": "QSO", "gravitational lensing": "gravitational lensing",
}
_ALIASES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(SPELT.values()))


@query(f"select c_custkey, t.n as canonical from customer join (values {_ALIASES}) t(k, n) on t.k = c_custkey % {len(SPELT)}")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written class names (here dealt to customers) to canonical ones through the alias table."""
    aliases = readers.taxonomy_tables(spark)[0]
    spelt = F.array(*map(F.lit, SPELT))
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.get(spelt, (F.col("c_custkey") % len(SPELT)).cast("int")).alias("alias_lower"))
    return c.join(F.broadcast(aliases), "alias_lower").select("c_custkey", "canonical")  # the taxonomy is of fixed size


FLAGSHIP = "redshift_of_events"
