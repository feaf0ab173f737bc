"""Further registered queries: one for each operator that the main ones don't reach, with SQL that states its result.

Bulletins are written from the order tables' columns, so that the SQL knows what must be found without reading a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import classify, evaluate, events, extract, fusion, labels, sampling, store, tools, upsert
from ..sources import writers
from ..synth import circulars, circulars_sql, facts
from .queries import BAND, EVENT, FACTS, UNIT, _extracted, _facts, _table, query


def _pick(rows: DataFrame, texts: list[str], key: str = "circular_id") -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def _case(values: list, key: str = "circular_id", kind: str = "varchar") -> str:
    """SQL for the value that a row's key picks; null for None."""
    quoted = ["null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"cast(case {key} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(quoted)) + f" end as {kind})"


def _written(spark: SparkSession, sf_dir: str, texts: list[str], subject: str = "") -> DataFrame:
    rows = facts(spark, sf_dir)
    return rows.select("circular_id", F.lit(subject).alias("subject"), _pick(rows, texts).alias("body"), F.lit(None).cast("string").alias("event_id"))


# Each form of event name as written, and as it is known.
NAMED = [
    ("GRB 240101A", "GRB240101A"), ("EP240617a", "EP240617A"), ("AT 2024abc", "AT2024ABC"), ("SN2020xyz", "SN2020XYZ"), ("AT 99B", "AT99B"), ("SN 87A", "SN87A"), ("ZTF18abc", "ZTF18ABC"),
    ("ATLAS 24xyz", "ATLAS24XYZ"), ("ASASSN-15lh", "ASASSN-15LH"), ("PS15ae", "PS15AE"), ("Pan-STARRS 12sk", "PAN-STARRS12SK"), ("GOTO24ab", "GOTO24AB"), ("IceCube-170922A", "ICECUBE-170922A"),
    ("Swift J1644.3+57", "SWIFTJ1644.3+57"), ("GW 170817", "GW170817"),
]


@query(f"select circular_id, {_case([n for _, n in NAMED])} as event_norm, true as is_primary from ({FACTS})")
def event_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.event_bridge(_written(spark, sf_dir, [f"We saw {w} last night." for w, _ in NAMED]))


@query(f"select circular_id, {_case([n for _, n in NAMED])} as event from ({FACTS})")
def event_forms_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the span-bearing parser."""
    found = extract.extract(_written(spark, sf_dir, [f"We saw {w} last night." for w, _ in NAMED]), fields=("event",))
    return found.select("circular_id", F.get("event.event_name", F.lit(0)).alias("event"))


@query(f"select circular_id, unnest(['GRB240101A', 'AT2024ABC']) as event_norm, unnest([true, false]) as is_primary from ({FACTS})")
def event_names_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.event_bridge(_written(spark, sf_dir, ["GRB 240101A is AT2024abc; grb240101a it is."], ""))


@query(f"select circular_id as src, unnest([circular_id + 1, 7, circular_id + 5]) as dst, unnest([0, 1, 2]) as pos from ({FACTS}) where circular_id + 1 <> 7 and circular_id + 5 <> 7")
def xref_edges_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = lambda k: F.concat(F.lit("GCN Circ. #"), (F.col("circular_id") + k).cast("string"))
    body = F.concat(F.lit("See "), cite(1), F.lit(", GCN 7 and gcn circular 7; "), cite(1), F.lit(" and "), cite(5), F.lit("."))
    rows = _facts(spark, sf_dir).select("circular_id", body.alias("body")).filter("circular_id not in (2, 6)")
    return fusion.xref_edges(rows)


CLAIMS = [("It is an X-ray flash.", "X-ray Flash", "XRF"), ("It could be classified as an XRF.", "X-ray Flash", "XRF candidate"), ("XRF 030723 was near.", None, None), ("There is no evidence that it was an XRF.", None, None)]


@query(f"select circular_id, {_case([k for _, k, _ in CLAIMS])} as classification, {_case([s for *_, s in CLAIMS])} as subtype from ({FACTS})")
def flash_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(_written(spark, sf_dir, [c for c, *_ in CLAIMS]), fields=("classification",))
    kind = F.when(F.col("classification.subtype").isNotNull(), F.col("classification.classification"))
    return found.select("circular_id", kind.alias("classification"), F.col("classification.subtype").alias("subtype"))


FLARES = [("The trigger was a stellar flare.", "UV Ceti"), ("The transient is probably due to a stellar flare.", "UV Ceti"), ("There is no evidence of a trigger due to a stellar flare.", None), ("A flaring star lies nearby.", None)]


@query(f"select circular_id, {_case([k for _, k in FLARES])} as classification, {_case([None, 'UV Ceti candidate', None, None])} as subtype from ({FACTS})")
def flare_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(_written(spark, sf_dir, [c for c, _ in FLARES]), fields=("classification",))
    return found.select("circular_id", "classification.classification", "classification.subtype")


SCOPES = [("images from Keck", "Keck", "Keck"), ("seen with the Nordic Optical Telescope", "Nordic Optical Telescope", "NOT"), ("it was not seen again", None, None), ("using the 3.6m Devasthal telescope", "3.6m Devasthal", None)]


@query(f"select circular_id, {_case([t for _, t, _ in SCOPES])} as telescope, {_case([c for *_, c in SCOPES])} as telescope_canonical from ({FACTS})")
def telescopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(_written(spark, sf_dir, [f"r = 18.50 +/- 0.10, {t}." for t, *_ in SCOPES]), fields=("photometry",))
    return extract.photometry_rows(found).select("circular_id", "telescope", "telescope_canonical")


LIMITS = ["In the r-band we place a 3-sigma upper limit of {} mag.", "With the g filter, we derive an upper limit of about {} mag.", "To a 5-sigma upper limit in r:\n r = {} it is not seen.", "Upper limits: R = {} and more."]
_LIMIT = "(mag_centi // 10) / 10.0"


@query(f"select circular_id, {_case(['r', 'g', 'r', 'R'])} as filter, cast({_LIMIT} as double) as limiting_mag, cast({_case([3, None, 5, None], kind='double')} as double) as sigma from ({FACTS})")
def limits_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)
    value = F.concat(F.expr("mag_centi div 100").cast("string"), F.lit("."), F.expr("(mag_centi div 10) % 10").cast("string"))
    body = F.replace(_pick(rows, LIMITS), F.lit("{}"), value)
    found = extract.extract(rows.select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("photometry",))
    return extract.photometry_rows(found).select("circular_id", "filter", "limiting_mag", F.col("limiting_mag_sigma").alias("sigma"))


OTHERS = ["The host galaxy is red.\n\nr = {}.", "The host galaxy has r = {} in images\n\nof old.", "A comparison star of R = {} is near.", "(trigger No 740430582, 22h 48m, R={}) errorbox", "The reference star was faint. r = {} +/- 0.10"]


@query(f"select circular_id, 'r' as filter, mag_centi / 100.0 as mag from ({FACTS}) where circular_id % 5 in (0, 4)")
def mags_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of other objects are none of the transient's; a sentence ends them, a blank line doesn't."""
    rows = _facts(spark, sf_dir)
    value = F.concat(F.expr("mag_centi div 100").cast("string"), F.lit("."), F.lpad((F.col("mag_centi") % 100).cast("string"), 2, "0"))
    found = extract.extract(rows.select("circular_id", F.lit("").alias("subject"), F.replace(_pick(rows, OTHERS), F.lit("{}"), value).alias("body")), fields=("photometry",))
    return extract.photometry_rows(found).select("circular_id", "filter", "mag")


SYSTEMS = ["r = 18.50 (AB)", "r = 18.50 in the Vega system", "R = 18.50", "r = 18.50, all magnitudes are in the AB system, not in Vega magnitudes"]


@query(f"select circular_id, {_case(['AB', 'Vega', 'Vega', 'AB'])} as mag_system from ({FACTS})")
def stated_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(_written(spark, sf_dir, SYSTEMS), fields=("photometry",))
    return extract.photometry_rows(found).select("circular_id", "mag_system")


FORMS = [("T+{}s", 1, "s", "T+"), ("T-{} min", -1, "m", "T-"), ("T-T0 = {}h", 1, "h", "trigger"), ("{} days post-burst", 1, "d", "trigger"), ("a mid-time of {} ks", 1000, "s", "trigger")]


@query(f"select circular_id, (t_off * {_case([k for _, k, *_ in FORMS], kind='double')})::double as value, {_case([u for *_, u, _ in FORMS])} as unit, {_case([r for *_, r in FORMS])} as reference from ({FACTS})")
def offset_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)
    body = F.concat(F.lit("Images at "), F.replace(_pick(rows, [f for f, *_ in FORMS]), F.lit("{}"), F.col("t_off").cast("string")), F.lit(" were taken."))
    found = extract.extract(rows.select("circular_id", F.lit("").alias("subject"), body.alias("body")), fields=("time_offsets",))
    return found.select("circular_id", F.explode("time_offsets").alias("o")).select("circular_id", "o.*")


DATES = ["We observed on August 18.5 2017.", "Observations began on 18.5 August 2017.", "Imaging was obtained at 12:00 UT on 2017-08-18.", "On 2017 Aug 18.5 UT, we observed the field.", "It was seen on 18 August."]


@query(f"select circular_id, {_case(['2017-08-18T12:00:00Z'] * 4 + [None])} as obs_time from ({FACTS})")
def epoch_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal days and clock times in every order of a date; a date without a year is none."""
    found = extract.extract(_written(spark, sf_dir, [f"{d}\nr = 18.50 +/- 0.10" for d in DATES]), fields=("photometry",))
    return extract.photometry_rows(found).select("circular_id", "obs_time")


@query("select event_id, epoch_us(ts) / 86400e6 + 40587 as mjd from events")
def mjd_of_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.mjd(F.col("ts").cast("timestamp")).alias("mjd"))


@query(f"select circular_id, round(flux * 1e-16 / ((10.0::double - 0.5) / 4.135667696e-18) / 1e-29, 9) as ujy from ({FACTS})")
def energy_to_ujy(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.array(F.lit(0.5), F.lit(10.0))
    return _facts(spark, sf_dir).select("circular_id", F.round(S.energy_to_ujy(F.col("flux") * F.lit(1e-16), band), 9).alias("ujy"))


@query("select l_orderkey, l_linenumber, (l_partkey * 3.0::double + l_suppkey * 15.0::double) / 1e6 as cost from lineitem")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.cost(F.col("l_partkey"), F.col("l_suppkey"), 3.0, 15.0).alias("cost"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = circulars(spark, sf_dir, "day").withColumn("trigger_time", F.to_timestamp("day"))
    return extract.extract(dated, fields=("event", "photometry"))


_REASON = "case when odd = 1 then 'mjd' when band = 4 then 'instrument' end"


@query(f"""select circular_id, 'optical' as kind, {_REASON} as reason, null::double as flux, null::double as flux_error, case when band in (1, 2, 3) then band end::double as instrument_id, mag_centi / 100.0 as limit_mag, odd <> 1 as limiting_mag_assumed from ({FACTS})
union all select circular_id, 'radio', case ghz_k when 2 then 'instrument' end, flux::double, 5.0::double, case ghz_k when 0 then 6 when 1 then 10 end::double, null, false from ({FACTS}) where odd = 3""")
def actions_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with times: what becomes of their fluxes, errors, limits and instruments, and why others are dropped."""
    found = _dated(spark, sf_dir)
    bare = found.withColumn("photometry", F.transform("photometry", lambda p: p.withField("telescope_canonical", F.lit(None).cast("string"))))
    acted = fusion.actions(bare, {"sdssr": 1, "sdssg": 2, "bessellr": 3, "radio-6GHz": 6, "radio-10GHz": 10})
    return acted.select("circular_id", "kind", "reason", "flux", "flux_error", F.col("instrument_id").cast("double").alias("instrument_id"), "limit_mag", "limiting_mag_assumed")


@query(f"select circular_id, case when odd = 1 then 'mjd: 1' when odd = 3 and band = 4 and ghz_k = 2 then 'instrument: 2' when band = 4 or (odd = 3 and ghz_k = 2) then 'instrument: 1' end as dropped from ({FACTS}) where odd = 1 or band = 4 or (odd = 3 and ghz_k = 2)")
def drop_reasons_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dated(spark, sf_dir)
    bare = found.withColumn("photometry", F.transform("photometry", lambda p: p.withField("telescope_canonical", F.lit(None).cast("string"))))
    return fusion.drop_reasons(fusion.actions(bare, {"sdssr": 1, "sdssg": 2, "bessellr": 3, "radio-6GHz": 6, "radio-10GHz": 10}))


@query(f"select circular_id, {EVENT} as obj_id, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec, null::double as error from ({FACTS})")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.source_rows(_extracted(spark, sf_dir, "event", "localization"))


@query("""with s as (select c_custkey::varchar as obj_id from customer where c_custkey % 3 <> 0), p as (select c_custkey::varchar as obj_id, row_number() over () as k from customer)
select obj_id, 0 as seq, 'POST' as method, '/api/sources' as path from s union all select obj_id, 1, 'POST', '/api/photometry' from s
union all select obj_id, 2, 'PATCH', concat('/api/sources/', obj_id) from s""")
def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each source, point and redshift of objects that have a source."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("obj_id"), F.col("c_acctbal").alias("x"), "c_custkey")
    sources = c.filter("c_custkey % 3 <> 0").select("obj_id", F.col("x").alias("ra"))
    plan = writers.post_plan(sources, c.select("obj_id", F.col("x").alias("mag")), c.select("obj_id", F.col("x").alias("redshift")), c.limit(0).select("obj_id", F.col("x").alias("text")))
    return plan.select("obj_id", "seq", "method", "path")


_FIRST = f"(select event from ({FACTS}) order by circular_id limit 1)"


def _context(spark: SparkSession, sf_dir: str) -> tuple[tools.Context, str]:
    name = _facts(spark, sf_dir).orderBy("circular_id").select("event").first().event
    return tools.Context(spark, circulars(spark, sf_dir)), name


@query(f"select {EVENT} as event, z from (select event, z_milli / 1000.0 as z, circular_id from ({FACTS}) where event = {_FIRST} and odd <> 2 order by circular_id limit 1)")
def tool_redshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, name = _context(spark, sf_dir)
    return tools.get_redshift(ctx, name).select(F.lit(name.replace(" ", "")).alias("event"), F.col("redshift.redshift").alias("z")).filter("z is not null")


@query(f"select circular_id, {BAND} as filter from ({FACTS}) where event = {_FIRST}")
def tool_photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, name = _context(spark, sf_dir)
    return tools.get_photometry(ctx, name).filter("filter is not null").select("circular_id", "filter")


@query("select null::varchar as classification")
def tool_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, name = _context(spark, sf_dir)
    return tools.get_classification(ctx, name).select("classification.classification")


@query(f"select circular_id, cites::varchar as cited from ({FACTS}) where event = {_FIRST}")
def tool_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, name = _context(spark, sf_dir)
    return tools.find_counterparts(ctx, name).select("circular_id", F.element_at("follow_up.reference", "gcn_circulars").alias("cited"))


@query(f"select circular_id, ra_milli / 1000.0 as ra from ({FACTS}) where abs(dec_milli + 83500) <= 100 and abs(ra_milli - 1000) <= 600 and circular_id in (select circular_id from ({FACTS}) where ra_milli = 1000 and dec_milli = -83500) order by circular_id limit 50")
def tool_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _context(spark, sf_dir)
    return tools.search_by_position(ctx, 1.0, -83.5, 1.0).select("circular_id", "ra")


@query(f"select circular_id, z_milli / 1000.0 as z from ({FACTS}) where circular_id = (select min(circular_id) from ({FACTS}) where odd <> 2)")
def tool_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _context(spark, sf_dir)
    first = _facts(spark, sf_dir).filter("odd <> 2").agg(F.min("circular_id").alias("m")).first().m
    tools.extract_properties(ctx, first)
    return tools.extract_properties(ctx, first).select("circular_id", F.col("redshift.redshift").alias("z"))


@query("select 7::bigint as circular_id, 1.5::double as z, 'GRB240101A' as event")
def tool_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.extract_text(tools.Context(spark, circulars(spark, sf_dir)), "GRB 240101A lies at z = 1.5.", 7)
    return found.select("circular_id", F.col("redshift.redshift").alias("z"), F.get("event.event_name", F.lit(0)).alias("event"))


@query(f"with c as ({circulars_sql(True)}) select circular_id, body from c where circular_id in (3, 5, 1)")
def tool_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _context(spark, sf_dir)
    return tools.fetch_gcn_circulars(ctx, [5, 1, -4, 3]).select("circular_id", "body")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'TN' when c_custkey % 4 = 1 then 'FP' when c_custkey % 4 = 2 then 'FN' when c_custkey % 8 = 3 then 'TP' else 'MM' end as outcome from customer")
def eval_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names agree if they share one."""
    c = _table(spark, sf_dir, "customer").select("c_custkey")
    pick = lambda *xs: F.when(F.col("c_custkey") % 4 == 0, F.lit(xs[0])).when(F.col("c_custkey") % 4 == 1, F.lit(xs[1])).when(F.col("c_custkey") % 4 == 2, F.lit(xs[2]))
    gold = F.split(pick(None, None, "a,b").otherwise("a,b"), ",")
    pred = F.split(pick(None, "a", None).otherwise(F.when(F.col("c_custkey") % 8 == 3, "c,b").otherwise("c")), ",")
    return c.select("c_custkey", evaluate.names_outcome(gold, pred).alias("outcome"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'TP' else 'MM' end as outcome from customer")
def eval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    gold = F.concat(F.lit("  Nordic   "), F.col("c_mktsegment"))
    pred = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nordic "), F.lower("c_mktsegment"), F.lit(" "))).otherwise("other")
    return c.select("c_custkey", evaluate.text_outcome(gold, pred).alias("outcome"))


@query("select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by event_id)::int as rank from events where event_id % 3 <> 0) where rank <= 5")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 3 == 0, "TP").when(F.col("event_id") % 3 == 1, "FP").otherwise("MM").alias("outcome"))
    return evaluate.first_failures(e, "event_type", "event_id").select("event_type", "event_id", "rank")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders where o_custkey % 2 = 0 group by o_custkey")
def eval_join_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the last gold of their key; gold alone and predictions alone go."""
    gold = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ord"))
    pred = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).filter("o_custkey % 2 = 0")
    return evaluate.join_gold(pred, gold, "o_custkey")


@query(f"select circular_id, case when odd <= 5 then 1 else 0 end as tp, case when odd > 5 then 1 else 0 end as fp, case when odd > 5 then 1 else 0 end as fn from ({FACTS})")
def eval_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda shift: F.array(F.struct((F.col("t_off") + shift).cast("double").alias("value"), F.expr(UNIT).alias("unit")))
    shift = F.when(F.col("odd") <= 5, F.col("odd") / 10).otherwise(F.lit(3))
    return _facts(spark, sf_dir).select("circular_id", evaluate.greedy_offsets(row(F.lit(0)), row(shift)).alias("m")).select("circular_id", "m.*")


@query("""with r as (select case when quality = 1 then 'Ia' end as g, case when doc_id % 3 = 0 then 'Ia' when doc_id % 3 = 1 then 'Ib' end as p from labels),
c as (select count(*) filter (where g = p)::bigint as tp, count(*) filter (where p is not null and g is distinct from p)::bigint as fp, count(*) filter (where g is not null and g is distinct from p)::bigint as fn from r),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from c)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from m""")
def eval_binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "Ia").alias("g"), F.when(F.col("doc_id") % 3 == 0, "Ia").when(F.col("doc_id") % 3 == 1, "Ib").alias("p"))
    return evaluate.binary_f1(rows, "g", "p")


@query("select event_type, count(*)::bigint as calls, sum(user_id)::bigint as tokens_in, coalesce(sum(case when event_id % 2 = 0 then event_id end), 0)::bigint as tokens_out, 0::bigint as cost_usd from events group by event_type")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("tokens_in"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("tokens_out"), F.lit(0).cast("long").alias("cost_usd"))
    return evaluate.usage(e, "event_type")


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) filter (where o_orderkey % 3 <> 0) as o_orderpriority from orders group by o_custkey")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return fusion.first_value(o, "o_custkey", "o_orderpriority", "o_orderkey")


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) filter (where o_orderkey % 3 <> 0) as o_orderpriority, arg_min(o_orderstatus, o_orderkey) filter (where o_orderkey % 2 = 0) as o_orderstatus from orders group by o_custkey")
def merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), "o_orderstatus": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))})
    return labels.merge_scalars(o, "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")


@query(f"select cust, {BAND} as filter, (mag_centi // 100)::double as mag, min(circular_id) as circular_id from ({FACTS}) group by all")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:


    fields = schemas.struct(f"x {schemas.PHOTOMETRY}")["x"].dataType.fields
    known = {"filter": F.expr(BAND), "mag": F.expr("cast(mag_centi div 100 as double)")}
    rows = _facts(spark, sf_dir).select("cust", "circular_id", *(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))
    return labels.merge_rows(rows, "cust", "circular_id").select("cust", "filter", "mag", "circular_id")


@query(f"select cust, string_agg(distinct {UNIT}, ',' order by {UNIT}) as units, count(distinct t_unit)::int as n from ({FACTS}) where odd <> 1 group by cust")
def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time offsets of a customer's bulletins as if they were chunks of one: each once."""
    unit = F.expr(UNIT)
    facts = _facts(spark, sf_dir).filter("odd <> 1")
    offset = F.array(F.struct(F.lit(1.0).alias("value"), unit.alias("unit"), F.lit("trigger").alias("reference")))
    none = F.create_map().cast(f"map<string,{schemas.SPAN}>")
    rows = facts.select("cust", "circular_id", offset.alias("time_offsets"), none.alias("provenance"), F.struct(F.array(F.lit("note")).alias("notes")).alias("extraction_meta"))
    merged = labels.merge_lists(rows, "cust", "circular_id")
    return merged.select("cust", F.array_join(F.array_sort(F.transform("time_offsets", lambda o: o.unit)), ",").alias("units"), F.size("time_offsets").alias("n"))


@query(f"select circular_id, case when odd <> 2 and z_kind <> 0 then 9.0 when odd <> 2 then z_milli / 1000.0 end::double as redshift, ra_milli / 1000.0 as ra, 0::int as n_offsets, odd = 0 as retraction from ({FACTS})")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field the source that the routing table names: here a model that knows other redshifts, no position and no offset."""
    regex = events.settled(_extracted(spark, sf_dir, "localization", "time_offsets", "redshift", "retraction")).hint("merge")
    kinds = _facts(spark, sf_dir).select("circular_id", "z_kind")
    model = regex.join(kinds, "circular_id").withColumns({
        "redshift": F.when(F.col("z_kind") != 0, F.col("redshift").withField("redshift", F.lit(9.0))), "localization": F.col("localization").withField("ra", F.lit(0.0)),
        "time_offsets": F.filter("time_offsets", lambda x: F.lit(False)),
    }).drop("z_kind")
    out = labels.route(regex, model)
    return out.select("circular_id", F.col("redshift.redshift").alias("redshift"), F.col("localization.ra").alias("ra"), F.size("time_offsets").alias("n_offsets"), "retraction")


@query(f"select circular_id, case when odd = 3 then 2 else 1 end::int as n_rows, 'Keck' as telescope, 60000.0::double as obs_mjd from ({FACTS})")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's record mended: prose bands come back as parsed rows, a run-on telescope goes, the stated epoch replaces."""
    found = events.settled(_extracted(spark, sf_dir, "photometry").select("circular_id", "photometry", "classification")).hint("merge")
    regex = found.withColumn("photometry", F.transform("photometry", lambda p: p.withField("telescope", F.lit("Keck"))))
    worded = lambda p: F.when(p["frequency_ghz"].isNotNull(), p.withField("filter", F.lit("6 GHz")).withField("bandpass", F.lit(None).cast("string")).withField("frequency_ghz", F.lit(None).cast("double"))).otherwise(p)
    bad = lambda p: worded(p).withField("telescope", F.lit("Keck VLT Keck")).withField("obs_mjd", F.lit(1.0))
    model = regex.withColumn("photometry", F.transform("photometry", bad))
    stated = regex.select("circular_id", F.lit("x").alias("telescope"), F.lit(60000.0).alias("mjd"), F.lit("t").alias("time"))
    out = labels.repair(model, regex, stated).select("circular_id", F.size("photometry").alias("n_rows"), F.get("photometry", F.lit(0)).alias("p"))
    return out.select("circular_id", "n_rows", "p.telescope", "p.obs_mjd")


@query(f"select circular_id, case when z_kind = 0 then 'a' else 'b' end as stratum from ({FACTS})")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of the strata's list; unknown strata last."""
    return sampling.listed(_facts(spark, sf_dir).select("circular_id", F.when(F.col("z_kind") == 0, "a").otherwise("b").alias("stratum")), "circular_id")


@query(f"select circular_id from ({FACTS}) where odd <> 2 or z_kind = 0")
def with_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).select("circular_id", "z_kind", "odd")
    found = _extracted(spark, sf_dir, "redshift").join(f, "circular_id").withColumn("localization", F.when(F.col("z_kind") == 0, F.struct(F.lit(1.0).alias("ra"))))
    return sampling.has_signal(found).select("circular_id")


@query(f"select circular_id, odd <> 2 as has_redshift, true as has_body from ({FACTS})")
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sampling.chat_examples(circulars(spark, sf_dir), _extracted(spark, sf_dir, "redshift"), "Read this.")
    value = F.get_json_object("target", "$.redshift.redshift")
    return made.select("circular_id", value.isNotNull().alias("has_redshift"), F.col("prompt").contains("We observed").alias("has_body"))


@query("select doc_id, (row_number() over (order by doc_id) - 1)::bigint as rank from documents")
def ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.ranked(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("""with l as (select doc_id, case when toxic = 1 then 'T' else 'NONE' end as label from labels where doc_id % 10 <> 0),
p as (select greatest(1, 2 * count(*)) as most from l where label = 'T'), n as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from l where label = 'NONE'),
s as (select doc_id, r, most, greatest(1, n // most) as step from n, p)
select doc_id, 'T' as label from l where label = 'T' union all select doc_id, 'NONE' from s where r % step = 0 and r < step * most""")
def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: all with a type, and by stride twice as many without; every tenth id is held out."""
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("circular_id"), F.lit("").alias("subject"), F.lit("").alias("body"), "toxic")
    made = classify.harvest(rows, F.when(F.col("toxic") == 1, "T").otherwise(classify.NONE), rows.filter("circular_id % 10 = 0"), ratio=2)
    return made.select(F.col("circular_id").alias("doc_id"), "label")


@query(f"select circular_id, case when circular_id % 2 = 0 then 'z = ' else 'GRB' end as snippet, case when circular_id % 2 = 0 then 0 else 20 end as start from ({FACTS})")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a text has exactly once get their place."""
    even = F.col("circular_id") % 2 == 0
    rows = _facts(spark, sf_dir).select("circular_id", F.when(even, "z = 1, z is z").otherwise("nothing here but no GRB").alias("body"), F.when(even, "z = ").otherwise("GRB").alias("v"))
    return rows.select("circular_id", labels.backfill_span(F.col("body"), F.col("v")).alias("s")).select("circular_id", "s.snippet", "s.start")


IDS = [("12", "12", 12), ("12.0", "12", 12), (" 43493 ", "43493", 43493), ("-4.0", "-4", -4), ("x7", "x7", None), ("1.5", "1.5", None)]


@query(f"select c_custkey, {_case([r for _, r, _ in IDS], 'c_custkey')} as raw, {_case([n for *_, n in IDS], 'c_custkey', 'double')} as number, {_case([n if n and n > 0 else None for *_, n in IDS], 'c_custkey', 'double')} as positive from customer")
def ids_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey")
    x = _pick(c, [w for w, *_ in IDS], "c_custkey")
    raw, number = S.id_parts(x)
    return c.select("c_custkey", raw.alias("raw"), number.cast("double").alias("number"), S.positive_id(x).cast("double").alias("positive"))


WORDS = [(" n/a ", None, "n/a"), ("None", None, "none"), ("GRB240101A", "GRB240101A", "grb240101a"), ("-", None, "-"), (" Nordic\t Telescope", "Nordic\t Telescope", "nordic telescope"), ("200101A", "200101A", "200101a")]
_TAB = "concat('Nordic', chr(9), ' Telescope')"


@query(f"select c_custkey, {_case([k for _, k, _ in WORDS], 'c_custkey')} as kept, {_case([e for *_, e in WORDS], 'c_custkey')} as folded, {_case(['n/a', 'None', 'GRB 240101A', '-', 'Nordic@ Telescope', 'GRB 200101A'], 'c_custkey')} as named from customer".replace("'Nordic@ Telescope'", _TAB).replace("'Nordic\t Telescope'", _TAB))
def words_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey")
    x = _pick(c, [w for w, *_ in WORDS], "c_custkey")
    return c.select("c_custkey", S.or_nothing(x).alias("kept"), S.eval_text(x).alias("folded"), S.grb_name(x).alias("named"))


@query(f"select count(*)::bigint as n, count(distinct circular_id)::bigint as ids from ({FACTS})")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.put(None, events.settled(store.rows(_extracted(spark, sf_dir, "event"), 1)))
    return kept.agg(F.count(F.lit(1)).alias("n")).join(store.circular_ids(kept, "regex").agg(F.count(F.lit(1)).alias("ids")), how="full")


@query(f"select circular_id, 1::bigint as created_at from ({FACTS}) where event = {_FIRST}")
def store_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _facts(spark, sf_dir).orderBy("circular_id").select("event").first().event
    return store.by_event(store.put(None, store.rows(_extracted(spark, sf_dir, "event"), 1)), name, "regex").select("circular_id", "created_at")


@query(f"select circular_id, 'redshift_measure' as problem from ({FACTS}) where odd = 4 union all select circular_id, 'mag_system' from ({FACTS}) where odd = 5 union all select circular_id, 'time_unit' from ({FACTS}) where odd = 6")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are no longer of the closed vocabularies, and what is wrong with them."""
    odd = _facts(spark, sf_dir).select("circular_id", "odd")
    found = _extracted(spark, sf_dir, "time_offsets", "photometry", "classification", "redshift").join(odd, "circular_id").withColumns({
        "redshift": F.when(F.col("odd") == 4, F.col("redshift").withField("redshift_measure", F.lit("guessed"))).otherwise(F.col("redshift")),
        "photometry": F.transform("photometry", lambda p: F.when(F.col("odd") == 5, p.withField("mag_system", F.lit("ST"))).otherwise(p)),
        "time_offsets": F.transform("time_offsets", lambda o: F.when(F.col("odd") == 6, o.withField("unit", F.lit("y"))).otherwise(o)),
    })
    return found.select("circular_id", F.explode(schemas.problems(["GRB"])).alias("problem"))


FUSED = ("event", "localization", "photometry", "redshift", "retraction")  # what fusion reads of a record
_FLURRY = f"""select 4 * circular_id as id0, ra_milli, dec_milli, z_milli, odd, mag_centi from ({FACTS})"""


def _flurry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bulletins an order: a coarse trigger, a counterpart with a photometric redshift, and a spectrum or a retraction."""
    f = facts(spark, sf_dir).withColumn("i", 4 * F.col("circular_id"))
    milli = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.floor(F.abs(F.col(c)) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(F.col(c)) % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("GRB 240101"), F.chr(65 + F.col("circular_id") % 26))
    cite = lambda k: F.concat(F.lit(" See GCN "), (F.col("i") + k).cast("string"), F.lit("."))
    coarse = F.concat(F.lit("Fermi-GBM triggered. RA = 1.500, Dec = 2.500."), cite(1))
    mag = F.concat(F.floor(F.col("mag_centi") / 100).cast("string"), F.lit("."), F.lpad((F.col("mag_centi") % 100).cast("string"), 2, "0"))
    sharp = F.concat(F.lit("The optical counterpart is at RA = "), milli("ra_milli"), F.lit(", Dec = "), milli("dec_milli"), F.lit(". We observed on 2024-01-02 00:00:00. r = "), mag, F.lit(" +/- 0.10. A photometric redshift of 0.25 holds."), cite(2))
    last = F.concat(F.lit("Spectroscopic data, observed on 2024-01-03 00:00:00, give z = "), milli("z_milli"), F.lit(". g = 19.50 +/- 0.10."), cite(1))
    gone = F.concat(F.lit("It was noise."), cite(1))
    bulletins = F.array(
        F.struct((F.col("i")).alias("circular_id"), F.concat(name, F.lit(": detection")).alias("subject"), coarse.alias("body")),
        F.struct((F.col("i") + 1).alias("circular_id"), F.concat(name, F.lit(": counterpart")).alias("subject"), sharp.alias("body")),
        F.struct((F.col("i") + 2).alias("circular_id"), F.when(F.col("odd") == 0, F.concat(F.lit("Retraction of "), name)).otherwise(F.concat(name, F.lit(": spectrum"))).alias("subject"), F.when(F.col("odd") == 0, gone).otherwise(last).alias("body")),
    )
    rows = f.select(F.explode(bulletins).alias("b")).select("b.*")
    return rows.withColumns({"event_id": F.lit(None).cast("string"), "created_on": F.col("circular_id")})


@query(f"""select id0 as seed, ra_milli / 1000.0 as ra, dec_milli / 1000.0 as dec, case when odd = 0 then 0.25 else z_milli / 1000.0 end::double as redshift, case when odd = 0 then 0 else 2 end::bigint as n_points,
case when odd = 0 then (id0 + 2)::varchar else '' end as withdrawn, 'posted' as status from ({_FLURRY})""")
def fuse_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trigger's event by two hops of citations: the counterpart's position, the spectrum's redshift, all points once,
    and none of them where one of its bulletins withdraws it."""
    rows = _flurry(spark, sf_dir)
    groups = fusion.walk(fusion.xref_edges(rows), rows, rows.filter("circular_id % 4 = 0"), 2)
    found, _ = events.fuse(extract.extract(rows, fields=FUSED), rows, groups, {"sdssr": 1, "sdssg": 2})
    return found.select("seed", "ra", "dec", "redshift", F.col("n_points").cast("long").alias("n_points"), F.array_join(F.transform("withdrawn", lambda c: c.cast("string")), ",").alias("withdrawn"), "status")


@query(f"select id0 as seed, id0 + 1 as circular_id, 'sdssr' as band, mag_centi / 100.0 as mag, 60311.0::double as obs_mjd from ({_FLURRY}) where odd <> 0 union all select id0, id0 + 2, 'sdssg', 19.5, 60312.0 from ({_FLURRY}) where odd <> 0")
def fused_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flurry(spark, sf_dir)
    groups = fusion.walk(fusion.xref_edges(rows), rows, rows.filter("circular_id % 4 = 0"), 2)
    _, points = events.fuse(extract.extract(rows, fields=FUSED), rows, groups, {"sdssr": 1, "sdssg": 2})
    return points.select("seed", "circular_id", "band", "mag", "obs_mjd")


@query("""with recursive o as (select user_id::varchar as obj_id, event_type as band, epoch_us(ts) / 86400e6 as t, event_id, row_number() over (partition by user_id, event_type order by event_id desc) as n from events where event_id % 7 <> 0),
h as (select user_id::varchar as obj_id, event_type as band, list(epoch_us(ts) / 86400e6) as seen from events where event_id % 7 = 0 group by all),
k(obj_id, band, n, seen, event_id) as (select o.obj_id, o.band, 0::bigint, coalesce(h.seen, []::double[]), null::bigint from (select distinct obj_id, band from o) o left join h using (obj_id, band)
  union all select k.obj_id, k.band, k.n + 1, case when len(list_filter(k.seen, lambda s: abs(s - o.t) <= 0.25)) = 0 then list_append(k.seen, o.t) else k.seen end, case when len(list_filter(k.seen, lambda s: abs(s - o.t) <= 0.25)) = 0 then o.event_id end
  from k join o on o.obj_id = k.obj_id and o.band = k.band and o.n = k.n + 1)
select obj_id, band, event_id from k where event_id is not null""")
def arrival_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in order of arrival (here the newest id first) that none known before is near to; every seventh is known."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("obj_id"), F.col("event_type").alias("band"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6)).alias("obs_mjd"), "event_id", (-F.col("event_id")).alias("k"))
    seen = e.filter("event_id % 7 = 0").select("obj_id", F.col("band").alias("filter"), F.col("obs_mjd").alias("mjd"))
    return events.new_points(e.filter("event_id % 7 <> 0"), seen, "k", tolerance=0.25).select("obj_id", "band", "event_id")
