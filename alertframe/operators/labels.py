"""Chunks of long texts, their merged records, label views and hybrid routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..text.bands import PHOTOMETRY

# Chunk sizes in characters, and which source answers which field first.
WHOLE, SIZE, OVERLAP = 30_000, 20_000, 1_500
ROUTES: dict[str, tuple[str, str | None]] = {
    "event": ("regex", "model"), "localization": ("regex", None), "follow_up": ("model", "regex"), "time_offsets": ("model", None), "photometry": ("model", "regex"),
    "classification": ("model", None), "redshift": ("model", "regex"), "retraction": ("regex", None),
}
ROW_KEY = ("filter", "mag", "limiting_mag", "telescope", "instrument")


def chunks(text: Column, whole: int = WHOLE, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs folded into chunks of about `size`, each after the first starting with its predecessor's tail."""

    def step(a: Column, p: Column) -> Column:
        grown = F.concat(a["now"], F.lit("\n\n"), p)
        full = F.struct(F.array_append(a["done"], a["now"]).alias("done"), F.concat(F.substring(a["now"], F.greatest(F.length(a["now"]) - overlap + 1, F.lit(1)), F.lit(overlap)), F.lit("\n\n"), p).alias("now"))
        more = F.struct(a["done"].alias("done"), F.when(a["now"].isNull(), p).otherwise(grown).alias("now"))
        return F.when(a["now"].isNotNull() & (F.length(grown) > size), full).otherwise(more)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    cut = F.aggregate(F.split(text, "\n\n", -1), start, step, lambda a: F.array_append(a["done"], a["now"]))
    return F.when(F.length(text) <= whole, F.array(text)).otherwise(cut)


def merge_rows(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Measurements of a bulletin's chunks once each: same filter, magnitude, limit, telescope and instrument are one."""
    key = [F.col(c) for c in ROW_KEY]
    first = rows.groupBy(group, *key).agg(F.min(F.struct(*order, *(F.col(c) for c in PHOTOMETRY if c not in ROW_KEY))).alias("f"))
    return first.select(group, *ROW_KEY, *(F.col(f"f.{c}") for c in order), *(F.col(f"f.{c}") for c in PHOTOMETRY if c not in ROW_KEY))


def merge_scalars(found: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """The first non-null value of each column over a bulletin's chunks."""
    return found.groupBy(group).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def route(regex: DataFrame, model: DataFrame, overrides: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """Per field the first source's value, or the second's (if there is one) where that is null or empty; provenance is
    of the source that was taken."""
    routes = ROUTES | (overrides or {})
    both = regex.alias("regex").join(model.alias("model"), "circular_id", "full")
    lists = {f.name for f in regex.schema.fields if f.dataType.typeName() == "array"}
    there = lambda source, c: F.coalesce(F.size(F.col(f"{source}.{c}")) > 0, F.lit(False)) if c in lists else F.col(f"{source}.{c}").isNotNull()
    out, taken = [], []
    for c, (main, other) in routes.items():
        use = there(other, c) & ~there(main, c) if other else F.lit(False)
        out.append(F.when(use, F.col(f"{other or main}.{c}")).otherwise(F.col(f"{main}.{c}")).alias(c))
        taken += [F.lit(c), F.when(use, other or main).when(there(main, c), main)]
    base = lambda k: F.regexp_extract(k, r"^([^.\[]*)", 1)
    source = F.create_map(*taken)
    none = F.create_map().cast("map<string,struct<start:int,end:int,snippet:string>>")
    of = lambda s: F.coalesce(F.map_filter(F.col(f"{s}.provenance"), lambda k, v: F.coalesce(F.try_element_at("source", base(k)) == s, F.lit(False))), none)
    both = both.withColumn("source", source)
    return both.select("circular_id", *out, F.map_concat(of("regex"), of("model")).alias("provenance"))


# What marks a filter that is a band in words ("0.5-10 keV"), and the longest name of a telescope.
BAND_IN_WORDS = r"(?i)\b(?:keV|MeV|GHz|MHz)\b"
LONGEST_NAME = 64


def repair(routed: DataFrame, regex: DataFrame, stated: DataFrame) -> DataFrame:
    """Four repairs of a model's record by what was parsed; stated: circular_id, telescope, mjd and time of the text.

    Flux rows that the model gave in words come back as parsed ones; rows without a telescope get the parsed one, and
    names that run on are dropped; a stated epoch (of the parsed rows, if they agree on one, else of the text) replaces
    the model's; a parsed subtype is kept, and a parsed flare star stands.
    """
    one = routed.join(regex.select("circular_id", F.col("photometry").alias("r_rows"), F.col("classification").alias("r_kind")), "circular_id", "left")
    one = one.join(stated.select("circular_id", F.col("telescope").alias("s_telescope"), F.col("mjd").alias("s_mjd"), F.col("time").alias("s_time")), "circular_id", "left")
    rows, parsed = F.col("photometry"), F.coalesce("r_rows", F.array().cast(routed.schema["photometry"].dataType))
    flux = lambda p: p["energy_band_kev"].isNotNull() | p["frequency_ghz"].isNotNull()
    fluxes = F.filter(parsed, flux)
    worded = lambda p: p["bandpass"].isNull() & F.coalesce(p["filter"].rlike(BAND_IN_WORDS), F.lit(False))
    rescued = F.when((F.size(rows) > 0) & ~F.exists(rows, flux) & (F.size(fluxes) > 0), F.concat(F.filter(rows, lambda p: ~worded(p)), fluxes)).otherwise(rows)
    own = F.get(F.filter(parsed, lambda p: p["telescope"].isNotNull()), F.lit(0))["telescope"]
    times = F.array_distinct(F.transform(F.filter(parsed, lambda p: p["obs_mjd"].isNotNull() & p["obs_time"].isNotNull()), lambda p: F.struct(p["obs_mjd"].alias("mjd"), p["obs_time"].alias("time"))))
    epoch = F.when(F.size(times) == 1, F.get(times, F.lit(0))).when(F.col("s_mjd").isNotNull(), F.struct(F.col("s_mjd").alias("mjd"), F.col("s_time").alias("time")))
    words = lambda n: F.split(F.lower(F.trim(n)), r"\s+")
    sound = lambda n: (F.length(n) <= LONGEST_NAME) & (F.size(F.array_distinct(words(n))) == F.size(words(n)))
    one = one.withColumns({"photometry": rescued, "x_telescope": F.coalesce(own, F.col("s_telescope")), "x_epoch": epoch})

    def mended(p: Column) -> Column:
        new = {
            "telescope": F.coalesce(F.when(sound(p["telescope"]), p["telescope"]), F.col("x_telescope")),
            "obs_mjd": F.coalesce(F.col("x_epoch.mjd"), p["obs_mjd"]),
            "obs_time": F.when(F.col("x_epoch").isNotNull() & ~p["obs_mjd"].eqNullSafe(F.col("x_epoch.mjd")), F.col("x_epoch.time")).otherwise(p["obs_time"]),
        }
        return F.struct(*((new[c] if c in new else p[c]).alias(c) for c in PHOTOMETRY))

    kind, theirs = F.col("classification"), F.col("r_kind")
    flare = theirs["classification"] == "UV Ceti"
    sub = F.when(kind.isNull() & theirs["subtype"].isNotNull(), theirs).when(kind["subtype"].isNull() & theirs["subtype"].isNotNull(), kind.withField("subtype", theirs["subtype"])).otherwise(kind)
    out = one.withColumns({"photometry": F.transform("photometry", mended), "classification": F.when(flare, theirs).otherwise(sub)})
    return out.select(*routed.columns)


def merge_lists(found: DataFrame, group: str, order: str) -> DataFrame:
    """A bulletin's time offsets, notes and provenance over its chunks, each once: the first of equal offsets and notes in
    order of the chunks, and the first chunk's span of a path."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(c, F.array().cast(found.select(c).schema[0].dataType)).alias("x")))), lambda s: s["x"]))
    spans = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.array_sort(F.map_entries("provenance")).alias("x")))), lambda s: s["x"]))
    keys = F.array_distinct(F.transform("_spans", lambda e: e["key"]))
    first = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter("_spans", lambda e: e["key"] == k), F.lit(0))["value"])))
    flat = found.withColumn("notes", F.col("extraction_meta.notes"))
    ordered_notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("notes", F.array().cast("array<string>")).alias("x")))), lambda s: s["x"]))
    return flat.groupBy(group).agg(F.array_distinct(ordered("time_offsets")).alias("time_offsets"), F.array_distinct(ordered_notes).alias("notes"), spans.alias("_spans")).withColumn("provenance", first).drop("_spans")


def label_view(found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """circular_id, path, value, snippet, start, end: fields (lists joined by commas) with their spans, or the span of the
    field above."""
    kinds = {path: found.select(F.col(col)).schema[0].dataType.typeName() for path, col in fields.items()}
    text = lambda path, col: F.when(F.size(col) > 0, F.array_join(F.col(col).cast("array<string>"), ", ")) if kinds[path] == "array" else F.col(col).cast("string")
    pairs = F.array(*(F.struct(F.lit(path).alias("path"), text(path, col).alias("value")) for path, col in fields.items()))
    rows = found.select("circular_id", "provenance", F.explode(pairs).alias("x")).filter("x.value is not null")
    parent = F.regexp_replace("x.path", r"\.[^.]*$", "")
    span = F.coalesce(F.try_element_at("provenance", F.col("x.path")), F.try_element_at("provenance", parent))
    return rows.select("circular_id", "x.path", "x.value", span.alias("s")).select("circular_id", "path", "value", "s.snippet", "s.start", "s.end")


def backfill_span(body: Column, value: Column, longest: int = 200) -> Column:
    """The place of a value of three characters or more that the text has exactly once; its snippet is cut at `longest`."""
    times = (F.length(body) - F.length(F.replace(body, value, F.lit("")))) / F.length(value)
    at = F.instr(body, value) - 1
    size = F.least(F.length(value), F.lit(longest))
    return F.when((F.length(value) >= 3) & (times == 1), F.struct(at.alias("start"), (at + size).alias("end"), F.substring(value, F.lit(1), size).alias("snippet")))


def anchor_rows(body: Column, values: Column, longest: int = 200) -> Column:
    """For each of a list's values (as text) the line that alone has it: start, end and snippet, cut at `longest`; else null."""

    def one(v: Column) -> Column:
        hits = F.filter(F.split(body, "\n", -1), lambda x: F.contains(x, v))
        line = F.get(hits, F.lit(0))
        size = F.least(F.length(line), F.lit(longest))
        at = F.instr(body, line) - 1
        return F.when((F.size(hits) == 1) & (F.length(v) >= 3), F.struct(at.alias("start"), (at + size).alias("end"), F.substring(line, F.lit(1), size).alias("snippet")))

    return F.transform(values, one)


def scaffold(circulars: DataFrame) -> DataFrame:
    """circular_id, source (Markdown: subject, id, rule, body) and label: an empty label with every slot visible."""
    slots = [f"'{c}', cast(null as string)" for c in ("event", "follow_up", "localization", "datetime")]
    lists = [f"'{c}', cast(array() as array<string>)" for c in ("time_offsets", "photometry", "spectroscopy")]
    rest = [f"'{c}', cast(null as string)" for c in ("classification", "redshift", "reporter")]
    empty = F.to_json(F.expr(f"named_struct('circular_id', circular_id, {', '.join(slots + lists + rest)})"), {"ignoreNullFields": "false"})
    source = F.concat(F.lit("# "), F.coalesce("subject", F.lit("")), F.lit("\n\ncircular "), F.col("circular_id").cast("string"), F.lit("\n\n---\n"), F.coalesce("body", F.lit("")))
    return circulars.select("circular_id", source.alias("source"), empty.alias("label"))


def cap_arrays(schema: dict, most_items: int = 15, longest: int = 128) -> dict:
    """A JSON Schema for constrained decoding: arrays and strings bounded, everything else as it is."""
    out = {k: cap_arrays(v, most_items, longest) if isinstance(v, dict) else v for k, v in schema.items()}
    if out.get("type") == "array":
        out["maxItems"] = most_items
    if "string" in (out.get("type") if isinstance(out.get("type"), list) else [out.get("type")]):
        out["maxLength"] = longest
    return out
