"""Extraction: bulletins to nested, provenance-carrying records.

One mapInArrow pass runs all span-bearing parsers, since they share state (a cascade of photometry forms, overlap
rules, dating); what can be derived from the result (detection flags, canonical names, taxonomy paths) is added by
Catalyst expressions after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import dealing, schemas
from ..shipping import ship
from ..text import classes, flux, names, positions, redshifts, tables, times
from ..text.bands import PHOTOMETRY, stated_system

Classifier = Callable[[str], str | None]


def _span(found: dict, text: str) -> dict:
    return {"start": found["start"], "end": found["end"], "snippet": text[found["start"] : found["end"]]}


#: The parts of a record that extract() can be asked for.
FIELDS = ("event", "follow_up", "localization", "time_offsets", "photometry", "classification", "redshift", "retraction")


def extract_text(
    subject: str | None, body: str | None, event_id: str | None = None, trigger: datetime | None = None, classify: Classifier | None = None, fields: tuple[str, ...] = FIELDS
) -> dict[str, Any]:
    """One bulletin's record; provenance spans are into body as it stands. Parsers of fields that aren't asked for don't run."""
    body, notes, where = body or "", [], {}
    event = names.name_event(event_id, subject, body) if "event" in fields else {"primary": None, "source": "none"}
    if event["primary"] and (at := body.find(event["primary"])) >= 0:
        where["event.event_name"] = _span({"start": at, "end": at + len(event["primary"])}, body)
    elif event["source"] == "body" and (raw := names.find_events(body)):
        where["event.event_name"] = _span(raw[0], body)
    all_names = ([event["primary"]] if event["source"] == "eventId" else event["names"]) if event["primary"] else []
    xrefs = names.find_xrefs(body) if "follow_up" in fields else []
    if xrefs:
        where["follow_up.reference"] = _span({"start": xrefs[0]["start"], "end": xrefs[-1]["end"]}, body)
    place = positions.find_position(body) if "localization" in fields else None
    if place:
        where["localization"] = _span(place, body)
        all_names += [n for n in place["names"] if names.normal(n) not in map(names.normal, all_names)]
    rows: list[dict] = []
    if "photometry" in fields:
        optical = tables.photometry(body, trigger)
        if system := stated_system(body) if optical else None:
            for r in optical:
                r["mag_system"] = system
        rows = optical + flux.radio(body) + flux.xray(body)
    offsets = times.find_offsets(body) if "time_offsets" in fields or (rows and trigger) else []
    notes += times.date_rows(rows, offsets, body, trigger)
    if telescope := names.find_telescope(body) if rows else None:
        for r in rows:
            r["telescope"] = r["telescope"] or telescope["name"]
    z, bound = redshifts.find_redshift(body) if "redshift" in fields else None, None
    if z:
        where["redshift.redshift"] = _span(z, body)
    elif bound := redshifts.find_bound(body) if "redshift" in fields else None:
        notes.append(bound["phrase"])
        where["_redshift_bound"] = _span(bound, body)
    judged = "classification" in fields
    kind = classes.find_class(body) if judged else None
    found = {"classification": kind["classification"], "subtype": None, "confidence": None, "taxonomy_path": None} if kind else None
    if kind:
        where["classification.classification"] = _span(kind, body)
    if classify is not None and judged:
        label = classify(f"{subject or ''} {body}")
        found = {"classification": label, "subtype": None, "confidence": None, "taxonomy_path": None} if label else None
        where = where if found else {k: v for k, v in where.items() if not k.startswith("classification")}
    if flare := classes.flare_class(f"{subject or ''}. {body}") if judged else None:
        found = {"classification": "UV Ceti", "subtype": flare if flare.endswith("candidate") else None, "confidence": None, "taxonomy_path": None}
    if flash := classes.flash_subtype(f"{subject or ''}. {body}") if judged else None:
        found = (found or {"classification": "GRB", "confidence": None, "taxonomy_path": None}) | {"subtype": flash}
    for k, r in enumerate(rows):
        where[f"photometry[{k}]"] = _span(r, body)
    for k, o in enumerate(offsets):
        where[f"time_offsets[{k}]"] = _span(o, body)
    return {
        "event": {"event_name": all_names, "event_name_is_list": len(all_names) > 1, "id": None, "data_archive_page": None} if all_names else None,
        "follow_up": {"ref_type": None, "ref_instrument": None, "ref_ID": None, "reference": {"gcn_circulars": ",".join(str(x["id"]) for x in xrefs)}} if xrefs else None,
        "localization": {"ra": place["ra"], "dec": place["dec"], "ra_dec_error": place["error"]} if place else None,
        "time_offsets": [{k: o[k] for k in ("value", "unit", "reference")} for o in offsets],
        "photometry": [{k: r[k] for k in PHOTOMETRY} for r in rows],
        "classification": found,
        "redshift": {"redshift": z["redshift"], "redshift_error": [z["error"]] if z["error"] is not None else None, "redshift_measure": z["measure"], "redshift_type": z["type"]} if z else None,
        "retraction": names.is_retraction(subject),
        "provenance": where,
        "extraction_meta": {"extractor": "regex", "model_id": "", "prompt_version": "", "tokens_in": 0, "tokens_out": 0, "latency_ms": None, "cost_usd": 0.0, "cache_hit": False, "notes": notes},
    }


def lookup(table: dict[str, str], key: Column) -> Column:
    """A value from a small fixed table by trimmed lower-case key."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.when(key.isNotNull(), F.try_element_at(pairs, F.lower(F.trim(key))))


def derive(found: DataFrame) -> DataFrame:
    """Recomputes every derived field: detection flags, canonical names and taxonomy paths."""
    scopes, tools = names._canonical("telescope"), names._canonical("instrument")
    paths = F.create_map(*(x for name, path in classes.paths().items() for x in (F.lit(name), F.array(*map(F.lit, path)))))
    new = {"is_detection": schemas.is_detection, "telescope_canonical": lambda p: lookup(scopes, p["telescope"]), "instrument_canonical": lambda p: lookup(tools, p["instrument"])}
    rows = F.transform("photometry", lambda p: F.struct(*(new[c](p).alias(c) if c in new else p[c].alias(c) for c in PHOTOMETRY)))
    kind = F.col("classification")
    path = F.try_element_at(paths, kind["classification"])
    full = F.when(path.isNotNull(), F.struct(kind["classification"].alias("classification"), kind["subtype"].alias("subtype"), kind["confidence"].alias("confidence"), path.alias("taxonomy_path")))
    return found.withColumns({"photometry": rows, "classification": full})


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Nested values as an Arrow array, built column by column, which takes a third of the time of row by row."""
    if all(v is None for v in values):
        return pa.nulls(len(values), kind)
    if pa.types.is_struct(kind):
        parts = [_column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([v is None for v in values]))
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends = list(accumulate((len(v or ()) for v in values), initial=0))
        places = pa.array([None if v is None else at for v, at in zip(values, ends, strict=False)] + ends[-1:], pa.int32())
        flat = [x for v in values if v for x in (v.items() if isinstance(v, dict) else v)]
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(places, _column(flat, kind.value_type), type=kind)
        return pa.MapArray.from_arrays(places, _column([k for k, _ in flat], kind.key_type), _column([x for _, x in flat], kind.item_type), type=kind)
    return pa.array(values, kind)


def failures(found: DataFrame) -> DataFrame:
    """bulletins and failed: how many there are, and how many a parser failed on (their note begins with error)."""
    bad = F.exists(F.coalesce("extraction_meta.notes", F.array().cast("array<string>")), lambda n: n.startswith("error: "))
    return found.agg(F.count(F.lit(1)).alias("bulletins"), F.count(F.when(bad, 1)).alias("failed"))


def extract(circulars: DataFrame, classify: Classifier | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """circular_id, subject, body[, event_id, trigger_time] -> schemas.EXTRACTION; a bad bulletin gets a note (failures()).

    Joins of what comes out are merges: its plan's size, from which a broadcast would be chosen, is far too small.

    Only the parsers of the fields asked for run. Input that isn't dealt out already is dealt out first, since parsing costs
    far more than moving a bulletin and a split may hold millions.
    """
    ship(circulars.sparkSession)
    arrow = to_arrow_schema(schemas.struct(schemas.EXTRACTION))
    has = circulars.columns
    own = circulars.select("circular_id", "subject", "body", *(F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("event_id", "string"), ("trigger_time", "timestamp"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, subject, body, event_id, trigger in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    got = extract_text(subject, body, event_id, trigger, classify, fields)
                except Exception as e:  # one bulletin must not end the job
                    got = {"retraction": False, "photometry": [], "time_offsets": [], "provenance": {}, "extraction_meta": {"extractor": "regex", "notes": [f"error: {e}"]}}
                out.append(got | {"circular_id": number})
            yield pa.RecordBatch.from_arrays([_column([g.get(f.name) for g in out], f.type) for f in arrow], schema=arrow)  # keys that a dict lacks are null

    return derive(dealing.deal(own).mapInArrow(run, schemas.EXTRACTION)).hint("merge")


def provenance_rows(found: DataFrame) -> DataFrame:
    return found.select("circular_id", F.explode("provenance").alias("path", "span")).select("circular_id", "path", "span.*")


def photometry_rows(found: DataFrame) -> DataFrame:
    return found.select("circular_id", F.posexplode("photometry").alias("row", "p")).select("circular_id", "row", "p.*")
