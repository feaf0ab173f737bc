"""Table schemas, validation predicates and the JSON Schema export."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "0.5.0"
RECORD = "circularId long, subject string, eventId string, createdOn long, submitter string, format string, bibcode string, email string, submittedHow string, body string"
CIRCULAR = "circular_id long, circular_id_raw string, subject string, body string, event_id string, created_on long, submitter string, format string, bibcode string, trigger_time timestamp"
SPAN = "struct<start:int,end:int,snippet:string>"
EVENT = "struct<event_name:array<string>,event_name_is_list:boolean,id:array<string>,data_archive_page:string>"
FOLLOW_UP = "struct<ref_type:string,ref_instrument:string,ref_ID:string,reference:map<string,string>>"
LOCALIZATION = (
    "struct<ra:double,dec:double,ra_dec_error:array<double>,containment_probability:double,systematic_included:boolean,"
    "instrument_phi:double,instrument_theta:double,instrument_semimajor_angle:double,healpix_url:string>"
)
TIME_OFFSET = "struct<value:double,unit:string,reference:string>"
PHOTOMETRY = (
    "struct<filter:string,bandpass:string,mag:double,mag_error:double,mag_system:string,limiting_mag:double,limiting_mag_sigma:double,"
    "flux_density:double,flux_density_error:double,limiting_flux_density:double,flux_density_unit:string,frequency_ghz:double,"
    "energy_flux:double,energy_flux_error:double,limiting_energy_flux:double,energy_band_kev:array<double>,obs_mjd:double,obs_time:string,"
    "telescope:string,telescope_canonical:string,instrument:string,instrument_canonical:string,calibration_reference:string,"
    "galactic_extinction_corrected:boolean,seeing:double,airmass:double,is_detection:boolean>"
)
CLASSIFICATION = "struct<classification:string,subtype:string,confidence:double,taxonomy_path:array<string>>"
REDSHIFT = "struct<redshift:double,redshift_error:array<double>,redshift_measure:string,redshift_type:string>"
META = "struct<extractor:string,model_id:string,prompt_version:string,tokens_in:long,tokens_out:long,latency_ms:double,cost_usd:double,cache_hit:boolean,notes:array<string>>"
EXTRACTION = (
    f"circular_id long, event {EVENT}, follow_up {FOLLOW_UP}, localization {LOCALIZATION}, time_offsets array<{TIME_OFFSET}>, photometry array<{PHOTOMETRY}>, "
    f"classification {CLASSIFICATION}, redshift {REDSHIFT}, retraction boolean, provenance map<string,{SPAN}>, extraction_meta {META}"
)
# The closed vocabularies.
ENUMS = {
    "mag_system": ("AB", "Vega"),
    "flux_density_unit": ("uJy", "mJy", "Jy"),
    "time_unit": ("s", "m", "h", "d"),
    "redshift_measure": ("spectroscopic", "photometric"),
    "redshift_type": ("host", "emission", "absorption"),
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def is_detection(p: Column) -> Column:
    """Stated, else true for a value, false for a limit, null for neither."""
    any_ = lambda *names: F.coalesce(*(p[n] for n in names)).isNotNull()
    return F.coalesce(
        p["is_detection"],
        F.when(any_("mag", "flux_density", "energy_flux"), True).when(any_("limiting_mag", "limiting_flux_density", "limiting_energy_flux"), False),
    )


def problems(classes: list[str]) -> Column:
    """Array of what is wrong with an extraction row: closed vocabularies, ranges and classes."""
    checks = {
        "redshift_measure": F.col("redshift.redshift_measure").isin(*ENUMS["redshift_measure"]),
        "redshift_type": F.col("redshift.redshift_type").isin(*ENUMS["redshift_type"]),
        "classification": F.col("classification.classification").isin(*classes),
        "confidence": F.col("classification.confidence").between(0, 1),
        "mag_system": F.forall("photometry", lambda p: F.coalesce(p["mag_system"].isin(*ENUMS["mag_system"]), F.lit(True))),
        "flux_density_unit": F.forall("photometry", lambda p: F.coalesce(p["flux_density_unit"].isin(*ENUMS["flux_density_unit"]), F.lit(True))),
        "time_unit": F.forall("time_offsets", lambda o: F.coalesce(o["unit"].isin(*ENUMS["time_unit"]), F.lit(True))),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items())))


def _json(t: T.DataType) -> dict:
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: _json(f.dataType) for f in t.fields}}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": _json(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": _json(t.valueType)}
    name = {T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number", T.BooleanType: "boolean"}.get(type(t), "string")
    return {"type": [name, "null"]}


def json_schema(ddl: str = EXTRACTION, title: str = "extraction") -> str:
    """The JSON Schema of a table's rows, with version and title."""
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"urn:alertframe:{title}:{VERSION}", "title": title, "version": VERSION}
    return json.dumps(head | _json(struct(ddl)), indent=1)
