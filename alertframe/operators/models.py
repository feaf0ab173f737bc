"""Model back ends: the prompt, three ways to ask, and records from the answers.

A back end is a plain function of a prompt, so that tests and clusters inject their own; `sender` posts a JSON payload and
gives the JSON answer. Nothing here keeps a connection: clients are made in the tasks.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..shipping import ship
from ..text import times
from ..text.bands import PHOTOMETRY
from . import backends, extract, labels

Sender = Callable[[str, dict, dict], dict]
# The fields that a model is asked for; the others are derived or not scored.
ASKED = {
    "event": ("event_name",),
    "localization": ("ra", "dec"),
    "redshift": ("redshift", "redshift_error", "redshift_measure", "redshift_type"),
    "classification": ("classification",),
    "photometry": (
        "filter", "mag", "mag_error", "mag_system", "limiting_mag", "limiting_mag_sigma", "obs_mjd", "telescope", "flux_density", "flux_density_error", "limiting_flux_density", "flux_density_unit",
        "frequency_ghz",
    ),
    "time_offsets": ("value", "unit", "reference"),
}
VERSION = "1"
INSTRUCTION = (
    "You read one astronomical bulletin and fill in a record of what it states about the transient itself.\n"
    "Copy numbers as written. Leave out what it does not state, and what it states about host galaxies, comparison stars or other objects.\n"
    "A magnitude without a detection is a limit. Give time offsets from the trigger with their unit, not dates that you work out."
)
#: Worked examples: a bulletin's text and its record.
SHOTS = [
    ("We observed GRB 200101A with a 2-m telescope, 3.5 hours after the burst. The afterglow has r = 20.15 +/- 0.08 (AB).",
     {"event": {"event_name": ["GRB200101A"]}, "photometry": [{"filter": "r", "mag": 20.15, "mag_error": 0.08, "mag_system": "AB"}], "time_offsets": [{"value": 3.5, "unit": "h", "reference": "trigger"}]}),
    ("The spectrum of AT2020abc shows broad lines of a type Ic-BL supernova; absorption lines give z = 0.042.",
     {"event": {"event_name": ["AT2020abc"]}, "classification": {"classification": "Ic-BL"}, "redshift": {"redshift": 0.042, "redshift_measure": "spectroscopic", "redshift_type": "absorption"}}),
    ("No source is seen at the position of EP240101a to a 3-sigma limit of 21.3 mag in the g band.",
     {"event": {"event_name": ["EP240101a"]}, "photometry": [{"filter": "g", "limiting_mag": 21.3, "limiting_mag_sigma": 3.0}]}),
]


def answer_schema() -> dict:
    """The JSON Schema of an answer: the asked fields alone, arrays and strings bounded. Needs a session."""
    whole = json.loads(schemas.json_schema())["properties"]

    def lean(name: str) -> dict:
        node = whole[name]
        inner = node.get("items", node)
        inner = inner | {"properties": {k: v for k, v in inner["properties"].items() if k in ASKED[name]}}
        return node | {"items": inner} if "items" in node else inner

    return labels.cap_arrays({"type": "object", "properties": {name: lean(name) for name in ASKED}})


def prompt(body: str, subject: str = "") -> str:
    shots = "\n\n".join(f"Bulletin:\n{text}\nRecord:\n{json.dumps(record)}" for text, record in SHOTS)
    return f"{INSTRUCTION}\n\n{shots}\n\nBulletin:\n{subject}\n{body}\nRecord:\n"


def post_json(url: str, payload: dict, headers: dict) -> dict:
    """Posts JSON; a transport failure is an OSError."""
    ask = urllib.request.Request(url, json.dumps(payload).encode(), {"content-type": "application/json"} | headers)
    with urllib.request.urlopen(ask, timeout=600) as r:
        return json.load(r)


@dataclass
class ToolCaller:
    """A messages service that is made to call one tool with the record; its instructions are marked for caching."""

    url: str
    model: str
    key: str = ""
    send: Sender = post_json
    most: int = 4096
    grammar: dict = field(default_factory=answer_schema)  # made by the driver

    def __call__(self, text: str) -> tuple[str, int, int]:
        tool = {"name": "record", "description": "What the bulletin states.", "input_schema": self.grammar}
        head = [{"type": "text", "text": INSTRUCTION, "cache_control": {"type": "ephemeral"}}]
        payload = {"model": self.model, "max_tokens": self.most, "system": head, "tools": [tool], "tool_choice": {"type": "tool", "name": "record"}, "messages": [{"role": "user", "content": text}]}
        got = self.send(self.url, payload, {"x-api-key": self.key})
        used = got.get("usage", {})
        called = next((c["input"] for c in got.get("content", []) if c.get("type") == "tool_use"), None)
        return json.dumps(called) if called is not None else "", used.get("input_tokens", 0), used.get("output_tokens", 0)


@dataclass
class JsonMode:
    """A local service that is asked for JSON; answers that are none are asked for once more by the caller."""

    url: str
    model: str
    send: Sender = post_json

    def __call__(self, text: str) -> tuple[str, int, int]:
        got = self.send(self.url, {"model": self.model, "prompt": text, "format": "json", "stream": False, "options": {"temperature": 0}}, {})
        return got.get("response", ""), got.get("prompt_eval_count", 0), got.get("eval_count", 0)


@dataclass
class Constrained:
    """A completion server that samples within the answer's schema."""

    url: str
    send: Sender = post_json
    most: int = 4096
    grammar: dict = field(default_factory=answer_schema)

    def __call__(self, text: str) -> tuple[str, int, int]:
        got = self.send(self.url, {"prompt": text, "json_schema": self.grammar, "temperature": 0, "n_predict": self.most}, {})
        return got.get("content", ""), got.get("tokens_evaluated", 0), got.get("tokens_predicted", 0)


def _record(number: int, body: str, trigger: Any, response: str | None, meta: dict) -> dict:
    """An answer as a record; without one it is empty and says so. Dating needs the trigger, so it comes after the cache."""
    found = backends.sanitise(response, body) if response else None
    notes = [] if found is not None else ["error: no answer"]
    found = found or {}
    rows = [{c: r.get(c) for c in PHOTOMETRY} for r in found.get("photometry") or [] if isinstance(r, dict)]
    offsets = [o for o in found.get("time_offsets") or [] if isinstance(o, dict) and isinstance(o.get("value"), int | float)]
    notes += times.date_rows(rows, offsets, body, trigger)
    event, z, place = found.get("event"), found.get("redshift"), found.get("localization")
    named = event.get("event_name") if isinstance(event, dict) else None
    named = [named] if isinstance(named, str) else [x for x in named if isinstance(x, str)] if isinstance(named, list) else []
    error = z.get("redshift_error") if isinstance(z, dict) else None
    number_of = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    for r in rows:
        for c in PHOTOMETRY:
            r[c] = number_of(r[c]) if c in _NUMBERS else r[c] if isinstance(r[c], str) and c in _TEXTS else None
    return {
        "circular_id": number,
        "event": {"event_name": named, "event_name_is_list": len(named) > 1} if named else None,
        "localization": {"ra": number_of(place.get("ra")), "dec": number_of(place.get("dec"))} if isinstance(place, dict) else None,
        "time_offsets": [{"value": float(o["value"]), "unit": o.get("unit"), "reference": o.get("reference")} for o in offsets],
        "photometry": rows,
        "classification": found.get("classification"),
        "redshift": {"redshift": number_of(z.get("redshift")), "redshift_error": [float(error)] if number_of(error) is not None else None, "redshift_measure": z.get("redshift_measure"), "redshift_type": z.get("redshift_type")} if isinstance(z, dict) else None,
        "retraction": False,
        "provenance": list((found.get("provenance") or {}).items()),
        "extraction_meta": meta | {"notes": notes},
    }


_KINDS = dict(f.split(":", 1) for f in schemas.PHOTOMETRY.removeprefix("struct<")[:-1].split(","))
_NUMBERS, _TEXTS = ({c for c, kind in _KINDS.items() if kind == k} for k in ("double", "string"))


def records(circulars: DataFrame, answers: DataFrame) -> DataFrame:
    """schemas.EXTRACTION of every bulletin from backends.call()'s answers; those without an answer have an empty record."""
    ship(circulars.sparkSession)
    arrow = to_arrow_schema(schemas.struct(schemas.EXTRACTION))
    when = F.col("trigger_time") if "trigger_time" in circulars.columns else F.lit(None).cast("timestamp")
    own = circulars.select("circular_id", F.coalesce("body", F.lit("")).alias("body"), when.alias("trigger_time"))
    told = answers.select("circular_id", "response", "extractor", "model_id", "prompt_version", "tokens_in", "tokens_out", "cache_hit")
    both = own.join(told, "circular_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, body, trigger, response, *meta in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known = dict(zip(("extractor", "model_id", "prompt_version", "tokens_in", "tokens_out", "cache_hit"), meta, strict=True))
                out.append(_record(number, body, trigger, response, known))
            yield pa.RecordBatch.from_arrays([pa.array([g.get(f.name) for g in out], f.type) for f in arrow], schema=arrow)

    return extract.derive(both.mapInArrow(run, schemas.EXTRACTION))
