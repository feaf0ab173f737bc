"""The nine query tools behind one registry: name and arguments in, a DataFrame out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_event
from . import events, extract, search, store
from .sky import cone
from .upsert import event_bridge


@dataclass
class Context:
    """What tools work on: the bulletins, the store, and which extractor answers. Without a store, names are kept of all
    bulletins (circular_id, primary_event, ra, dec), and of those that a call is about the whole records are made."""

    spark: SparkSession
    circulars: DataFrame
    store: DataFrame | None = None
    extractor_id: str = "regex"
    names: DataFrame | None = None
    clock: Callable[[], int] = field(default=lambda: int(datetime.now().timestamp()))


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[fn.__name__] = fn
    return fn


def _number(x: Any, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise ValueError(f"{name} must be a number")
    return x


def _text(x: Any, name: str) -> str:
    if not isinstance(x, str) or not x:
        raise ValueError(f"{name} must be a text")
    return x


def _keep(ctx: Context, found: DataFrame) -> DataFrame:
    new = store.rows(found, ctx.clock())
    ctx.store = events.settled(store.put(ctx.store, new))
    return found


def _named(ctx: Context) -> DataFrame:
    if ctx.names is None:
        found = extract.extract(ctx.circulars, fields=("event", "localization"))
        ctx.names = events.settled(store.rows(found, 0).select("circular_id", "primary_event", "ra", "dec"))  # once for all calls
    return ctx.names


def _store(ctx: Context, about: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store, or in its place the records of the bulletins that are left of all names by about."""
    if ctx.store is not None and ctx.names is None:
        return ctx.store
    ids = about(_named(ctx)).select("circular_id")
    made = store.rows(extract.extract(ctx.circulars.join(ids, "circular_id", "left_semi")), 0)
    return made if ctx.store is None else store.put(made, ctx.store)


def _of(event: str) -> Callable[[DataFrame], DataFrame]:
    return lambda names: names.filter(F.col("primary_event") == normal_event(F.lit(event)))


@tool
def extract_properties(ctx: Context, circular_id: int) -> DataFrame:
    """A stored record, or a new one that is then stored."""
    number = int(_number(circular_id, "circular_id"))
    if ctx.store is not None:
        hit = store.get(ctx.store, number, ctx.extractor_id)
        if not hit.isEmpty():
            return hit.select("circular_id", "record.*")
    return _keep(ctx, extract.extract(ctx.circulars.filter(F.col("circular_id") == number)))


@tool
def extract_text(ctx: Context, body: str, circular_id: int = 0, subject: str = "", event_id: str | None = None, trigger_time: datetime | None = None) -> DataFrame:
    rows = [(int(_number(circular_id, "circular_id")), subject, _text(body, "body"), event_id, trigger_time)]
    found = extract.extract(ctx.spark.createDataFrame(rows, "circular_id long, subject string, body string, event_id string, trigger_time timestamp"))
    return _keep(ctx, found) if circular_id else found


@tool
def get_redshift(ctx: Context, event: str) -> DataFrame:
    return store.redshift_of(_store(ctx, _of(_text(event, "event"))), event, ctx.extractor_id)


@tool
def get_photometry(ctx: Context, event: str) -> DataFrame:
    return store.photometry_of(_store(ctx, _of(_text(event, "event"))), event, ctx.extractor_id)


@tool
def get_classification(ctx: Context, event: str) -> DataFrame:
    return store.classification_of(_store(ctx, _of(_text(event, "event"))), event, ctx.extractor_id)


@tool
def find_counterparts(ctx: Context, gw_event_id: str) -> DataFrame:
    return store.counterparts(_store(ctx, _of(_text(gw_event_id, "gw_event_id"))), gw_event_id)


@tool
def search_by_position(ctx: Context, ra: float, dec: float, radius_arcsec: float, limit: int = 50) -> DataFrame:
    at = _number(ra, "ra"), _number(dec, "dec"), _number(radius_arcsec, "radius_arcsec")
    return store.by_position(_store(ctx, lambda names: cone(names, *at, limit=None)), *at, int(_number(limit, "limit")))


@tool
def search_gcn_circulars(ctx: Context, query: str, event: str | None = None, limit: int = 10) -> DataFrame:
    return search.search(search.index(ctx.circulars), event_bridge(ctx.circulars), query, event, int(_number(limit, "limit")))


@tool
def fetch_gcn_circulars(ctx: Context, ids: list[int]) -> DataFrame:
    wanted = ctx.spark.createDataFrame([(int(_number(i, "ids")), k) for k, i in enumerate(ids)], "circular_id long, ord int")
    return wanted.join(ctx.circulars, "circular_id").orderBy("ord").drop("ord")


def dispatch(ctx: Context, request: str) -> str:
    """A JSON request {tool, arguments, id} to a JSON answer {id, ok, result or error}."""
    asked: dict[str, Any] = {}
    try:
        asked = json.loads(request)
        rows = TOOLS[asked["tool"]](ctx, **(asked.get("arguments") or {})).toJSON().collect()
        return json.dumps({"id": asked.get("id"), "ok": True, "result": [json.loads(r) for r in rows]})
    except (ValueError, TypeError, KeyError) as e:
        return json.dumps({"id": asked.get("id") if isinstance(asked, dict) else None, "ok": False, "error": f"{type(e).__name__}: {e}"})
