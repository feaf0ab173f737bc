"""Model-backed extraction behind an injected client, with a cache table before the call."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..text import classes

CACHE = "extractor string, model_id string, prompt_version string, circular_id long, body_sha1 string, response string, tokens_in long, tokens_out long"
KEY = ["extractor", "model_id", "prompt_version", "circular_id", "body_sha1"]
#: A client takes a prompt and gives (response text, tokens in, tokens out); it raises on transport failures.
Client = Callable[[str], tuple[str, int, int]]


def sanitise(response: str, body: str) -> dict | None:
    """A response's JSON with false spans dropped, all-null objects gone and the class's canonical name; else null."""
    try:
        found = json.loads(response[response.index("{") : response.rindex("}") + 1])
    except ValueError:
        return None

    def tidy(x: object) -> object:
        if isinstance(x, dict):
            kept = {k: v for k, v in ((k, tidy(v)) for k, v in x.items()) if v is not None}
            return kept or None
        return [v for v in map(tidy, x) if v is not None] if isinstance(x, list) else x

    def joined(node: object) -> object:
        """References are texts: a list of them becomes one."""
        if isinstance(node, dict) and isinstance(node.get("reference"), dict):
            node["reference"] = {k: ",".join(map(str, v)) if isinstance(v, list) else v for k, v in node["reference"].items()}
        return node

    spans = {}
    for path, s in (found.get("provenance") or {}).items():
        if isinstance(s, dict) and isinstance(s.get("start"), int) and isinstance(s.get("end"), int) and 0 <= s["start"] < s["end"] <= len(body):
            spans[path] = {"start": s["start"], "end": s["end"], "snippet": body[s["start"] : s["end"]]}
    out = tidy({k: v for k, v in found.items() if k != "provenance"}) or {}
    if "follow_up" in out:
        out["follow_up"] = joined(out["follow_up"])
    if kind := out.get("classification"):
        name = classes.aliases().get(str(kind.get("classification", "") if isinstance(kind, dict) else kind).strip().lower())
        out["classification"] = {"classification": name} if name else None
    return {**out, "provenance": spans}


def call(circulars: DataFrame, cache: DataFrame, client: Client, extractor: str, model_id: str, prompt_version: str, ask: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, new cache rows): cached bulletins are answered from the cache, the others by the client.

    A call is retried once if its answer is no JSON; a transport failure gives no response and is never cached.
    """
    from .models import prompt  # which uses this module

    ship(circulars.sparkSession)
    ask = ask or prompt
    keyed = circulars.select(F.lit(extractor).alias("extractor"), F.lit(model_id).alias("model_id"), F.lit(prompt_version).alias("prompt_version"), "circular_id", F.sha1(F.coalesce("body", F.lit(""))).alias("body_sha1"), "body")
    hits = keyed.drop("body").join(cache, KEY)
    todo = keyed.join(cache.select(*KEY), KEY, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                text = r.body if isinstance(r.body, str) else ""
                for _ in range(2):
                    try:
                        answer, n_in, n_out = client(ask(text))
                    except OSError:
                        break
                    if sanitise(answer, text) is not None:
                        rows.append([*(getattr(r, k) for k in KEY), answer, n_in, n_out])
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CACHE.split(", ")])

    fresh = todo.mapInPandas(run, CACHE)
    return hits.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False))), fresh
