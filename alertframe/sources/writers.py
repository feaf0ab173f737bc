"""Sinks: extraction files, JSON lines, train/validation sets, reports and the downstream plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_json(*cols: str) -> Column:
    """A row as JSON without nulls."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(record_json(*df.columns).alias("value")).write.mode("overwrite").text(path)


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """A file for each row (name, value) in a folder that all executors share, written by the tasks; the manifest (name,
    bytes). A task that runs again writes the same files."""
    base = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, value in zip(names, b.column(1).to_pylist(), strict=True):
                raw = value.encode()
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "value").mapInArrow(run, "name string, bytes long")


def write_extractions(found: DataFrame, path: str) -> int:
    """One file per extraction, named by a zero-padded id; how many."""
    name = F.concat(F.lpad(F.col("circular_id").cast("string"), 6, "0"), F.lit(".extraction.json"))
    return write_files(found.select(name.alias("name"), record_json(*found.columns).alias("value")), path).count()


def write_scaffold(scaffold: DataFrame, path: str) -> int:
    """labels.scaffold() as a source and a label file per bulletin; how many files."""
    base = F.col("circular_id").cast("string")
    both = F.array(F.struct(F.concat(base, F.lit(".source.md")).alias("name"), F.col("source").alias("value")), F.struct(F.concat(base, F.lit(".label.json")).alias("name"), F.col("label").alias("value")))
    return write_files(scaffold.select(F.explode(both).alias("f")).select("f.*"), path).count()


def post_plan(sources: DataFrame, points: DataFrame, redshifts: DataFrame, comments: DataFrame) -> DataFrame:
    """obj_id, seq, method, path, payload: source, points, redshift, comments; nothing without a source."""
    def step(df: DataFrame, kind: int, method: str, path: Column) -> DataFrame:
        return df.select("obj_id", F.lit(kind).alias("kind"), F.lit(method).alias("method"), path.alias("path"), record_json(*df.columns).alias("payload"))

    one = F.lit("/api/sources")
    rest = step(points, 1, "POST", F.lit("/api/photometry")).unionByName(step(redshifts, 2, "PATCH", F.concat(one, F.lit("/"), "obj_id")))
    rest = rest.unionByName(step(comments, 3, "POST", F.concat(one, F.lit("/"), "obj_id", F.lit("/comments")))).join(sources.select("obj_id").distinct(), "obj_id", "left_semi")
    ordered = step(sources, 0, "POST", one).unionByName(rest)
    return ordered.withColumn("seq", F.row_number().over(Window.partitionBy("obj_id").orderBy("kind", "payload")) - 1).drop("kind")


def render_plan(plan: DataFrame, most: int = 1000) -> str:
    """The plan's first steps as text, a line for the request and one for its payload."""
    steps = plan.orderBy("obj_id", "seq").limit(most).collect()
    return "\n".join(f"{r.method} {r.path}\n  {r.payload}" for r in steps)


def execute_plan(plan: DataFrame, send: Callable[[str, str, str], dict] | None = None, live: bool = False, token: str | None = None, continue_on_error: bool = True) -> list[dict]:
    """Sends the plan's steps in order if live and a token is given, else only lists them (a dry run).

    An answer with status error is a failure; without continue_on_error the first one ends the run.
    """
    out = []
    for r in plan.orderBy("obj_id", "seq").toLocalIterator():
        step = {"path": r.path, "ok": None}
        if live and token and send is not None:
            try:
                answer = send(r.method, r.path, r.payload)
                step["ok"] = answer.get("status") != "error"
            except OSError as e:
                step |= {"ok": False, "error": str(e)}
        out.append(step)
        if step["ok"] is False and not continue_on_error:
            break
    return out


def clipped(x: object, size: int = 80) -> str:
    """A value as JSON, cut to size with dots."""
    text = json.dumps(x, ensure_ascii=False, default=str)
    return text if len(text) <= size else text[: size - 3] + "..."


def table(rows: DataFrame) -> str:
    """A Markdown table of a small DataFrame."""
    cell = lambda x: "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    out = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join(out + [f"| {' | '.join(cell(x) for x in r)} |" for r in rows.collect()]) + "\n"


def report(metrics: DataFrame, failures: DataFrame | None = None, telemetry: DataFrame | None = None, title: str = "Evaluation") -> str:
    """Markdown: a row per field, then what the run cost, then each field's first failures with both values."""
    out = [f"# {title}", "## Fields", table(metrics)]
    if telemetry is not None:
        out += ["## Run", table(telemetry)]
    if failures is not None:
        out.append("## Failures")
        for r in failures.collect():  # a few per field
            x = r.asDict(recursive=True)
            out.append(f"- {x.get('field')} of {x.get('circular_id')}: {x.get('outcome')}, gold {clipped(x.get('gold'))}, predicted {clipped(x.get('pred'))}")
    return "\n\n".join(out) + "\n"


def plot(metrics: DataFrame, width: int = 420, bar: int = 18) -> str:
    """An SVG of two panels for a metrics DataFrame (a row per field): precision, recall and F1, and what the counts are."""
    rows = metrics.collect()  # a row per field
    panels = (
        [("precision", "#4c78a8"), ("recall", "#f58518"), ("f1", "#54a24b")],
        [("tp", "#54a24b"), ("fp", "#e45756"), ("fn", "#b279a2")],
    )
    group, most = bar * 3 + 10, max([1, *(r[c] for r in rows for c in ("tp", "fp", "fn"))])
    height, out = 40 + group * len(rows), []
    for p, series in enumerate(panels):
        left = p * (width + 140) + 110
        out += [f'<text x="{left + 90 * k}" y="16" fill="{colour}">{name}</text>' for k, (name, colour) in enumerate(series)]
        for i, r in enumerate(rows):
            top = 30 + i * group
            out.append(f'<text x="{left - 6}" y="{top + bar}" text-anchor="end">{escape(str(r["field"]))}</text>')
            for k, (name, colour) in enumerate(series):
                value = r[name] or 0
                size = width * value / (most if p else 1)
                label = f"{value}" if p else f"{value:.2f}"
                out.append(f'<rect x="{left}" y="{top + k * bar}" width="{size:.1f}" height="{bar - 3}" fill="{colour}"/><text x="{left + size + 4:.1f}" y="{top + k * bar + bar - 6}">{label}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{2 * (width + 150)}" height="{height}" font-family="sans-serif" font-size="12">{"".join(out)}</svg>\n'
