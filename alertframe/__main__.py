"""Command line: python -m alertframe VERB ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, schemas
from .operators import classify, evaluate, extract, fusion, labels, sampling, search, store, tools, upsert
from .operators import events as fused
from .session import get_session
from .shipping import ship
from .sources import readers, writers
from .streaming import consume
from .text import classes

#: Verbs with their arguments and options.
VERBS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "version": ((), {}),
    "schema-dump": (("out",), {}),
    "extract": (("records", "out"), {}),
    "index": (("records", "out"), {}),
    "search": (("records", "query"), {"limit": "10", "stored": ""}),
    "tool": (("records", "request"), {}),
    "serve": (("records",), {}),
    "event": (("records", "circular_id"), {"hops": "1"}),
    "post": (("records", "circular_id"), {"hops": "1", "instruments": "{}", "default_instrument": ""}),
    "consume": (("folder", "corpus", "checkpoint"), {"instruments": "{}", "default_instrument": ""}),
    "subset-build": (("records", "out"), {"per_stratum": "10", "seed": "0"}),
    "dataset": (("records", "out"), {"val_every": "10"}),
    "classify-train": (("records", "out"), {"exclude": "", "ratio": "3"}),
    "eval": (("pred", "gold", "out"), {"plot": ""}),
    "label-scaffold": (("records", "out"), {}),
    "label-validate": (("records",), {}),
    "annotate": (("records", "out"), {}),
    "fetch": (("url", "out"), {"start": "1", "most": "100", "delay": "0"}),
}
SCALARS = {"redshift.redshift": "redshift.redshift", "classification.classification": "classification.classification", "event.event_name": "event.event_name", "localization.ra": "localization.ra", "localization.dec": "localization.dec"}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alertframe")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, (args, options) in VERBS.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        for o, default in options.items():
            v.add_argument(f"--{o.replace('_', '-')}", default=default)
    return p


def weak_labels(bulletins: DataFrame) -> DataFrame:
    """bulletins with label, from their subject and body, in Arrow batches."""
    ship(bulletins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [classify.weak_label(f"{s or ''}\n{t or ''}") for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], names=["circular_id", "subject", "body", "label"])

    return bulletins.select("circular_id", "subject", "body").mapInArrow(run, "circular_id long, subject string, body string, label string")


def _outcomes(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """field, circular_id, outcome, gold and pred of every scalar field that is compared."""
    both = gold.select("circular_id", F.struct("event", "redshift", "classification", "localization").alias("g")).join(pred.select("circular_id", F.struct("event", "redshift", "classification", "localization").alias("p")), "circular_id")
    near = lambda path, t: evaluate.number_outcome(F.col(f"g.{path}"), F.col(f"p.{path}"), evaluate.TOLERANCE[t])
    text = lambda path: evaluate.text_outcome(F.col(f"g.{path}"), F.col(f"p.{path}"))
    norm = lambda s: F.transform(f"{s}.event.event_name", lambda x: F.upper(F.regexp_replace(x, r"\\s+", "")))
    fields = {
        "event": (evaluate.names_outcome(norm("g"), norm("p")), "event.event_name"), "redshift": (near("redshift.redshift", "redshift"), "redshift.redshift"),
        "measure": (text("redshift.redshift_measure"), "redshift.redshift_measure"), "classification": (text("classification.classification"), "classification.classification"),
        "ra": (near("localization.ra", "ra"), "localization.ra"), "dec": (near("localization.dec", "dec"), "localization.dec"),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("field"), o.alias("outcome"), F.to_json(F.struct(F.col(f"g.{c}").alias("v"))).alias("gold"), F.to_json(F.struct(F.col(f"p.{c}").alias("v"))).alias("pred")) for name, (o, c) in fields.items()))
    return both.select("circular_id", F.explode(rows).alias("r")).select("circular_id", "r.*")


def _event(bulletins: DataFrame, number: int, hops: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(extractions, texts, groups) of the bulletins around one."""
    groups = fusion.walk(fusion.xref_edges(bulletins), bulletins, bulletins.filter(F.col("circular_id") == number), hops)
    near = bulletins.join(groups.select("circular_id").distinct(), "circular_id", "left_semi")
    return extract.extract(near), near, groups


def _instruments(a: argparse.Namespace) -> tuple[dict[str, int], int | None]:
    return json.loads(a.instruments), int(a.default_instrument) if a.default_instrument else None


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return 0
    if a.verb == "schema-dump":
        Path(a.out).write_text(schemas.json_schema())
        return 0
    spark = get_session("alertframe")
    if a.verb == "fetch":
        spark.dataSource.register(readers.BulletinArchive)
        new = spark.readStream.format("bulletins").option("url", a.url).option("start", a.start).option("most", a.most).option("delay", a.delay).load()
        new.writeStream.format("json").option("path", a.out).option("checkpointLocation", f"{a.out}/_checkpoint").trigger(once=True).start().awaitTermination()
        return 0
    if a.verb == "eval":
        pred, gold = (readers.read_labels(spark, p, schemas.EXTRACTION) if Path(p).is_dir() and list(Path(p).glob("*.label.json")) else spark.read.schema(schemas.EXTRACTION).json(p) for p in (a.pred, a.gold))
        outcomes = _outcomes(pred, gold).persist()
        runs = pred.select(F.lit("run").alias("run"), F.col("extraction_meta.*"))
        fields = evaluate.metrics(outcomes, "field").orderBy("field")
        if a.plot:
            Path(a.plot).write_text(writers.plot(fields))
        Path(a.out).write_text(writers.report(fields, evaluate.first_failures(outcomes, "field", "circular_id"), evaluate.usage(runs, "run")))
        return 0
    if a.verb == "consume":
        return _consume(spark, a)
    return _over_records(spark, a, readers.to_circulars(readers.read_records(spark, a.records)))


def _consume(spark: SparkSession, a: argparse.Namespace) -> int:
    spark.dataSource.register(readers.BulletinFolder)
    stream = readers.to_circulars(spark.readStream.format("bulletin-folder").option("folder", a.folder).load())
    corpus = readers.to_circulars(readers.read_records(spark, a.corpus))

    def post(done: DataFrame, points: DataFrame, epoch: int) -> None:
        for r in done.select("seed", "obj_id", "status", "posted", "repeated").toJSON().toLocalIterator():
            print(r)

    instruments, default = _instruments(a)
    consume.consume(stream, corpus, post, a.checkpoint, instruments, default).awaitTermination()
    return 0


def _over_records(spark: SparkSession, a: argparse.Namespace, bulletins: DataFrame) -> int:
    if a.verb == "extract":
        print(writers.write_extractions(extract.extract(bulletins), a.out))
    elif a.verb == "index":
        store.save(spark, store.put(None, store.rows(extract.extract(bulletins), 0)), f"{a.out}/store")
        search.write_postings(bulletins, f"{a.out}/postings")
    elif a.verb == "search":
        search.search(search.index(bulletins), upsert.event_bridge(bulletins), a.query, limit=int(a.limit), stored=a.stored or None).show(truncate=80)
    elif a.verb == "tool":
        print(tools.dispatch(tools.Context(spark, bulletins), a.request))
    elif a.verb == "serve":  # a request a line, an answer a line
        context = tools.Context(spark, bulletins)
        for line in sys.stdin:
            print(tools.dispatch(context, line), flush=True)
    elif a.verb == "event":
        found, texts, groups = _event(bulletins, int(a.circular_id), int(a.hops))
        fused.fuse(found, texts, groups, {})[0].show(truncate=80, vertical=True)
    elif a.verb == "post":
        found, texts, groups = _event(bulletins, int(a.circular_id), int(a.hops))
        done, points = fused.fuse(found, texts, groups, *_instruments(a))
        own = done.filter("source").persist()
        comments = own.select("obj_id", F.explode("comments").alias("text"))
        plan = writers.post_plan(own.select("obj_id", "ra", "dec"), points.select("obj_id", "band", "mag", "mag_error", "flux", "flux_error", "obs_mjd", "instrument_id"), own.filter("redshift is not null").select("obj_id", "redshift"), comments)
        print(writers.render_plan(plan))
    elif a.verb == "subset-build":
        rows = bulletins.select("circular_id", sampling.stratum(F.col("body")).alias("stratum"))
        writers.write_jsonl(sampling.listed(sampling.stratified_sample(rows, "stratum", "circular_id", int(a.per_stratum), a.seed), "circular_id"), a.out)
    elif a.verb == "dataset":
        found = sampling.has_signal(extract.extract(bulletins))
        examples = fused.settled(sampling.chat_examples(bulletins, found, "Extract the bulletin's record as JSON."))
        numbered = classify.ranked(examples.select("circular_id"), "circular_id")
        split = examples.join(numbered, "circular_id").withColumn("split", F.when(F.col("rank") % int(a.val_every) == 0, "val").otherwise("train")).select("prompt", "target", "split")
        for part in ("train", "val"):
            writers.write_jsonl(split.filter(F.col("split") == part).drop("split"), f"{a.out}/{part}")
    elif a.verb == "classify-train":
        held = spark.read.schema("circular_id long").json(a.exclude) if a.exclude else None
        told = fused.settled(weak_labels(bulletins))
        classify.save(classify.fit(classify.harvest(told, F.col("label"), held, int(a.ratio))), a.out)
    elif a.verb == "label-scaffold":
        print(writers.write_scaffold(labels.scaffold(bulletins), a.out))
    elif a.verb == "annotate":
        writers.write_jsonl(labels.label_view(extract.extract(bulletins), SCALARS), a.out)
    elif a.verb == "label-validate":
        checked = extract.extract(bulletins).select("circular_id", schemas.problems(sorted(classes.paths())).alias("problems")).persist()
        bad = checked.filter("size(problems) > 0")
        bad.show(truncate=80)
        print(json.dumps({"checked": checked.count(), "bad": bad.count()}))
        return int(not bad.isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
