"""Operators on small tables."""

from __future__ import annotations

import json
import tarfile
from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from alertframe import __main__ as cli
from alertframe import schemas
from alertframe.functions import scalars as S
from alertframe.operators import backends, classify, evaluate, events, extract, fusion, labels, models, sampling, search, sky, store, tools, upsert
from alertframe.sources import readers, writers
from alertframe.streaming import consume
from alertframe.text import classes

BODIES = [
    (1, "GRB 240101A: afterglow", None, "The optical counterpart is at RA = 10.0, Dec = 20.0. r = 18.40 +/- 0.10. z = 1.5"),
    (2, "Observations", None, "Of GRB 240101A, see GCN 1. Spectroscopic z = 1.6. R = 19.00 +/- 0.20"),
    (3, "Retraction of EP240101a", None, "It was noise. See GCN 2."),
    (4, "No name", None, None),
]


@pytest.fixture(scope="module")
def bulletins(spark):
    rows = [(i, str(i), s, b, e, 1000 + i, datetime(2024, 1, 1)) for i, s, e, b in BODIES]
    return spark.createDataFrame(rows, "circular_id long, circular_id_raw string, subject string, body string, event_id string, created_on long, trigger_time timestamp").cache()


def test_extract_and_derive(spark, bulletins):
    found = extract.extract(bulletins).cache()
    rows = {r.circular_id: r for r in found.collect()}
    assert rows[1].localization.ra == 10.0 and rows[1].photometry[0].is_detection is True and rows[3].retraction and rows[4].event is None
    assert found.select(schemas.problems(sorted(classes.paths())).alias("p")).filter("size(p) > 0").count() == 0
    again = extract.extract(bulletins.repartition(8)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows.values()))
    assert json.loads(schemas.json_schema())["version"] == schemas.VERSION


def test_store_and_tools(spark, bulletins):
    ctx = tools.Context(spark, bulletins, clock=lambda: 5)
    assert tools.TOOLS["get_redshift"](ctx, "grb 240101a").first().redshift.redshift == 1.5
    assert tools.TOOLS["get_photometry"](ctx, "GRB240101A").count() == 2
    assert tools.TOOLS["search_by_position"](ctx, 10.0, 20.0001, 1.0).count() == 1
    assert [r.circular_id for r in tools.TOOLS["fetch_gcn_circulars"](ctx, [3, 99, 1]).collect()] == [3, 1]
    assert tools.TOOLS["extract_properties"](ctx, 2).first().redshift.redshift == 1.6
    assert tools.TOOLS["extract_text"](ctx, "z = 0.5").first().redshift.redshift == 0.5
    assert tools.TOOLS["get_classification"](ctx, "GRB240101A").first().classification.classification == "GRB"
    assert tools.TOOLS["find_counterparts"](ctx, "GRB240101A").count() == 2
    answer = json.loads(tools.dispatch(ctx, json.dumps({"tool": "search_gcn_circulars", "arguments": {"query": "GRB 240101A counterpart"}, "id": "x"})))
    assert answer["ok"] and answer["id"] == "x" and [r["circular_id"] for r in answer["result"]] == [1]
    assert not json.loads(tools.dispatch(ctx, '{"tool": "search_by_position", "arguments": {"ra": true, "dec": 1, "radius_arcsec": 1}}'))["ok"]
    twice = store.put(store.rows(extract.extract(bulletins), 1), store.rows(extract.extract(bulletins), 2))
    assert twice.count() == 4 and {r.created_at for r in twice.collect()} == {2}
    assert [r.circular_id for r in store.circular_ids(twice).collect()] == [1, 2, 3, 4]


def test_upsert(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("record_hash", upsert.record_hash("v"))
    new, changed = upsert.upsert(now, spark.createDataFrame([(2, "b"), (1, "c"), (3, "d")], "k int, v string"), "k", "v")
    assert {(r.k, r.v) for r in new.collect()} == {(1, "c"), (2, "b"), (3, "d")} and {r.k for r in changed.collect()} == {1, 3}
    assert upsert.first_per(new, ["k"], "v").count() == 3


def test_search(bulletins):
    index, bridge = search.index(bulletins), upsert.event_bridge(bulletins)
    hits = search.search(index, bridge, "observations of GRB 240101A").collect()
    assert [(r.circular_id, r.score) for r in hits] == [(2, 3)]
    assert [r.circular_id for r in search.search(index, bridge, "GRB 240101A").collect()] == [2, 1]
    assert search.search(index, bridge, "optical counterpart").first().circular_id == 1
    assert search.split_query("x-ray of GRB 240101A the") == ("GRB240101A", ["x-ray"])


def test_scalars(spark):
    df = spark.createDataFrame([("12.0", "200101A", " n/a ", "type  Ia")], "a string, b string, c string, d string")
    raw, number = S.id_parts(F.col("a"))
    r = df.select(raw.alias("raw"), number.alias("n"), S.positive_id(F.lit("-4.0")).alias("p"), S.grb_name(F.col("b")).alias("g"), S.or_nothing(F.col("c")).alias("c"), S.eval_text(F.col("d")).alias("d"), S.radio_band(F.lit(5.0)).alias("band"), S.energy_to_ujy(F.lit(1e-12), F.array(F.lit(0.5), F.lit(10.0))).alias("e"), S.cost(F.lit(10), F.lit(5), 1.0, 2.0).alias("cost")).first()
    assert (r.raw, r.n, r.p, r.g, r.c, r.d, r.band) == ("12", 12, None, "GRB 200101A", None, "type ia", "radio-6GHz")
    assert r.e == pytest.approx(1e-12 / (9.5 / 4.135667696e-18) / 1e-29) and r.cost == pytest.approx(2e-5)


def test_cones(spark):
    points = spark.createDataFrame([(1, 100.0, 0.0), (2, 100.0, 0.001), (3, 359.9999, 0.0), (4, None, None), (5, 0.0001, 0.0), (6, 10.0, 89.9999), (7, 190.0, 89.9999)], "id int, ra double, dec double")
    assert [r.id for r in sky.cone(points, 100.0, 0.0, 10.0).collect()] == [1, 2]
    pairs = sky.cone_join(points, points.select(F.col("id").alias("id2"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2")), 5.0).filter("id < id2")
    assert {(r.id, r.id2) for r in pairs.collect()} == {(1, 2), (3, 5), (6, 7)}


def test_fusion(spark, bulletins):
    edges = fusion.xref_edges(bulletins)
    seeds = bulletins.filter("circular_id = 3")
    assert {(r.circular_id, r.hop) for r in fusion.walk(edges, bulletins, seeds, 5).collect()} == {(3, 0), (2, 1), (1, 2)}
    assert fusion.walk(edges, bulletins, seeds, 0).count() == 1
    found = extract.extract(bulletins)
    acted = {(r.circular_id, r.row_ord): r for r in fusion.actions(found, {"sdssr": 7}).collect()}
    assert acted[(1, 0)].instrument_id == 7 and acted[(1, 0)].reason == "mjd" and acted[(1, 0)].limiting_mag_assumed
    timed = found.withColumn("photometry", F.transform("photometry", lambda p: p.withField("obs_mjd", F.lit(60000.0))))
    done = {(r.circular_id, r.row_ord): r for r in fusion.actions(timed, {"sdssr": 7}).collect()}
    assert done[(1, 0)].reason is None and done[(2, 0)].reason == "instrument"
    assert {r.circular_id: r.dropped for r in fusion.drop_reasons(fusion.actions(timed, {"sdssr": 7})).collect()} == {2: "instrument: 1"}
    assert fusion.source_rows(found).first().obj_id == "GRB240101A"
    rows = spark.createDataFrame([("e", 1, 1.0, 2.0, 0), ("e", 2, 3.0, 4.0, 1), ("e", 3, 5.0, 6.0, 1)], "g string, o int, ra double, dec double, score int")
    assert fusion.best_position(rows, "g", "o").first()[1:] == (3.0, 4.0)
    assert fusion.first_value(rows, "g", "ra", "o").first().ra == 1.0


def test_evaluation(spark):
    row = "array<struct<filter:string,mag:double,lim:double>>"
    df = spark.createDataFrame([([("r", 18.0, None), ("r", 18.04, None)], [("r", 18.02, None), ("g", 18.0, None)]), ([], []), ([("r", None, 20.0)], [("r", None, 20.15)])], f"gold {row}, pred {row}")
    assert [tuple(r.m) for r in df.select(evaluate.greedy_matches(F.col("gold"), F.col("pred")).alias("m")).collect()] == [(1, 1, 1), (0, 0, 0), (1, 0, 0)]
    out = spark.createDataFrame([("f", "MM"), ("f", "TP"), ("g", "TN"), ("h", "MM")], "field string, outcome string")
    got = {r.field: r for r in evaluate.metrics(out, "field").collect()}
    assert (got["f"].precision, got["f"].recall, got["f"].f1) == (0.5, 0.5, 0.5) and got["g"].precision is None and got["h"].f1 is None
    assert "| f |" in writers.report(evaluate.metrics(out, "field").orderBy("field"))
    pred = spark.createDataFrame([(1, "a"), (2, "b")], "circular_id int, p string")
    gold = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (3, "z", 2)], "circular_id int, g string, ord int")
    assert [(r.circular_id, r.g) for r in evaluate.join_gold(pred, gold).collect()] == [(1, "y")]
    names_ = spark.createDataFrame([(["a"], ["b", "a"]), ([], ["a"]), (["a"], []), ([], [])], "g array<string>, p array<string>")
    assert [r[0] for r in names_.select(evaluate.names_outcome(F.col("g"), F.col("p"))).collect()] == ["TP", "FP", "FN", "TN"]
    assert evaluate.first_failures(out.withColumn("o", F.lit(1)), "field", "o", 1).count() == 2


def test_naive_bayes(spark):
    rows = spark.createDataFrame([("type Ia supernova spectrum", "Ia"), ("a type Ia here", "Ia"), ("optical afterglow of the burst", "NONE"), ("the burst afterglow", "NONE")], "text string, label string")
    model = classify.fit(rows, min_count=1)
    texts = spark.createDataFrame([(1, "seems type Ia"), (2, "the afterglow burst"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.predicted for r in classify.predict(classify.score(texts, model, "id"), "id").collect()}
    assert got[1] == "Ia" and got[2] is None
    local = classify.local_classifier(model)
    assert {i: local(t or "") for i, t in ((1, "seems type Ia"), (2, "the afterglow burst"), (3, ""))} == {k: got[k] for k in (1, 2, 3)}
    assert classify.weak_label("The spectrum shows a type Ia supernova") == "Ia" and classify.weak_label("type Ia (short) burst") is None
    assert classify.weak_label("optical detection " * 20) == "NONE"


def test_chunks_and_labels(spark):
    text = "\n\n".join("abcdefgh" for _ in range(6))
    df = spark.createDataFrame([(text,), ("x" * 50,), ("short",)], "t string")
    got = [r[0] for r in df.select(labels.chunks(F.col("t"), 20, 20, 4)).collect()]
    assert got[0][0] == "abcdefgh\n\nabcdefgh" and got[0][1].startswith("efgh\n\nabcdefgh") and got[1] == ["x" * 50] and got[2] == ["short"]
    spans = spark.createDataFrame([("one two one", "two"), ("one two one", "one"), ("ab", "ab")], "b string, v string")
    assert [r[0] and (r[0].start, r[0].end) for r in spans.select(labels.backfill_span(F.col("b"), F.col("v"))).collect()] == [(4, 7), None, None]


def test_routing(spark, bulletins):
    regex = extract.extract(bulletins)
    model = regex.filter("circular_id = 2").withColumn("redshift", F.col("redshift").withField("redshift", F.lit(9.0)))
    got = {r.circular_id: r for r in labels.route(regex, model).collect()}
    assert got[2].redshift.redshift == 9.0 and got[1].redshift.redshift == 1.5 and len(got[1].photometry) == 1 and "redshift.redshift" in got[2].provenance


def test_backend_cache(spark, bulletins, tmp_path):
    cache = spark.createDataFrame([], backends.CACHE)

    def client(prompt: str) -> tuple[str, int, int]:
        if "noise" in prompt:
            raise OSError("down")
        return '{"redshift": {"redshift": 1.0, "x": null}, "classification": "sn ia", "provenance": {"redshift": {"start": 0, "end": 3}, "bad": {"start": 5, "end": 1}}}', 3, 2

    answers, fresh = backends.call(bulletins, cache, client, "m", "v", "1")
    assert fresh.count() == 3 and answers.count() == 3
    fresh.write.parquet(str(tmp_path / "cache"))
    answers, fresh = backends.call(bulletins, spark.read.parquet(str(tmp_path / "cache")), client, "m", "v", "1")
    assert fresh.count() == 0 and answers.filter("cache_hit").count() == 3
    tidy = backends.sanitise(client("")[0], "abcdef")
    assert tidy == {"redshift": {"redshift": 1.0}, "classification": {"classification": "Ia"}, "provenance": {"redshift": {"start": 0, "end": 3, "snippet": "abc"}}}
    assert backends.sanitise("no json", "") is None


def test_sampling(spark):
    df = spark.createDataFrame([("date filter mag", 1), ("R > 20.1", 2), ("spectroscopic z = 1.2", 3), ("r = 18.2", 4), ("nothing", 5), ("IceCube-191001A", 6), ("a 3 sigma upper limit", 7)], "b string, i int")
    got = {r.i: r.s for r in df.select("i", sampling.stratum(F.col("b")).alias("s")).collect()}
    assert got == {1: "multi_row_mag_table", 2: None, 3: "spec_z_classification", 4: "single_row_mag", 5: None, 6: "gw_neutrino_counterpart", 7: "photometric_upper_limit"}


def test_readers(spark, tmp_path):
    one = {"circularId": 5, "subject": "s", "eventId": "", "body": "b"}
    (tmp_path / "a.json").write_text(json.dumps([one, one | {"circularId": 6}]))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(one | {"circularId": i}) for i in (7, 8)))
    assert readers.read_records(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert readers.read_records(spark, str(tmp_path)).count() == 4
    assert readers.to_circulars(readers.read_records(spark, str(tmp_path / "a.json"))).first().event_id is None
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_records(spark, "x.csv")
    (tmp_path / "t.csv").write_text("Circular ID,Subject,Date,Label\n12.0,a,2024-01-01 00:00:00,Optical\n-4.0,b,,x\n1.5,c,,x\n")
    assert [r.circular_id for r in readers.read_topics(spark, str(tmp_path / "t.csv")).collect()] == [12]
    (tmp_path / "g.csv").write_text('Circular Number,Text,Actual Redshift,Predicted Redshift\n1,"two\nlines ""q""",1.5,No Information\n')
    assert readers.read_gold(spark, str(tmp_path / "g.csv")).first()[1:] == ('two\nlines "q"', "1.5", None)
    writers.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1}'


def test_plan(spark):
    sources = spark.createDataFrame([("a", 1.0)], "obj_id string, ra double")
    points = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "obj_id string, mag double")
    none = spark.createDataFrame([], "obj_id string, redshift double")
    plan = writers.post_plan(sources, points, none, none.withColumnRenamed("redshift", "text"))
    assert [(r.obj_id, r.seq, r.method) for r in plan.orderBy("obj_id", "seq").collect()] == [("a", 0, "POST"), ("a", 1, "POST")]
    assert [x["ok"] for x in writers.execute_plan(plan)] == [None, None]
    assert [x["ok"] for x in writers.execute_plan(plan, lambda *a: {"status": "error"}, live=True, token="t")] == [False, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "r", 1.00), ("a", "r", 1.01), ("a", "r", 1.029), ("a", "g", 1.01), ("b", "r", 1.0), ("a", "r", 2.0), ("a", "r", 2.015)]
    schema = "obj_id string, filter string, mjd double"
    for k in range(2):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    points = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = consume.dedup_stream(points).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in consume.dedup_batch(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in spark.table("kept").collect()} == want and len(want) == 5
    known = spark.createDataFrame([("a", "r", 1.01), ("a", "r", 1.0)], schema)
    points = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "obj_id string, band string, obs_mjd double, k int")
    new = events.new_points(points, known, "k")
    assert {r.k for r in new.collect()} == {3, 4, 5}
    back = points.withColumn("k", -F.col("k"))  # the last comes first
    assert {-r.k for r in events.new_points(back, known, "k").collect()} == {3, 4, 6}


def record(number: int, subject: str, body: str) -> dict:
    return {"circularId": number, "subject": subject, "body": body, "createdOn": 1000 * number}


FLURRY = [
    record(1, "GRB 240101A: GBM detection", "A gamma-ray burst triggered. RA = 10.500, Dec = -3.250. See GCN 2."),
    record(2, "GRB 240101A: optical counterpart", "AT2024ab is at RA = 10.123, Dec = -3.456. We observed on 2024-01-02 00:00:00. r = 18.00 +/- 0.10. The photometric redshift of 0.5 holds. See GCN 1 and GCN 9."),
    record(3, "GRB 240101A: spectrum", "Spectroscopic data on 2024-01-02 00:10:00, observed with Keck, give z = 1.234. g = 18.50 +/- 0.10. See GCN 2."),
]


def test_fused_event(spark):
    bulletins = readers.to_circulars(spark.createDataFrame(FLURRY, schemas.RECORD))
    seeds = bulletins.filter("circular_id in (1, 3)")
    groups = fusion.walk(fusion.xref_edges(bulletins), bulletins, seeds, 2)
    found = extract.extract(bulletins)
    got, points = events.fuse(found, bulletins, groups, {"sdssr": 1, "sdssg": 2})
    by = {r.seed: r for r in got.collect()}
    assert (by[1].obj_id, by[1].ra, by[1].dec, by[1].redshift, by[1].status) == ("GRB240101A", 10.123, -3.456, 0.5, "posted")
    assert by[3].redshift == 1.234 and by[3].n_points == 2 and by[3].withdrawn == []
    assert sorted((r.seed, r.circular_id, r.band, r.obj_id) for r in points.collect()) == [(1, 2, "sdssr", "GRB240101A"), (3, 2, "sdssr", "GRB240101A"), (3, 3, "sdssg", "GRB240101A")]
    none, left = events.fuse(found, bulletins, groups, {"sdssr": 1})
    reasons = {r.seed: r.comments for r in none.collect()}
    assert any("1 photometry row(s) could not be posted (1x instrument)" in c for c in reasons[3]) and left.count() == 2
    gone = readers.to_circulars(spark.createDataFrame([*FLURRY, record(4, "Retraction of GRB 240101A", "See GCN 3.")], schemas.RECORD))
    groups = fusion.walk(fusion.xref_edges(gone), gone, gone.filter("circular_id = 4"), 3)
    after, points = events.fuse(extract.extract(gone), gone, groups, {"sdssr": 1, "sdssg": 2})
    row = after.first()
    assert points.isEmpty() and row.withdrawn == [4] and row.comments[-1].startswith("A circular withdraws this counterpart (GCN 4)") and len(row.comments) == len(set(row.comments))


def test_consume(spark, tmp_path):
    """A bulletin at a time: what comes again adds nothing, a near point is the same one, a retraction posts nothing."""
    corpus = readers.to_circulars(spark.createDataFrame(FLURRY[:2], schemas.RECORD))
    more = [FLURRY[2], FLURRY[2] | {"body": FLURRY[2]["body"]}, record(5, "GRB 240101A", "Observed on 2024-01-02 00:05:00. r = 18.02 +/- 0.10. See GCN 2."), record(6, "GRB 240101A is not a GRB", "See GCN 5.")]
    (tmp_path / "in").mkdir()
    posted, status = [], {}
    prime = lambda objs: objs.select("obj_id", F.lit("sdssg").alias("filter"), F.lit(60311.0).alias("mjd"))

    def post(done, points, epoch):
        posted.extend((epoch, r.circular_id, r.band) for r in points.collect())
        status.update({(epoch, r.seed): (r.status, r.posted, r.repeated) for r in done.collect()})

    state = str(tmp_path / "state")
    for epoch, x in enumerate(more):
        new = readers.to_circulars(spark.createDataFrame([x], schemas.RECORD))
        post(*consume.update(new, corpus, state, epoch, {"sdssr": 1, "sdssg": 2}, prime=prime), epoch)
        corpus = corpus.join(new, "circular_id", "left_anti").unionByName(new)
    assert posted == [(0, 2, "sdssr")]  # the object's g point is known downstream
    assert status == {(0, 3): ("posted", 1, 1), (1, 3): ("posted", 0, 2), (2, 5): ("posted", 0, 2), (3, 6): ("nothing-postable", 0, 0)}
    (tmp_path / "in/3.json").write_text(json.dumps(FLURRY[2]))
    stream = readers.to_circulars(readers.replay(spark, str(tmp_path / "in")))
    seen = []
    start = readers.to_circulars(spark.createDataFrame(FLURRY[:2], schemas.RECORD))
    consume.consume(stream, start, lambda done, points, n: seen.extend((r.circular_id, r.band) for r in points.collect()), str(tmp_path / "cp"), {"sdssr": 1, "sdssg": 2}).awaitTermination(120)
    assert sorted(seen) == [(2, "sdssr"), (3, "sdssg")]


def test_scaffold_and_archive(spark, bulletins, tmp_path):
    row = labels.scaffold(bulletins.filter("circular_id = 3")).first()
    assert row.source.endswith("---\nIt was noise. See GCN 2.") and json.loads(row.label)["photometry"] == [] and "redshift" in json.loads(row.label)
    capped = labels.cap_arrays(json.loads(schemas.json_schema()))
    assert capped["properties"]["photometry"]["maxItems"] == 15
    (tmp_path / "1.json").write_text("{}")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "1.json", "archive.json/1.json")
    out = readers.untar(spark, str(tmp_path / "a.tar.gz"), str(tmp_path / "out"))
    assert readers.untar(spark, "missing", out) == out and readers.read_records(spark, out).count() == 1


class _Fake:
    """A sender that remembers what it was sent."""

    def __init__(self, answer: dict):
        self.answer, self.sent = answer, []

    def __call__(self, url: str, payload: dict, headers: dict) -> dict:
        self.sent.append(payload)
        return self.answer


def test_model_clients(spark):
    told = {"redshift": {"redshift": 0.5}}
    tool = _Fake({"content": [{"type": "tool_use", "input": told}], "usage": {"input_tokens": 7, "output_tokens": 3}})
    assert models.ToolCaller("u", "m", send=tool)("text") == (json.dumps(told), 7, 3)
    assert tool.sent[0]["tool_choice"]["name"] == "record" and set(tool.sent[0]["tools"][0]["input_schema"]["properties"]) == set(models.ASKED)
    rows = models.answer_schema()["properties"]["photometry"]
    assert len(rows["items"]["properties"]) == 13 and rows["maxItems"] == 15 and rows["items"]["properties"]["filter"]["maxLength"] == 128
    mode = _Fake({"response": "{}", "prompt_eval_count": 1, "eval_count": 2})
    assert models.JsonMode("u", "m", send=mode)("x") == ("{}", 1, 2) and mode.sent[0]["format"] == "json"
    held = _Fake({"content": "{}", "tokens_evaluated": 1, "tokens_predicted": 2})
    assert models.Constrained("u", send=held)("x") == ("{}", 1, 2) and held.sent[0]["json_schema"]["type"] == "object"
    assert models.prompt("a body").endswith("a body\nRecord:\n") and models.prompt("").count("Record:") == 1 + len(models.SHOTS)


def test_model_records(spark, bulletins):
    """Answers become records that are dated by the trigger after the cache; no answer is an empty record with a note."""
    told = {"event": {"event_name": "GRB 240101A"}, "photometry": [{"filter": "r", "mag": 18.5, "obs_mjd": None}, "junk"], "time_offsets": [{"value": 2, "unit": "h", "reference": "trigger"}], "classification": "tde"}

    def client(text: str) -> tuple[str, int, int]:
        if "GCN 2" in text:
            raise OSError("down")
        return json.dumps(told), 5, 6

    answers, _ = backends.call(bulletins, spark.createDataFrame([], backends.CACHE), client, "m", "v", "1")
    got = {r.circular_id: r for r in models.records(bulletins, answers).collect()}
    assert len(got) == 4 and got[3].event is None and got[3].extraction_meta.notes[0] == "error: no answer"
    assert got[1].event.event_name == ["GRB 240101A"] and got[1].classification.taxonomy_path[-1] == "Tidal Disruption Event" and got[1].extraction_meta.tokens_in == 5
    assert got[1].photometry[0].obs_time == "2024-01-01T02:00:00Z" and len(got[1].photometry) == 1
    assert extract.failures(models.records(bulletins, answers)).first()[:] == (4, 1)


def test_files_and_reports(spark, bulletins, tmp_path):
    out = str(tmp_path / "x")
    assert writers.write_extractions(extract.extract(bulletins), out) == 4
    assert json.loads((tmp_path / "x/000001.extraction.json").read_text())["redshift"]["redshift"] == 1.5
    assert writers.write_scaffold(labels.scaffold(bulletins), out) == 8 and (tmp_path / "x/3.source.md").exists()
    plan = spark.createDataFrame([("a", 0, "POST", "/p", "{}"), ("a", 1, "POST", "/q", "{}")], "obj_id string, seq int, method string, path string, payload string")
    assert writers.render_plan(plan) == "POST /p\n  {}\nPOST /q\n  {}"
    bad = lambda *a: {"status": "error"}
    assert len(writers.execute_plan(plan, bad, live=True, token="t", continue_on_error=False)) == 1 and len(writers.execute_plan(plan, bad, live=True, token="t")) == 2
    assert writers.clipped("x" * 100) == '"' + "x" * 76 + "..." and writers.clipped(None) == "null"
    told = spark.createDataFrame([(1, "FN", "redshift", "1.5", None)], "circular_id long, outcome string, field string, gold string, pred string")
    text = writers.report(evaluate.metrics(told, "field"), told, told.groupBy("field").count())
    drawn = ElementTree.fromstring(writers.plot(evaluate.metrics(told, "field")))
    assert sum(x.tag.endswith("rect") for x in drawn) == 6 and drawn[-1].text == "1"
    assert "## Fields" in text and "## Run" in text and "- redshift of 1: FN" in text


def test_versions_of_a_store(spark, bulletins, tmp_path):
    path = str(tmp_path / "store")
    rows = store.rows(extract.extract(bulletins), 1)
    assert store.save(spark, rows, path) == 1
    assert store.save(spark, store.put(store.load(spark, path), store.rows(extract.extract(bulletins), 2)), path) == 2
    assert store.count(store.load(spark, path)) == 4 and {r.created_at for r in store.load(spark, path).collect()} == {2} and store.count(store.load(spark, path, 1)) == 4
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    now = spark.createDataFrame([], "k int, v string, record_hash string")
    assert upsert.upsert(now, twice, "k", "v")[0].count() == 1


def test_stored_postings(spark, bulletins, tmp_path):
    path = str(tmp_path / "p")
    search.write_postings(bulletins, path)
    for terms in (["optical counterpart"], ["z", "20.0"], ["of grb"], ["counterpart optical"], ["nowhere"]):
        want = {r.circular_id for r in search.index(bulletins).filter(search.matches(terms)).collect()}
        assert {r.circular_id for r in search.stored_hits(spark, path, terms).collect()} == want
    long = spark.createDataFrame([("a " * 40 + "needle in hay",)], "subject string")
    got = long.select(search.snippet(["needle"]).alias("s")).first().s
    assert "[needle] in hay" in got and len(got.split()) == 18


def test_sources_in_order(spark, tmp_path):
    for name in ("10", "9", "note"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"circularId": int(name) if name.isdigit() else None, "subject": name}))
    spark.dataSource.register(readers.BulletinFolder)
    stream = spark.readStream.format("bulletin-folder").option("folder", str(tmp_path)).option("most", 2).load()
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.circularId for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [9, 10]
    assert [r.file for r in readers.archive(spark, str(tmp_path)).filter("circularId is not null").collect()] == ["10.json", "9.json"]
    raw = spark.createDataFrame([('{"circularId": 5, "subject": "s"}',), ("junk",), ("{}",)], "value string")
    got = [(r.circularId, r.bad) for r in readers.messages(raw).collect()]
    assert got == [(5, None), (None, "junk"), (None, "{}")]
    known = spark.createDataFrame([(1, "x"), (2, "y")], "circular_id long, body string")
    rows, missing = readers.found_and_missing(known, spark.createDataFrame([(2, 0), (7, 1)], "circular_id long, ord int"))
    assert [r.circular_id for r in rows.collect()] == [2] and missing == 1
    readers.to_parquet(readers.read_records(spark, str(tmp_path / "9.json")), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1
    gold = spark.createDataFrame([(1, "1.5 or so", "200101A", None, "Spectroscopic", "2.0")], "circular_id long, redshift string, event string, telescope string, measure string, pred_redshift string")
    stated, told = readers.gold_pairs(gold)
    assert stated.first()[1:] == ("GRB 200101A", 1.5, None, "spectroscopic") and told.first().redshift == 2.0


def test_taxonomy_folder(spark, tmp_path):
    (tmp_path / "top.yaml").write_text("class: Root\nsubclasses:\n  - ref: a.yaml\n  - ref: gone.yaml\n  - class: B\n    other names: [bee, sn x]\n")
    (tmp_path / "a.yaml").write_text("class: A\nother names: [SN X]\nsubclasses:\n  - class: A1\n")
    aliases, paths = readers.taxonomy_tables(spark, str(tmp_path))
    names = {r.alias_lower: r.canonical for r in aliases.collect()}
    assert names["sn x"] == "A" and names["bee"] == "B" and names["gone-placeholder"] == "gone-placeholder"
    assert {r["class"]: r.path for r in paths.collect()}["A1"] == ["Root", "A", "A1"]
    from alertframe.text import taxonomy

    built = taxonomy.builtin()
    assert len(built) == 177 and len(taxonomy.paths_of(built)) == 176 and taxonomy.names_of(built)["snibn"] == "Ibn"


def test_spans_of_lists(spark):
    body = "first 18.50 here\nthen 19.50 and 20.50\n19.50 again"
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(labels.anchor_rows(F.col("b"), F.array(*map(F.lit, ("18.50", "19.50", "20.50")))).alias("a")).first().a
    assert [x and (x.start, x.snippet) for x in got] == [(0, "first 18.50 here"), None, (17, "then 19.50 and 20.50")]
    rows = spark.createDataFrame([(1, ["a", "b"], {})], "circular_id long, names array<string>, provenance map<string,struct<start:int,end:int,snippet:string>>")
    assert labels.label_view(rows, {"event.names": "names"}).first().value == "a, b"


def test_command_line(tmp_path, capsys, spark, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda *a, **k: spark)
    source = tmp_path / "r.jsonl"
    source.write_text("\n".join(json.dumps(x) for x in FLURRY))
    assert cli.main(["post", str(source), "2", "--instruments", '{"sdssr": 1}']) == 0
    assert "POST /api/sources" in capsys.readouterr().out
    assert cli.main(["index", str(source), str(tmp_path / "i")]) == 0 and store.count(store.load(spark, str(tmp_path / "i/store"))) == 3
    assert cli.main(["label-scaffold", str(source), str(tmp_path / "l")]) == 0 and len(list((tmp_path / "l").iterdir())) == 6
    assert cli.main(["annotate", str(source), str(tmp_path / "v")]) == 0
    assert cli.main(["dataset", str(source), str(tmp_path / "d"), "--val-every", "2"]) == 0 and spark.read.text(str(tmp_path / "d/val")).count() == 2
    found = extract.extract(readers.to_circulars(readers.read_records(spark, str(source))))
    writers.write_jsonl(found, str(tmp_path / "p"))
    assert cli.main(["eval", str(tmp_path / "p"), str(tmp_path / "p"), str(tmp_path / "report.md")]) == 0
    assert "| redshift | 2 | 0 | 0 |" in (tmp_path / "report.md").read_text()
    assert cli.main(["label-validate", str(source)]) == 0


def test_classifier_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} common words {i}", str(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, text string, label string")
    score = lambda: sorted((r.k, r.label, round(r.score, 9)) for r in classify.score(df.unionByName(df.limit(1).select(F.lit(99).alias("k"), F.lit(None).cast("string").alias("text"), "label")), classify.fit(df), "k").collect())
    one = score()
    monkeypatch.setattr(classify, "BROADCAST_FEATURES", 0)
    assert one == score() and len(one) == 82
    assert [r.rank for r in classify.ranked(df.filter("k < 0"), "k").collect()] == []
