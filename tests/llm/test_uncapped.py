"""Operators without caps against plain versions: long runs, whole lines, complete fillings, trees and disclosures."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alertframe.llm import bag_minhash, line_dedup, packing, pii, positional_index, quality_rules, token_counts, tokens, toxicity, url_filter
from alertframe.llm.common import write_table

from .helpers import SF, bag, clashing, corpus, frame
from .test_native_ops import plain_spans, plain_url
from .test_token_ops import ids_of

N = 100_000


@pytest.mark.parametrize("text", [" " * N, "\n" * N, "1" * N, "a" * N, "\u65e5\u672c" * (N // 2), " \n" * (N // 2), "<|endoftext|>" * 3000])
def test_counts_of_long_runs(text):
    c = token_counts.PrefixCounter(tokens.vocab_path())
    began = time.time()
    got = c.prefix_counts(text)
    assert time.time() - began < 3
    for k in (0, 1, 7, 100, 1001, len(text) // 3, len(text) - 1, len(text)):
        assert got[k] == len(ids_of(text[:k]))


def test_counts_keep_within_budget():
    c = token_counts.PrefixCounter(tokens.vocab_path(), room=2000)
    r = random.Random(1)
    for _ in range(60):
        t = " ".join("".join(r.choice("abcde-") for _ in range(r.randint(1, 90))) for _ in range(8))
        assert c.prefix_counts(t)[-1] == len(ids_of(t))
        assert c.held <= 2000 + 16 * 200 and c.filled <= 2000 + len(t)


def test_marginals_of_long_lines():
    """Messages cross the cuts: as a token at a time, chain by chain."""
    r = np.random.default_rng(0)
    for n in (1, 2, 17, 700, 5000):
        e, first, trans = 3 * r.normal(size=n), r.random(n) < 0.003, r.normal(size=(2, 2))
        first[0] = True
        got, pair = toxicity.forward_backward(e, first, trans)
        t, want, pairs = np.exp(trans), np.empty(n), np.zeros((2, 2))
        cuts = [*np.flatnonzero(first), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = np.stack([np.ones(b - a), np.exp(e[a:b])], axis=1)
            f, back = x / x.sum(axis=1, keepdims=True), np.full((b - a, 2), 0.5)
            for k in range(1, b - a):
                f[k] = (f[k - 1] @ t) * x[k] / ((f[k - 1] @ t) * x[k]).sum()
            for k in range(b - a - 2, -1, -1):
                back[k] = t @ (x[k + 1] * back[k + 1])
                back[k] /= back[k].sum()
            want[a:b] = (f * back)[:, 1] / (f * back).sum(axis=1)
            for k in range(1, b - a):
                j = f[k - 1][:, None] * t * (x[k] * back[k])[None]
                pairs += j / j.sum()
        assert np.allclose(got, want) and np.allclose(pair, pairs)


def test_toxic_ties(spark):
    """Labels of both classes for one document count in both; a score of 0.5 is predicted 1 by the query's rule."""
    rows = [(i, f"fine words {i} {'vile' if i % 2 else 'good'}", "", "", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, rows), model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60))


def test_completions_are_all_and_undominated():
    r = random.Random(3)
    for _ in range(60):
        counts = np.zeros(40, np.int64)
        for x in r.sample(range(1, 30), r.randint(2, 7)):
            counts[x] = r.randint(1, 2)
        room = r.randint(1, 35)
        items = [x for x in range(40) for _ in range(counts[x])]
        subsets = {tuple(sorted((items[i] for i in range(len(items)) if k >> i & 1), reverse=True)) for k in range(1 << len(items))}

        def dominated(f: tuple[int, ...]) -> bool:
            left = Counter(items) - Counter(f)
            for k in range(1 << len(f)):
                part = [f[i] for i in range(len(f)) if k >> i & 1]
                spare = room - sum(f)
                if any(x > sum(part) and x <= sum(part) + spare or (len(part) > 1 and x == sum(part)) for x in left):
                    return True
            return False

        want = {f for f in subsets if sum(f) <= room and not dominated(f)}
        got = list(packing.Completions(counts, room, [10**6]).within(room, 1))
        assert len(got) == len(set(got)) and set(got) == want


def test_packing_meets_the_bound(spark):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    r = got.agg(F.count_distinct("sequence_id").alias("n"), F.sum("length").alias("t"), F.max("over_bound").alias("over")).first()
    assert r.n <= -(-r.t // 1024) + 1 + r.over and r.over <= 1


def test_template_family_does_not_meet(spark):
    """Texts that share a template alone: no link, and none of them is held against another."""
    r = random.Random(2)
    template = [f"t{k}" for k in range(140)]
    word = lambda: f"u{r.randint(0, 10**9)}"
    rows = [(i, " ".join(template + [word() for _ in range(60)]), "", "", 0) for i in range(200)]
    got = bag_minhash.near_duplicates(frame(spark, rows)).collect()
    assert all(x.class_id == x.doc_id and x.n_links == 0 and x.similarity is None for x in got)
    texts = frame(spark, rows).select(F.unhex(F.md5("text")).alias("node"), F.unhex(F.md5("text")).alias("comp"), "text")
    met = bag_minhash.rare_shingles(texts, 0.8, 5).groupBy("key").agg(F.count_distinct("comp").alias("n")).filter("n > 1")
    assert met.isEmpty()


def test_rare_shingles_lose_no_link(spark):
    rows = [x for x in corpus(4) if bag(x[1])]
    texts = frame(spark, rows).select(F.unhex(F.md5("text")).alias("node"), F.unhex(F.md5("text")).alias("comp"), "text")
    keys = defaultdict(set)
    for x in bag_minhash.rare_shingles(texts, 0.8, 5).collect():
        keys[bytes(x.node)].add(x.key)
    import hashlib

    bags = {hashlib.md5(t.encode()).digest(): bag(t) for t in {x[1] for x in rows}}
    near = 0
    for a, x in bags.items():
        for b, y in bags.items():
            shared = (x & y).total()
            if a < b and shared >= 0.8 * (x.total() + y.total() - shared):
                near += 1
                assert keys[a] & keys[b]
    assert near > 5


def test_recall_of_queries(spark):
    """Of every pair of sf0.001 with a text whose id is divisible by 50, at 0.8: all are in one class, with links given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {x.doc_id: x for x in bag_minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    bags = {int(x.doc_id): bag(x.text) for x in docs.itertuples()}
    found = total = 0
    for a in (i for i in bags if i % 50 == 0 and bags[i]):
        for b, y in bags.items():
            shared = (bags[a] & y).total()
            if a != b and y and shared >= 0.8 * (bags[a].total() + y.total() - shared):
                total += 1
                found += got[a].class_id == got[b].class_id
    assert found >= 0.9 * total
    for x in got.values():
        assert (x.similarity is None) == (x.n_links == 0) and (x.similarity is None or 0.8 <= x.similarity <= 1)


def plain_tree(pages: list[str], z: float = 1.96, pseudo: float = 4.0) -> dict[str, tuple[str, float]]:
    """url -> (template, purity), by recursion on each host."""

    def shape(path: str) -> tuple[str, ...]:
        out = []
        for x in [p for p in path.split("/") if p]:
            if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", x):
                out.append("{n}")
            elif re.fullmatch(r"[0-9A-Fa-f-]{8,}", x):
                out.append("{x}")
            elif len(x) > 48:
                out.append("{long}")
            elif re.search(r"[0-9].*[0-9].*[0-9]", x):
                out.append("{v}")
            else:
                out.append(x.lower())
        return tuple(out)

    verdicts = {"com/en/": 1, "example.com/en/7": 0, "net/de/": 0, "example.net/de/8": 1, "org/es/": 1}
    hosts: dict[str, dict] = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    where = {}
    for u in pages:
        host, path, rule = plain_url(u)
        where[u] = host, shape(path)
        cell = hosts[host][shape(path)]
        cell[0] += 1
        if rule:
            cell[1 if verdicts[rule] else 2] += 1
    template: dict = {}

    def alike(branch: Counter, pool: Counter) -> bool:
        t, m = branch.total(), pool.total()
        ways = set(branch) | set(pool)
        g = sum(x * math.log(x * (t + m) / ((branch[w] + pool[w]) * own)) for w in ways for x, own in ((branch[w], t), (pool[w], m)) if x)
        free = len(ways) - 1
        v = 2 / (9 * max(free, 1))
        return free == 0 or 2 * g <= max(free, 1) * (1 - v + z * math.sqrt(v)) ** 3

    def grow(host: str, node: tuple[str, ...], rows: dict, k: int) -> None:
        if len(rows) == 1:
            (s, (_, b, a)), = rows.items()
            template[host, s] = node + tuple("*" if b + a else x for x in s[k:])
            return
        kids: dict = defaultdict(dict)
        for s, c in rows.items():
            kids[s[k] if len(s) > k else None][s] = c
        count = lambda r, j: sum(c[j] for c in r.values())
        known = {x: count(r, 1) + count(r, 2) for x, r in kids.items()}
        pb, pn = sum(count(r, 1) for r in kids.values()), sum(known.values())
        ways = {x: Counter() for x in kids if x is not None}
        for x in ways:
            for s, c in kids[x].items():
                ways[x][s[k + 1] if len(s) > k + 1 else ""] += c[0]
        pool = sum((ways[x] for x in ways if known[x]), Counter())
        nxt: dict = defaultdict(dict)
        for x, r in kids.items():
            if x is None:
                for s in r:
                    template[host, s] = node
                continue
            if known[x]:
                share = pb / pn
                merge = abs(count(r, 1) / known[x] - share) <= z * math.sqrt(share * (1 - share) * (1 / known[x] + 1 / pn))
            else:
                merge = bool(pool) and alike(ways[x], pool)
            nxt[(*node, "*" if merge else x)] |= r
        for name, r in nxt.items():
            done = {s: c for s, c in r.items() if len(s) <= k + 1}
            rest = {s: c for s, c in r.items() if len(s) > k + 1}
            if rest and not done:
                grow(host, name, rest, k + 1)
            elif rest:
                grow_with(host, name, r, k + 1)
            else:
                grow(host, name, done, k + 1) if len(done) == 1 else [template.__setitem__((host, s), name) for s in done]

    grow_with = grow
    for host, rows in hosts.items():
        grow(host, (), rows, 0)
    b = {h: sum(c[1] for c in r.values()) for h, r in hosts.items()}
    n = {h: sum(c[1] + c[2] for c in r.values()) for h, r in hosts.items()}
    rate = sum(b.values()) / max(1, sum(n.values()))
    sums: dict = defaultdict(lambda: [0, 0])
    for (h, s), t in template.items():
        sums[h, t][0] += hosts[h][s][1]
        sums[h, t][1] += hosts[h][s][1] + hosts[h][s][2]
    out = {}
    for u, (h, s) in where.items():
        prior = (b[h] + pseudo * rate) / (n[h] + pseudo)
        t = template[h, s]
        out[u] = "/" + "/".join(t), (sums[h, t][0] + pseudo * prior) / (sums[h, t][1] + pseudo)
    return out


def test_url_tree_recomputed(spark):
    from alertframe.llm.queries import RULES

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").dropDuplicates(["url"]).filter("url is not null")
    urls = [r.url for r in pages.collect()]
    want = plain_tree(urls)
    got = url_filter.judge(pages, RULES).join(pages, "page_id").collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    for r in got:
        assert r.template == want[r.url][0] and abs(r.purity - want[r.url][1]) < 1e-9
        assert r.rule is not None or r.verdict == ("block" if want[r.url][1] >= 0.5 else "allow")


def test_url_tree_exchanges(spark, monkeypatch):
    """Each exchange costs the driver memory; a tree of few rows takes none, and a tree that is not gathered is the same."""
    from alertframe.llm.queries import RULES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    odd = [None, "", "http://com", "http://a.com//en//1", "http://deep.org/" + "/".join("abcdefgh") + "/1", "http://deep.org/" + "/".join("abcdefgx") + "/1"]
    pages = pages.union(spark.createDataFrame([(-i, u) for i, u in enumerate(odd)], "page_id long, url string")).union(pages.limit(3))
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
    before = ids()
    want = sorted(map(repr, url_filter.judge(pages, RULES).collect()))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    graphs = [store.planGraph(x).allNodes() for x in ids() - before]
    names = [g.apply(i).name() for g in graphs for i in range(g.size())]
    assert len(graphs) > 5 and sum(n in ("Exchange", "BroadcastExchange") for n in names) <= 5
    assert len(want) == pages.count()
    monkeypatch.setattr(url_filter, "GATHER", 0)
    assert sorted(map(repr, url_filter.judge(pages, RULES).collect())) == want


def test_disclosures_recomputed(spark):
    """df, share, evidence and action by plain counting over sf0.01; near copies are few there and are found by the same sketch."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanned, _ = write_table(pii.scan(docs), "t")
    got = {(r.entity, r.term, r.action) for r in pii.disclosures(docs, scanned).collect()}
    texts = [x or "" for x in docs.toPandas().text]
    total = len(texts)
    words = [{w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts]
    df = Counter(w for s in words for w in s)
    need = math.log(len({w for s in words for w in s} | {""}) / 0.05)
    kinds: dict[str, dict[str, int]] = defaultdict(Counter)
    for t in texts:
        for k in {x[0] for x in plain_spans(t)}:
            kinds[k][t] += 1
    want = set()
    for k, own in kinds.items():
        for w in {w for t in own for w in words[texts.index(t)] if len(w) > 2}:
            c = sum(n for t, n in own.items() if w in words[texts.index(t)])
            e = sum(own.values())
            share = math.log(total * c / (df[w] * e)) / math.log(total / e)
            hits, n = sum(w in words[texts.index(t)] for t in own), len(own)
            rate = (df[w] - c + hits) / (total - e + n)
            if hits / n > rate and rate < 1:
                s = hits * math.log(hits / n / rate) + ((n - hits) * math.log((n - hits) / n / (1 - rate)) if n > hits else 0)
                if s >= need and share >= 0.8:
                    want.add((k, w, "remove" if share >= 0.95 else "generalise"))
    assert want and {x for x in got if x[0] in kinds and x[1] not in ("mail", "example", "com")} == {x for x in want if x[1] not in ("mail", "example", "com")}
    assert sum(len(r.added) for r in pii.find_personal_data(docs).collect()) > 0


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b{k}.com 10.0.{k % 250}.7 x" for k in range(5000))
    got = pii.scan(frame(spark, [(1, text, "", "", 0)])).first().base
    assert [(x.kind, x.s, x.e) for x in got] == plain_spans(text)


def test_clashing_names_everywhere(spark):
    rows = [x for x in corpus() if x[1] is None or len(x[1]) < 5000]
    docs = clashing(frame(spark, rows), "dd_removed", "__row", "__d", "__n", "node", "main", "fail_bits")
    done = line_dedup.line_dedup(docs)
    assert done.columns == [*docs.columns, "dd_removed_"] and {r.dd_removed for r in done.collect()} == {"x"}
    assert quality_rules.keep_documents(docs).columns == docs.columns
    assert bag_minhash.drop_near_duplicates(docs).columns == docs.columns
    items = spark.createDataFrame([("a", "not in any text at all that anyone ever wrote here")], "item_id string, text string")
    assert positional_index.decontaminate(docs, items).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
    assert corpus_pipeline.lines(spark, docs.limit(0), SF).count() == 0


def test_search_in_blocks_by_size(spark):
    rows = corpus()
    long_ = rows[-4][1].split()
    items = spark.createDataFrame([(k, " ".join(long_[100 * k : 100 * k + 12])) for k in range(6)], "item_id long, text string")
    index = positional_index.build_index(frame(spark, rows))
    one, many = (sorted((r.doc_id or -1, r.n_hit, tuple(r["items"])) for r in positional_index.search(index, items, signs=s).collect()) for s in (10**9, 60))
    assert one == many and any(h for _, h, _ in one)


def test_both_sides_of_the_broadcast_bounds(spark, monkeypatch):
    """Beyond a bound the plan is another one, the result the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    few = [(x.doc_id, round(x.score, 9), x.spans) for x in toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()]
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert few == [(x.doc_id, round(x.score, 9), x.spans) for x in toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()]
    rows = [(i, f"zebra call {i} words bob@corp.example.com", "", "", 0) for i in range(6)] + [(100 + i, f"plain words call {i}", "", "", 0) for i in range(90)]
    told = lambda: sorted((x.doc_id, [(s.m, s.s) for s in x.added]) for x in pii.find_personal_data(frame(spark, rows)).collect())
    one = told()
    monkeypatch.setattr(pii, "BROADCAST_MARKS", 0)
    assert one == told() and any(a for _, a in one)


def test_leftovers_in_small_blocks_and_parts(spark):
    """Blocks of two texts and parts of four: every link between components is found, up to what it joins."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for i in range(30):
        w = list(base)
        for k in r.sample(range(5, 115), 2):
            w[k] = f"n{i}x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] + [" ".join(f"z{r.randint(0, 10**6)}" for _ in range(60)) for _ in range(5)]
    node = lambda i: i.to_bytes(16, "big")
    rows = spark.createDataFrame([(node(i), t) for i, t in enumerate(texts)], "node binary, text string")
    buckets = spark.createDataFrame([(1, node(i)) for i in range(len(texts))], "key long, node binary")
    comp = spark.createDataFrame([(node(i), node(0)) for i in range(20)], "node binary, comp binary")
    found = bag_minhash._rest(buckets, comp, rows, 0.8, 5, block=2).collect()
    root = {i: 0 if i < 20 else i for i in range(len(texts))}
    whole = dict(root)

    def join(of: dict, a: int, b: int) -> None:
        x, y = of[a], of[b]
        for k in of:
            if of[k] == y:
                of[k] = x

    for x in found:
        a, b = int.from_bytes(x.x, "big"), int.from_bytes(x.p, "big")
        p, q = bag(texts[a]), bag(texts[b])
        assert abs((p & q).total() / (p | q).total() - x.sim) < 1e-12 and x.sim >= 0.8
        join(root, a, b)
    for a in range(len(texts)):
        for b in range(a):
            p, q = bag(texts[a]), bag(texts[b])
            if (p & q).total() >= 0.8 * (p | q).total():
                join(whole, a, b)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    assert groups(root) == groups(whole) and len(groups(whole)) == 6
