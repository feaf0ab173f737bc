"""Near duplicates, toxicity and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alertframe.llm import bag_minhash, toxicity
from alertframe.llm.kernels import mix

from .helpers import SF, bag, clashing, corpus, frame
from .test_native_ops import plain_line_dedup, plain_measures
from .test_token_ops import ids_of, plain_words


def plain_classes(rows: list[tuple], least: float = 0.8) -> list[tuple]:
    texts = sorted({r[1] for r in rows if bag(r[1])})
    bags = {t: bag(t) for t in texts}
    root = {t: t for t in texts}

    def find(t: str) -> str:
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = bags[a], bags[b]
            if min(x.total(), y.total()) >= least * max(x.total(), y.total()):
                shared = (x & y).total()
                if shared >= least * (x.total() + y.total() - shared):
                    root[find(a)] = find(b)
    ids: dict[str, list] = {}
    for r in rows:
        if r[1] in root:
            ids.setdefault(find(r[1]), []).append(r[0])
    name = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(r[0], name[find(r[1])] if r[1] in root else r[0]) for r in rows]


def test_near_duplicates(spark):
    rows = corpus()
    got = bag_minhash.near_duplicates(clashing(frame(spark, rows), "node", "bands", "comp")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(plain_classes(rows))
    kept = bag_minhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({i for i, c in plain_classes(rows) if i == c})
    assert bag_minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_star_shaped_group(spark):
    """Copies that are near to their source alone: no link may be lost to the choice of pivots."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in r.sample(range(5, 195), 4):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w), "", "", 0))
    rows.append((99, " ".join(base), "", "", 0))
    got = bag_minhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.class_id) for x in got) == Counter(plain_classes(rows))


def test_unbiased():
    r = np.random.default_rng(0)
    gaps = []
    for trial in range(12):
        a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
        b = np.where(r.random(60) < 0.7, a, b)
        real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        item = mix(np.arange(60, dtype=np.uint64) + np.uint64(1000 * trial)) >> np.uint64(16)
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bag_minhash.bag_minhash(doc, np.concatenate([item[a > 0], item[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 2000)
        gaps.append((s[0] == s[1]).mean() - real)
    assert abs(np.mean(gaps)) < 0.012 and np.max(np.abs(gaps)) < 0.05


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(3)
    e, trans = r.normal(size=5), r.normal(size=(2, 2))
    weight, one, pair = 0.0, np.zeros(5), np.zeros((2, 2))
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(e[i] * y[i] for i in range(5)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        weight += w
        one += w * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            pair[a, b] += w
    p, got = toxicity.forward_backward(e, np.arange(5) == 0, trans)
    assert np.allclose(p, one / weight) and np.allclose(got, pair / weight)


def test_toxicity_held_out(spark):
    r = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]
    bad = ["vile", "rotten", "filth"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 80))]
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad).upper() if i % 8 else r.choice(bad))
        rows.append((i, ("\n" if i % 3 else " ").join(w), "", "", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "", "", 0), (1001, "", "", "", 0), (1002, "x" * 50_000, "", "", 0), (None, "vile filth", "", "", 0), rows[0]]
    docs = frame(spark, rows)
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, lab, train=fold != 0, sample=200)
    got = toxicity.score(clashing(docs, "score", "spans"), model).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((by[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got) and by[1001].score < 0.5 and by[1000].score == by[1001].score
    text = rows[8][1]
    assert all(any(b in text[int(s.split(":")[0]) : int(s.split(":")[1])].lower() for b in bad) for s in by[8].spans.split(","))
    assert toxicity.fit(docs, lab.filter("toxic = 0")) is None
    assert {x.score for x in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in docs.itertuples()]

    def fine(t: str) -> bool:
        n, chars, signs, _, _, repeat = plain_measures(t)
        return n >= 50 and 100 * repeat <= 50 * n and 10 * signs <= n and 2 * n <= chars <= 15 * n

    rows = [r for r in rows if fine(r[1])]
    cut = plain_line_dedup(rows)
    rows = [(i, cut[(i, t)][1], *x) for i, t, *x in rows if cut[(i, t)][1].strip()]
    keep = {i for i, c in plain_classes(rows) if i == c}
    rows = [r for r in rows if r[0] in keep]
    wins = set()
    for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
        w = plain_words(t)
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in wins}
    rows = [r for r in rows if not any(tuple((w := plain_words(r[1]))[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))]
    want = Counter()
    for r in rows:
        want[r[0]] += len(ids_of(r[1])) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == want
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
