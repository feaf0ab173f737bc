"""Cases beyond former caps: rare entities, far terms."""

from __future__ import annotations

import random
from collections import Counter

from alertframe.llm import bag_minhash, pii, positional_index, toxicity, url_filter

from .helpers import frame


def test_rare_and_far_disclosures(spark):
    plain = "some plain words that all texts hold " * 30
    rows = [(i, plain + str(i), "", "", 0) for i in range(900)]
    rows[7] = (7, "Quokka " + plain + "ann@rare.example.com 7", "", "", 0)  # one document, far from the entity
    for i in range(5):
        rows[20 + i] = (20 + i, f"zebra {plain} bob@corp.example.com {i} éann@x.example.org", "", "", 0)
    rows[90] = (90, plain + "zebra", "", "", 0)  # without the entity
    copy = "wombat " + plain + "carl@copy.example.com"  # seen by its text alone
    rows += [(5000 + i, copy, "", "", 0) for i in range(2)] + [(None, rows[7][1], "", "", 0), rows[7]]
    found = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    added = {(r.doc_id, x.m, x.s, x.e, x.kind) for r in found for x in r.added}
    at = rows[90][1].index("zebra")
    want = {(i, "quokka", 0, 6, "remove") for i in (7, None)} | {(20 + i, "zebra", 0, 5, "remove") for i in range(5)} | {(90, "zebra", at, at + 5, "remove")}
    assert {x for x in added if x[1] != "wombat"} == want


def test_wide_and_deep_branches(spark):
    """More than 16 children under a host, and branches that differ from the sixth segment on."""
    tails = [f"{w}/{k}" for w in ("buy", "read") for k in range(100, 140)]
    wide = [f"http://w.com/s{chr(97 + c)}/{t}" for c in range(20) for t in tails]
    deep = [f"http://d.com/p/q/r/s/t/{c}/{t}" for c in ("bad", "good") for t in tails]
    rules = [("block" if c < 10 else "allow", f"w.com/s{chr(97 + c)}/buy") for c in range(20)]
    rules += [("block", "d.com/p/q/r/s/t/bad/buy"), ("allow", "d.com/p/q/r/s/t/good/buy")]
    df = spark.createDataFrame(list(enumerate(wide + deep)), "page_id long, url string")
    blocked = {f"/s{chr(97 + c)}/" for c in range(10)}
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(wide + deep)
    found = {(r.host, r.path): r.template for r in got}
    for r in got:
        if r.host == "d.com":
            assert ("/bad/" in r.path) == ("bad" in r.template.split("/")) and "{rest}" not in r.template
        elif any(r.path.startswith(b) for b in blocked):
            assert found[r.host, r.path].startswith(r.path[:4])


def test_rare_toxic_terms(spark):
    """A term in under 1 % of the toxic documents is a toxic token too."""
    r = random.Random(3)
    line = lambda: " ".join(f"word{r.randint(0, 99)}" for _ in range(12))
    bad = lambda i: "seldomslur" if i < 4 else "oftenslur"
    rows = [(i, f"{line()} {bad(i)} {line()}", "", "", 0) for i in range(600)] + [(1000 + i, f"{line()} {line()}", "", "", 0) for i in range(600)]
    labels = spark.createDataFrame([(x[0], int(x[0] < 1000)) for x in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    texts = ["word1 word2 seldomslur word3", "word1 word2 oftenslur word3", "word1 word2 word3"]
    got = {x.doc_id: x.spans for x in toxicity.score(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]), model).collect()}
    assert [got[i] for i in range(3)] == ["12:22", "12:21", ""]


def test_null_and_repeated_ids_stay_apart(spark):
    r = random.Random(5)
    text = lambda n=80: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    base, passage = text(), text(12)
    clean = [(None, text()), (None, text()), (3, text()), (4, text())]
    near = [(1, base), (None, base + " end"), (3, base + " tail")]
    rows = [(i, t, "", "", 0) for i, t in clean + near]
    kept = bag_minhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter([*clean, near[0]])
    tied = [(9, base), (9, base + " end"), (None, text())]
    kept = bag_minhash.drop_near_duplicates(frame(spark, [(i, t, "", "", 0) for i, t in tied])).collect()
    assert len(kept) == 2 and {x.doc_id for x in kept} == {9, None}
    hit = [(None, f"{text()} {passage}"), (4, f"{passage} {text()}")]
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    left = positional_index.decontaminate(frame(spark, [(i, t, "", "", 0) for i, t in clean + hit]), items).collect()
    assert Counter((x.doc_id, x.text) for x in left) == Counter(clean)
