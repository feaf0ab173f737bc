"""URL filter by a path-template tree per host [native].

Explicit rules label the pages they fit. For each host the paths form a tree: variable segments (numbers, hashes,
long ones) become wildcards by their shape, and children whose share of blocked labels does not differ from their
labelled siblings' (a two-proportion test) are merged into one branch, however many they are; so are children without a
label whose paths go on as those siblings' do (a G-test of homogeneity over the next segments). The tree grows to the
deepest path. Pages without a rule get the verdict of their template: block if its share of blocked labels among
labelled pages reaches `reject_at`, smoothed towards the host's share, and that towards the overall one. A template
without a label so inherits its host's share.

All of the tree's steps work on one row per host and path shape, so that a hot host is reduced before it is grouped;
pages meet their templates by an equi-join on host and shape, which adaptive execution splits where it is hot. Up to
`GATHER` such rows the steps run in one task each, by the same plans without an exchange: every exchange and broadcast
costs the driver a thread that it keeps for a minute, with its stack and its heap of native memory.

Defined results: a null url or one without :// has an empty host and path and an empty template; repeated rows count
as often as they stand; a purity equal to reject_at blocks; a host of one path shape ends there; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

Rule = tuple[str, str]
#: Up to so many rows of host and path shape, a step of the tree is one task.
GATHER = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are (verdict, "host/path")."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a later one overrides
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """Path segments with variable ones generalised."""

    def one(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^[0-9]+(?:\.[A-Za-z0-9]{1,5})?$"), "{n}")
            .when(x.rlike(r"^[0-9A-Fa-f-]{8,}$"), "{x}")
            .when(x.rlike(r"^[0-9]{1,4}[-_.][0-9]{1,2}(?:[-_.][0-9]{1,4})?$"), "{d}")
            .when(F.length(x) > 48, "{long}")
            .when(x.rlike(r"[0-9].*[0-9].*[0-9]"), "{v}")
            .otherwise(F.translate(x, _UPPER, _LOWER))
        )

    return F.transform(F.filter(F.split(path, "/", -1), lambda x: x != ""), one)


def _critical(free: Column, z: float) -> Column:
    """The chi-square value that so many degrees of freedom exceed as rarely as a normal one exceeds z (Wilson-Hilferty)."""
    v = 2 / (9 * free)
    return free * F.pow(1 - v + z * F.sqrt(v), F.lit(3))


def _gather(df: DataFrame, few: bool) -> DataFrame:
    """df in one partition, if it is known to have few rows."""
    return df.coalesce(1) if few else df


def _join(left: DataFrame, right: DataFrame, on: list[str] | list[Column], few: bool) -> DataFrame:
    """The inner join; of gathered tables within their one task, without an exchange or broadcast."""
    return left.join(right.hint("shuffle_hash"), on).coalesce(1) if few else left.join(right, on)


def _branches(now: DataFrame, seg: Column, following: Column, z: float, few: bool) -> DataFrame:
    """host, template, seg of each branch, whether it is merged, and own, the number of shapes below its node.

    A labelled branch is held against its labelled siblings by a two-proportion test, one without a label by a G-test of
    homogeneity between its distribution over the next segments and theirs together. The tables between are written: in
    one plan each would stand as often as it is used, and the driver plans and compiles all of them anew at every exchange.
    """
    node, branch = ["host", "template"], ["host", "template", "seg"]
    ways = now.groupBy(*node, seg.alias("seg"), following.alias("way")).agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("b") + F.col("a")).alias("labelled"), F.count(F.lit(1)).alias("shapes")
    )
    ways = _gather(write_table(ways, "ways")[0], few)
    children = ways.groupBy(*branch).agg(F.sum("n").alias("total"), F.sum("b").alias("cb"), F.sum("labelled").alias("cn"))
    ways = _gather(write_table(_join(ways, children, branch, few), "ways")[0], few)
    m = F.when((F.col("cn") > 0) & (F.col("seg") != ""), F.col("n")).otherwise(0)
    pool = ways.groupBy(*node, "way").agg(F.sum(m).alias("m"), *(F.sum(x).alias(x) for x in ("shapes", "b", "labelled")))
    nodes = pool.groupBy(*node).agg(
        F.sum("m").alias("pool"), F.count(F.when(F.col("m") > 0, 1)).alias("kinds"), F.sum("shapes").alias("own"), F.sum("b").alias("pb"), F.sum("labelled").alias("pn")
    )
    each = ways.select(*branch, "way", "n", "total", "cb", "cn")
    each = _join(_join(each, pool.select(*node, "way", "m"), [*node, "way"], few), nodes, node, few)
    both, total, out_of = F.col("n") + F.col("m"), F.col("total"), F.col("total") + F.col("pool")
    term = lambda x, own: F.when(x > 0, x * F.log(x * out_of / (both * own))).otherwise(0.0)
    # ways of the pool that the branch lacks: m log(out_of / pool) each; all of m but what the branch has
    stats = each.groupBy(*branch).agg(
        F.sum(term(F.col("n"), total) + term(F.col("m"), F.col("pool"))).alias("g"), F.sum("m").alias("met"), F.count(F.when(F.col("m") == 0, 1)).alias("new"),
        *(F.first(x).alias(x) for x in ("total", "cb", "cn", "pool", "kinds", "own", "pb", "pn")),
    )
    lacking = (F.col("pool") - F.col("met")) * F.log((F.col("total") + F.col("pool")) / F.col("pool"))
    free = (F.col("kinds") + F.col("new") - 1).cast("double")
    like = F.when(free == 0, F.lit(True)).otherwise(2 * (F.col("g") + lacking) <= _critical(F.greatest(free, F.lit(1.0)), z))
    share = F.col("pb") / F.col("pn")
    spread = F.sqrt(share * (1 - share) * (1 / F.col("cn") + 1 / F.col("pn")))
    alike = F.abs(F.col("cb") / F.col("cn") - share) <= z * spread
    merged = F.when(F.col("cn") > 0, alike).when(F.col("pool") > 0, like).otherwise(F.lit(False))
    return stats.select(*branch, merged.alias("merged"), "own")


def templates(labelled: DataFrame, z: float = 1.96, pseudo: float = 4.0, reject_at: float = 0.5) -> DataFrame:
    """host, shape, template, purity and verdict; labelled: host, shape (array) and rule verdict (null: none)."""
    blocked, allowed = (F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)) for v in ("block", "allow"))
    grouped = labelled.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), blocked.alias("b"), allowed.alias("a"))
    now, _ = write_table(grouped.withColumn("template", F.array().cast("array<string>")), "paths")
    few = now.count() <= GATHER  # no table below has more rows
    now = _gather(now, few)
    done, k = [], 0
    while True:
        seg, following = (F.coalesce(F.get("shape", F.lit(k + i)), F.lit("")) for i in (0, 1))  # no segment is empty
        left, right = now.withColumn("seg", seg).alias("l"), _branches(now, seg, following, z, few).alias("r")
        joined = _join(left, right, [F.col(f"l.{x}") == F.col(f"r.{x}") for x in ("host", "template", "seg")], few)
        wild = F.when(F.col("r.merged"), "*").otherwise(F.col("r.seg"))
        alone = F.transform(F.slice("l.shape", k + 1, F.greatest(F.size("l.shape") - k, F.lit(0))), lambda x: F.when(F.col("l.b") + F.col("l.a") > 0, "*").otherwise(x))  # as the steps below would
        grown = F.when(F.col("r.own") == 1, F.concat("l.template", alone)).when(F.col("r.seg") == "", F.col("l.template")).otherwise(F.array_append("l.template", wild))
        more = (F.col("r.own") > 1) & (F.size("l.shape") > k)
        level, _ = write_table(joined.select("l.host", "l.shape", "l.n", "l.b", "l.a", grown.alias("template"), more.alias("more")), "paths")
        done.append(level.filter("not more").drop("more"))
        now, k = _gather(level, few).filter("more").drop("more"), k + 1
        if now.isEmpty():
            break
    now = _gather(write_table(reduce(DataFrame.unionByName, done), "paths")[0], few)
    smoothed = lambda b, n, prior: (b + pseudo * prior) / (n + pseudo)
    b, n = F.sum("b"), F.sum(F.col("b") + F.col("a"))
    total = now.agg(b.alias("b"), n.alias("n")).first()
    rate = F.lit(float(total.b or 0) / max(1, total.n or 0))
    prior = now.groupBy("host").agg(smoothed(b, n, rate).alias("prior"))
    judged = _join(now.groupBy("host", "template").agg(b.alias("b"), n.alias("n")), prior, ["host"], few)
    judged = judged.select("host", "template", smoothed(F.col("b"), F.col("n"), F.col("prior")).alias("purity"))
    verdict = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    found = _join(now, judged, ["host", "template"], few).select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", verdict.alias("verdict"))
    return write_table(found, "templates")[0]


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id", **tree: float) -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every page."""
    host, path = split_url(F.col(url))
    own = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.select("id", "host", "path", shape(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("verdict"))
    tree_ = templates(own.select("host", "shape", "verdict"), **tree).withColumnRenamed("verdict", "by_tree")
    return own.join(tree_, ["host", "shape"]).select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", "by_tree").alias("verdict"), "template", "purity")
