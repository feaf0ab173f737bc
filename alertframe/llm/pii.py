"""Information-theoretic sanitisation [native].

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers. Protected entities e are each
distinct value, what values share (an address's domain, an IP's network, a card's issuer, a phone's prefix) and each
kind, with information IC(e) = log(N / df(e)) over the N documents. A term t discloses
PMI(t; e) = log(N c(t, e) / (df(t) df(e))) of that, where c counts documents that hold both, wherever in the text.
Terms whose share PMI / IC reaches `remove_at` are removed, those from `generalise_at` on are generalised to their
kind, in every document that holds them, with or without the entity.

Rare entities have no fixed support to reach: a pair counts if so many of the entity's texts would hold the term by
chance with a probability of at most `alpha`, taken over all terms of the corpus (Bonferroni: pairs are found because
they co-occur, so the terms that don't are tests too; one text of an entity is evidence in a small vocabulary only). The probability is
Chernoff's bound exp(-n KL(k / n || df(t) / N)) for k of n texts. Copies are no evidence: of an entity's texts that are
near copies of each other (sketch) the one with the lowest hash alone is among the n and k.

Counts are pre-aggregated per task: a text's copies first, then its pairs of an entity and a term; df is counted over
all documents. Disclosing terms meet the documents' distinct terms in an equi-join, which adaptive execution splits
where a term is hot; only documents with such a term are searched for its places.

Defined results: null text is empty and has no spans; rows equal in doc_id and text get the same spans and count
as often as they stand; an added span never overlaps a base one; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import bind, id_text, write_table

#: Written so that no text makes them backtrack over more than a run of their own characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have to be searched at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
KINDS = (*PATTERNS, "generalise", "remove")
TERM = r"\p{L}++"
#: Stands for a letter of a base span, so that no word reaches into one.
MASK = "\uffff"
#: How many ways a hot entity's texts are spread.
SALTS = 16
#: Up to so many marks, of a document and a term (some 60 bytes each), are sent to all tasks.
BROADCAST_MARKS = 500_000


def running(a: Column, width: int = 16, passes: int = 7) -> Column:
    """Sums of an array's first 1, 2, ... numbers, in passes that add `width` places at growing distances (16^7 at most)."""

    def go(x: Column, level: int) -> Column:
        step = width**level
        if level == passes:
            return x

        def total(_: Column, i: Column) -> Column:
            return reduce(lambda p, q: p + q, (F.coalesce(F.get(x, i - j * step), F.lit(0)) for j in range(width)))

        return F.when(F.size(x) > step, bind(F.transform(x, total), lambda y: go(y, level + 1))).otherwise(x)

    return bind(a, lambda x: go(x, 0))


def places(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: array of (m, s, e), in code points; places come from what splits around them."""
    by = F.lit(pattern)

    def named(m: Column, g: Column) -> Column:
        ends = running(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
        return bind(ends, lambda e: F.transform(m, lambda x, i: F.struct(x.alias("m"), (F.get(e, i) - F.length(x)).alias("s"), F.get(e, i).alias("e"))))

    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    return bind(F.regexp_extract_all(text, by, F.lit(0)), lambda m: F.when(F.size(m) > 0, bind(F.split(text, by, -1), lambda g: named(m, g))).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def digit(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, m), by kind as listed and then by place."""

    def of(kind: str) -> Column:
        none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")
        good = F.filter(places(text, PATTERNS[kind]), lambda x: CHECKS[kind](x.m))
        named = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m")))
        return F.when(text.rlike(HINTS[kind]), named).otherwise(none)

    return F.concat(*(of(k) for k in PATTERNS))


def masked(text: Column) -> Column:
    """text with the letters of e-mail addresses (no other base span has any) replaced by MASK; places stay."""
    by = F.lit(PATTERNS["email"])

    def joined(m: Column, g: Column) -> Column:
        parts = F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.regexp_replace(F.get(m, i), r"\p{L}", MASK), F.lit(""))))
        return F.array_join(parts, "")

    done = bind(F.regexp_extract_all(text, by, F.lit(0)), lambda m: bind(F.split(text, by, -1), lambda g: joined(m, g)))
    return F.when(text.rlike(HINTS["email"]), done).otherwise(text)


def group_of(kind: Column, m: Column) -> Column:
    """What values of a kind share: an address's domain, an IP's network of 256, a card's issuer, a phone's first four digits."""
    d = F.regexp_replace(m, "[^0-9]", "")
    return F.when(kind == "email", F.substring_index(m, "@", -1)).when(kind == "ip", F.substring_index(m, ".", 3)).when(kind == "card", F.substring(d, 1, 6)).otherwise(F.substring(d, 1, 4))


def entity_names(base: Column) -> Column:
    """kind:value, kind/group and kind of every span."""
    each = F.transform(base, lambda x: bind(F.lower(x.m), lambda m: F.array(F.concat_ws(":", x.kind, m), F.concat_ws("/", x.kind, group_of(x.kind, m)), x.kind)))
    return F.array_distinct(F.flatten(each))


def sketch(terms: Column, h: Column, bands: int = 8, rows: int = 3, least: int = 20) -> Column:
    """Band keys of a text's terms: near copies share one almost surely, other texts hardly ever. Texts of fewer terms than
    `least`, which are alike by their form, have one of their own."""
    low = lambda k: F.array_min(F.transform(terms, lambda w: F.xxhash64(F.lit(k), w)))
    keys = [F.xxhash64(F.lit(b), *(low(b * rows + r) for r in range(rows))) for b in range(bands)]
    return F.when(F.size(terms) >= least, F.array(*keys)).otherwise(F.array(h))


def spoken(text: Column) -> Column:
    """Distinct words of a text, lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(text, r"\P{L}++")), lambda w: F.lower(w)))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h (text hash), base spans, and of documents with a span all terms of three letters or more clear of spans."""
    t = F.col("text")

    def terms(base: Column) -> Column:
        clear = F.regexp_extract_all(masked(t), F.lit(rf"(?<![\p{{L}}{MASK}]){TERM}(?!{MASK})"), F.lit(0))
        return F.when(F.size(base) > 0, F.array_distinct(F.transform(F.filter(F.array_distinct(clear), lambda w: F.length(w) > 2), lambda w: F.lower(w))))

    found = id_text(docs, text, key).select("doc_id", F.xxhash64("text").alias("h"), bind(base_spans(t), lambda b: F.struct(b.alias("base"), terms(b).alias("terms"))).alias("f"))
    return found.select("doc_id", "h", "f.base", "f.terms")


def _surprise(k: Column, n: Column, rate: Column) -> Column:
    """n KL(k / n || rate): minus the log of Chernoff's bound for k of n texts or more."""
    rest = n - k
    return k * F.log(k / n / rate) + F.when(rest > 0, rest * F.log(rest / n / (1 - rate))).otherwise(0.0)


def _possible(pairs: DataFrame, total: float, need: float) -> DataFrame:
    """pairs (c, k, df_e, n) that could still be no accident, were the term in no other text: exact, and before any join."""
    rate = F.col("k") / (F.lit(total) - F.col("df_e") + F.col("n"))
    return pairs.filter((F.col("df_e") < total) & (_surprise(F.col("k"), F.col("n"), rate) >= need))


def _met(rows: DataFrame, summed: Callable[[GroupedData], DataFrame]) -> DataFrame:
    """rows (entity, h, ...) with what is summed up of their entity; a hot entity's rows are spread by salt."""
    of = summed(rows.groupBy("entity")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(of, ["entity", "salt"]).drop("salt")


def disclosures(docs: DataFrame, scanned: DataFrame, text: str = "text", key: str = "doc_id", generalise_at: float = 0.8, remove_at: float = 0.95, alpha: float = 0.05) -> DataFrame:
    """entity, term, share and action for all pairs that reach a threshold.

    An entity of n texts can't have a term that is no accident unless n log N reaches log(tests / alpha): such entities
    are left out first.
    """
    df = id_text(docs, text, key).select(F.explode(spoken(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    df, _ = write_table(df, "terms")
    total, need = float(scanned.count()), math.log(max(1, df.count()) / alpha)
    texts = scanned.filter(F.size("base") > 0).groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.first("base").alias("base"), F.first("terms").alias("terms"))
    texts, _ = write_table(texts.select("h", "docs", entity_names(F.col("base")).alias("entities"), "terms", sketch(F.col("terms"), F.col("h")).alias("bands")), "private-texts")
    enough = lambda n: F.col(n) * math.log(max(2.0, total)) >= need
    each = _met(texts.select("h", F.explode("entities").alias("entity"), "docs", "bands"), lambda e: e.agg(F.count(F.lit(1)).alias("texts")).filter(enough("texts")))
    banded = each.select("h", "entity", "docs", F.explode("bands").alias("band"))
    lowest = banded.groupBy("entity", "band").agg(F.min("h").alias("low"))
    families = banded.join(lowest, ["entity", "band"]).groupBy("h", "entity").agg(F.first("docs").alias("docs"), F.min("low").alias("low"))
    spoken_for, _ = write_table(families.select("h", "entity", "docs", (F.col("low") == F.col("h")).cast("int").alias("own")), "entity-texts")
    known = _met(spoken_for, lambda e: e.agg(F.sum("docs").alias("df_e"), F.sum("own").alias("n")).filter(enough("n")))
    listed = known.groupBy("h").agg(F.collect_list(F.struct("entity", "df_e", "n", "own")).alias("e"))
    both = texts.select("h", "docs", "terms").join(listed, "h").select("docs", "terms", F.explode("e").alias("e")).select("docs", "e.*", F.explode("terms").alias("term"))
    pairs = both.groupBy("entity", "term").agg(F.sum("docs").alias("c"), F.sum("own").alias("k"), F.first("df_e").alias("df_e"), F.first("n").alias("n"))
    scored = _possible(pairs.filter("k > 0"), total, need).join(df, "term")
    share = F.log(F.col("c") * F.lit(total) / (F.col("df_t") * F.col("df_e"))) / F.log(F.lit(total) / F.col("df_e"))
    rate = (F.col("df_t") - F.col("c") + F.col("k")) / (F.lit(total) - F.col("df_e") + F.col("n"))  # the entity's texts once each
    sure = (F.col("k") / F.col("n") > rate) & (_surprise(F.col("k"), F.col("n"), rate) >= need)
    action = F.when(F.col("share") >= remove_at, "remove").when(F.col("share") >= generalise_at, "generalise")
    return scored.withColumn("share", share).withColumn("action", F.when(sure, action)).filter("action is not null").select("entity", "term", "share", "action")


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", **thresholds: float) -> DataFrame:
    """doc_id, h, base and added (both arrays of kind, s, e, m; added by kind as listed, then place)."""
    scanned, _ = write_table(scan(docs, text, key), "personal")
    told = disclosures(docs, scanned, text, key, **thresholds).groupBy("term").agg(F.max("action").alias("kind"))
    told, _ = write_table(told, "told")
    t, own = F.col("text"), id_text(docs, text, key).withColumn("h", F.xxhash64("text"))
    each = own.select("doc_id", "h", F.explode(spoken(t)).alias("term")).filter(_may_be_in(told, "term"))
    marks = each.join(told, "term").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.collect_set(F.struct("term", "kind")).alias("told"))
    marks, _ = write_table(marks, "marks")
    few = (marks.agg(F.sum(F.size("told")).alias("n")).first().n or 0) <= BROADCAST_MARKS  # else the marked texts are shuffled
    some = own.filter(_may_be_in(marks.select(F.col("d").alias("doc_id"), F.col("dh").alias("h")), "doc_id", "h"))  # other texts stay where they are
    hit = some.join(F.broadcast(marks) if few else marks, some["doc_id"].eqNullSafe(marks["d"]) & (some["h"] == marks["dh"])).select("d", "dh", "text", F.map_from_entries("told").alias("told"))
    placed = hit.select("d", "dh", marked(t, F.col("told")).alias("added")).groupBy("d", "dh").agg(F.first("added").alias("added"))
    one = scanned.drop("terms")
    return one.join(placed, one["doc_id"].eqNullSafe(placed["d"]) & (one["h"] == placed["dh"]), "left").select("doc_id", "h", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")).alias("added"))


def _may_be_in(few: DataFrame, *columns: str) -> Column:
    """False for most rows whose columns few has not, true for all that it has: by one bit a row of few (8 MB at most)."""
    size = min(1 << 26, 1 << max(10, (8 * few.count()).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(size))
    slot, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    some = few.groupBy(slot.alias("id")).agg(F.bit_or(one).alias("bits"))
    every = few.sparkSession.range(size // 64).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bits = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x.bits).alias("bits"))
    return F.get(bits.scalar(), slot.cast("int")).bitwiseAND(one) != 0


def marked(text: Column, told: Column) -> Column:
    """Array of (kind, s, e, m): where a text's words stand that, lower case, are keys of told; words in base spans stay."""
    written = F.filter(F.array_distinct(F.split(text, r"\P{L}++")), lambda w: F.map_contains_key(told, F.lower(w)))
    pattern = F.concat(F.lit(rf"(?<![\p{{L}}{MASK}])(?:"), F.array_join(written, "|"), F.lit(rf")(?![\p{{L}}{MASK}])"))

    def named(x: Column) -> Column:
        return F.struct(F.element_at(told, F.lower(x.m)).alias("kind"), x.s.alias("s"), x.e.alias("e"), F.lower(x.m).alias("m"))

    return bind(masked(text), lambda clear: bind(pattern, lambda p: F.array_sort(F.transform(places(clear, p), named))))


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id", **thresholds: float) -> DataFrame:
    """doc_id and text with spans replaced: base ones and generalised terms by <kind>, removed terms by nothing."""
    found = find_personal_data(docs, text, key, **thresholds).withColumnsRenamed({"doc_id": "d", "h": "dh"}).distinct()
    own = id_text(docs, text, key).withColumn("h", F.xxhash64("text"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["d"]) & (own["h"] == found["dh"]), "left")
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))))

    def step(a: Column, x: Column) -> Column:
        mark = F.when(x.kind == "remove", "").when(x.kind == "generalise", "<term>").otherwise(F.concat(F.lit("<"), x.kind, F.lit(">")))
        gap = F.substring("text", a.at + 1, x.s - a.at)
        return F.when(x.s < a.at, F.struct(F.greatest(a.at, x.e).alias("at"), a.out.alias("out"))).otherwise(F.struct(x.e.alias("at"), F.concat(a.out, gap, mark).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(order, begin, step, lambda a: F.concat(a.out, F.substring("text", a.at + 1, F.length("text"))))
    return joined.select("doc_id", F.when(F.size(order) > 0, done).otherwise(F.col("text")).alias("text"))


def spans_text(*arrays: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.concat(*(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))) for a in arrays)), ",")
