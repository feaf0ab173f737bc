"""Rule bitmask ledger [native].

Every rule is evaluated once per document; the ledger keeps the measurements and one integer whose bit i says
that rule i failed. A policy is a version name and a set of rules, i.e. a bit mask: applying it, changing it or
asking what each of its rules costs (an ablation) touches the integers alone and never reads a text again.

Defined results: a null or empty text has no words, measures 0 everywhere and fails the rules on length; rows that
repeat are judged one by one alike; extra columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, WS, bind, id_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit order is the order here; new rules go to the end, so that stored ledgers keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "many_words": "n_words > 100000",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2_strict": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows compare by the hash of their words' hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce((e.h == F.get(s, i - 1).h) | (e.h == F.get(s, i + 1).h), (e.h == F.get(s, i - 1).h), (e.h == F.get(s, i + 1).h), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda e: e.p))
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a.n)

    def count(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), bind(ranked, covered)).otherwise(F.lit(0))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) >= 4, bind(bind(hashed, windows), count)).otherwise(F.lit(0))


def _measures(t: Column) -> Column:
    """Struct of MEASURES of a text column."""

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, WS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(t, WS, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_WS))
    return bind(words, lambda w: bind(lines, lambda x: of(w, x)))


def _bits() -> Column:
    """fail_bits from columns named as MEASURES."""
    return sum((F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the measurements (long) and fail_bits (long): bit i is set if rule i of RULES failed."""
    measured = id_text(docs, text, key).select("doc_id", _measures(F.col("text")).alias("m"))
    return measured.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in MEASURES)).withColumn("fail_bits", _bits())


def keep_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, whole, in one pass without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), _measures(t).alias("m"))
    flat = rows.select("__row", *(F.col(f"m.{c}").alias(c) for c in MEASURES)).withColumn("fail_bits", _bits())
    bad = mask(tuple(dict.fromkeys((*BASE, *POLICIES[policy]))))
    return flat.filter(F.col("fail_bits").bitwiseAND(F.lit(bad).cast("long")) == 0).select("__row.*")


def apply_policy(led: DataFrame, policy: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with base_failed, kept and the policy's name."""
    bits = F.col("fail_bits")
    base_failed = bits.bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    fails = bits.bitwiseAND(F.lit(mask(policies[policy])).cast("long")) != 0
    return led.withColumns({"base_failed": base_failed, "kept": ~(base_failed | fails), "policy": F.lit(policy)})


def ablation(led: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: n_failed, n_alone (kept if the rule went), n_kept and n_kept_without.

    One aggregation to a count per distinct fail_bits (2^rules rows at most); the rest works on those.
    """
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    rows = [(p, r, 1 << order.index(r), mask(rs)) for p, rs in policies.items() for r in rs]
    grid = led.sparkSession.createDataFrame(rows, "policy string, rule string, bit long, mask long")
    seen = counts.join(F.broadcast(grid), F.lit(True))  # both sides are bounded by the rules
    failed, rest = F.expr("fail_bits & mask"), F.expr("fail_bits & mask & ~bit")
    return seen.groupBy("policy", "rule").agg(
        F.sum(F.when(F.expr("fail_bits & bit") != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


ORACLE = r"""
with base as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from base),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from base),
win as (select r, i, concat_ws(' ', ws[i], ws[i+1], ws[i+2]) as g
        from (select r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
m as (select b.doc_id, len(w.ws)::bigint as n_words,
        length(regexp_replace(b.t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        len(l.ls)::bigint as n_lines,
        (len(l.ls) - len(list_distinct(l.ls)))::bigint as n_dup_lines,
        coalesce(cov.n, 0)::bigint as n_repeat_words
      from base b join w using (r) join l using (r) left join cov using (r)),
f as (select *, (case when n_words < 50 then 1 else 0 end
        + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        + case when 10 * n_symbols > n_words then 4 else 0 end
        + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 8 else 0 end
        + case when 10 * n_dup_lines > 3 * n_lines then 16 else 0 end
        + case when n_words > 100000 then 32 else 0 end)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
  (fail_bits & 3) <> 0 as base_failed, (fail_bits & 15) = 0 as kept, 'v1' as policy from f
"""
