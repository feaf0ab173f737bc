"""Line deduplication by overlapping three-line windows.

The lines of a document that hold a word are its units. Each run of three consecutive units is hashed; windows that
occur more than once in the corpus keep their first occurrence, in order of (doc_id, text hash, place), and every
later occurrence covers its three lines. Covered lines are merged and removed, blank lines stay.

The corpus-wide step sees 16-byte hashes only, pre-aggregated per task, so that a window that a third of the corpus
shares costs one row per task; joining occurrences back to the repeated windows is a plain equi-join, which adaptive
execution splits where a window is hot.

Defined results: null text is empty; documents of fewer than three such lines have no window and stay whole; rows
equal in doc_id and text are one document and get the same result; a null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, bind

WINDOW = 3


def _units(text: Column) -> Column:
    """Lines with a word: place among all lines, and the line."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e.x.rlike(NOT_WS))


def _windows(text: Column, size: int) -> Column:
    """A struct per window: k, the place of its first unit; h1 and h2, independent 64-bit hashes."""

    def each(u: Column) -> Column:
        def one(k: Column) -> Column:
            lines = [F.get(u, k + j).x for j in range(size)]
            return F.struct(k.alias("k"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(17), *lines).alias("h2"))

        return F.when(F.size(u) >= size, F.transform(F.sequence(F.lit(0), F.size(u) - size), one))

    return bind(_units(text), each)


def _cut(text: Column, starts: Column, size: int) -> Column:
    """Struct of the merged covered line places (removed) and the text without them."""

    def rest(x: Column, c: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), c)  # by hash, in order
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")

    def body(u: Column) -> Column:
        covered = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda k: F.array(*(F.get(u, k + j).i for j in range(size)))))))
        return bind(covered, lambda c: F.struct(c.alias("removed"), bind(F.split(text, "\n", -1), lambda x: rest(x, c)).alias("text")))

    return bind(_units(text), body)


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """docs with text cleaned, and a last column dd_removed: the places (from 0) of the lines that went, null if none did.

    Other columns pass through as they are; if one is called dd_removed, the new one has an underscore more.
    """
    name = "dd_removed"
    while name in docs.columns:
        name += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("d"), t.alias("t"), F.xxhash64(t).alias("th"))
    slim = own.select("d", "th", F.explode(_windows(F.col("t"), size)).alias("w")).select("d", "th", "w.k", "w.h1", "w.h2")
    place = F.struct("d", "th", "k")
    repeated = slim.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = slim.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("d").alias("gd"), F.col("th").alias("gth")).agg(F.collect_set("k").alias("starts"))
    joined = own.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("th") == F.col("gth")), "left")
    cut = joined.select("row", F.when(F.col("starts").isNotNull(), _cut(F.col("t"), F.col("starts"), size)).alias("cut"))
    clean = F.when(F.col("cut").isNotNull(), F.col("cut.text")).otherwise(F.col(f"row.`{text}`"))
    kept = [(clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return cut.select(*kept, F.col("cut.removed").alias(name))


ORACLE = r"""
with base as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, generate_subscripts(a, 1) - 1 as i, unnest(a) as x from (select doc_id, string_split(t, chr(10)) as a from base)),
u as (select doc_id, i, x, row_number() over (partition by doc_id order by i) - 1 as k
      from l where regexp_matches(x, '[^\x20\x09-\x0D]')),
w as (select doc_id, k, x as a, lead(x, 1) over o as b, lead(x, 2) over o as c from u window o as (partition by doc_id order by k)),
v as (select doc_id, k, row_number() over (partition by a, b, c order by doc_id, k) as n from w where c is not null),
gone as (select distinct u.doc_id, u.i from v join u on u.doc_id = v.doc_id and u.k between v.k and v.k + 2 where v.n > 1),
cut as (select l.doc_id, string_agg(l.x, chr(10) order by l.i) filter (where g.i is null) as t,
          count(g.i)::bigint as n_removed, coalesce(string_agg(l.i::varchar, ',' order by l.i) filter (where g.i is not null), '') as removed
        from l left join gone g using (doc_id, i) group by l.doc_id)
select doc_id, n_removed, removed, coalesce(t, '') as text from cut
"""
