"""Keyword search with event-aware ranking over a stored token index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..text import names

# Words a query does not search for.
STOP = ("a", "an", "and", "for", "in", "of", "on", "the", "to")


def query_terms(query: str) -> list[str]:
    """Lower-case terms longer than one character, without stop words."""
    return [t for t in re.findall(r"[a-z0-9_+.\-]+", query.lower()) if len(t) > 1 and t not in STOP]


def split_query(query: str, event: str | None = None) -> tuple[str | None, list[str]]:
    """The event asked for (given, or the first that the query names) and the terms without it."""
    found = names.find_events(query)
    wanted = names.normal(event) or (found[0]["name"] if found else None)
    rest = query
    if wanted:
        rest = re.sub(r"\s*".join(map(re.escape, wanted)), " ", query, flags=re.I)
    return wanted, query_terms(rest)


def plain(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def tokens(text: Column) -> Column:
    """Alphanumeric tokens, lower case, accents off for the common Latin letters."""
    return F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index(circulars: DataFrame) -> DataFrame:
    """circulars with their subject and body as padded token texts, in which a phrase is a substring."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" "))
    return circulars.withColumns({"subject_tokens": line("subject"), "body_tokens": line("body")})


BUCKETS = 256


def postings(circulars: DataFrame) -> DataFrame:
    """term, circular_id, col, positions: the inverted index as a table.

    A text's positions are gathered inside its row, so that the table is made without a shuffle.
    """
    both = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("words")) for c in ("subject", "body")))
    line = circulars.select("circular_id", F.explode(both).alias("t")).select("circular_id", "t.col", "t.words")
    placed = F.array_sort(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    first = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (k == 0) | (F.get("p", k).w != F.get("p", k - 1).w))

    def entry(k: Column, n: Column) -> Column:
        stop = F.coalesce(F.get("s", n + 1), F.size("p"))
        return F.struct(F.get("p", k).w.alias("term"), F.transform(F.slice("p", k + 1, stop - k), lambda x: x.i).alias("positions"))

    rows = line.filter(F.size("words") > 0).withColumn("p", placed).withColumn("s", first)
    return rows.select("circular_id", "col", F.explode(F.transform("s", entry)).alias("e")).select("e.term", "circular_id", "col", "e.positions")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(circulars: DataFrame, path: str) -> None:
    """The index on disk, in folders by a hash of the term and sorted by term: a search reads its terms' folders alone."""
    rows = postings(circulars).withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket", F.pmod(F.xxhash64("circular_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_hits(spark: SparkSession, path: str, terms: list[str]) -> DataFrame | None:
    """circular_id of the bulletins that match every term, from write_postings(); None without terms that have a token."""
    out = None
    for term in terms:
        words = re.findall(r"[^\W_]+", term)
        if not words:
            continue
        known = spark.read.parquet(path).filter(F.col("term").isin(words))
        places = [r.bucket for r in spark.createDataFrame([(w,) for w in sorted(set(words))], "term string").select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]
        by = known.filter(F.col("bucket").isin(places)).groupBy("circular_id", "col").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        begins = lambda k, w: F.transform(F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>")), lambda x: x - k)
        common = reduce(F.array_intersect, (begins(k, w) for k, w in enumerate(words)))
        found = by.filter(F.size(common) > 0).select("circular_id").distinct()
        out = found if out is None else out.join(found, "circular_id", "left_semi")
    return out


def matches(terms: list[str]) -> Column:
    """Every term's tokens stand in a row in the subject or in the body. A text that lacks a token isn't tokenised."""

    def one(term: str) -> Column:
        words = re.findall(r"[^\W_]+", term)
        if not words:
            return F.lit(True)
        phrase = " " + " ".join(words) + " "
        may = lambda c: reduce(lambda a, b: a & b, (plain(F.col(c)).contains(w) for w in words))
        return (may("body") & F.col("body_tokens").contains(phrase)) | (may("subject") & F.col("subject_tokens").contains(phrase))

    return reduce(lambda a, b: a & b, map(one, terms), F.lit(True))


def snippet(terms: list[str], text: str = "subject", size: int = 18) -> Column:
    """The stretch of `size` words of a text that has the most terms (the first such), with the terms in brackets."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    forms = [re.escape(w) for t in terms for w in re.findall(r"[^\W_]+", t)]
    if not forms:
        return F.array_join(F.slice(words, 1, size), " ")
    hit = lambda w: plain(w).rlike("(?U)(?<![\\p{L}\\p{N}])(?:" + "|".join(forms) + ")(?![\\p{L}\\p{N}])")
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    ranked = F.transform(places, lambda p: F.struct((-F.size(F.filter(places, lambda q: (q >= p) & (q < p + size)))).alias("n"), p.alias("p")))
    start = F.greatest(F.least(F.coalesce(F.get(F.array_sort(ranked), F.lit(0)).p, F.lit(0)), F.size(words) - size), F.lit(0))
    return F.array_join(F.transform(F.slice(words, start + 1, size), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def search(indexed: DataFrame, bridge: DataFrame, query: str, event: str | None = None, limit: int = 10, stored: str | None = None) -> DataFrame:
    """circular_id, score, snippet, head: 3 primary event, 2 named event, 1 text; newest first, ids in text order.

    Without terms the event's bulletins are listed. stored: a folder of write_postings(), which is read instead of texts.
    """
    wanted, terms = split_query(query, event)
    found = stored_hits(indexed.sparkSession, stored, terms) if stored else None
    hits = indexed.join(found, "circular_id", "left_semi") if found is not None else indexed.filter(matches(terms))
    if wanted:
        of = bridge.filter(F.col("event_norm") == wanted).groupBy("circular_id").agg(F.max("is_primary").alias("main"))
        hits = hits.join(of, "circular_id").withColumn("score", F.when(F.col("main"), 3).otherwise(2))
    else:
        hits = hits.withColumn("score", F.lit(1))
    top = hits.orderBy(F.desc("score"), F.desc("created_on"), F.desc(F.col("circular_id").cast("string"))).limit(limit)
    return top.select("circular_id", F.col("score").cast("long").alias("score"), "created_on", snippet(terms).alias("snippet"), F.substring("body", 1, 320).alias("head"))


def event_circulars(circulars: DataFrame, bridge: DataFrame, event: str) -> DataFrame:
    """All bulletins that name an event, newest first."""
    wanted = bridge.filter(F.col("event_norm") == names.normal(event)).select("circular_id").distinct()
    return circulars.join(wanted, "circular_id", "left_semi").orderBy(F.desc("created_on"), F.desc(F.col("circular_id").cast("string")))
