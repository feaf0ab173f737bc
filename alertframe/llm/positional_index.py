"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a shard is a run of documents of bounded size, and for each shard and term the
index stores the term's positions in it, delta-coded. Document starts are kept apart, with a gap of one position, so
that no phrase runs from one document into the next. A search reads the postings of the benchmark's terms alone,
brings a shard's postings together (bounded by the shard) and, per window of a test item, starts from the window's
rarest term in that shard and intersects the other terms' lists adjusted by their offsets.

A common term or passage is spread over all shards, so no key gathers rows. The benchmark is the query set: it is
handled in blocks of at most `block` items, each block against the whole index.

Words: A-Z lower-cased, then runs of ASCII digits, letters and all non-ASCII characters. Terms are 64-bit
fingerprints. Defined results: a null or empty text has no words and no hits; rows that repeat are each found; an
item without words is no item, an item's repeated rows count once; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, write_table
from .kernels import ALNUM, U64, byte_values, fingerprints, pieces, utf8, words

INDEX = "shard long, term long, n int, postings binary, doc_ids array<long>, doc_words array<int>"
FOUND = "shard long, place int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<s:int,e:int>>"
_VALUES = byte_values(ALNUM, True)


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' fingerprints, and for each document its first word's index (n + 1)."""
    starts, ends, first = words(data, offsets, ALNUM)
    return fingerprints(data, starts, ends, _VALUES), first


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the top bit set on all but the last; and each number's bytes."""
    lens = np.ones(len(x), np.int64)
    for b in (7, 14, 21, 28):
        lens += x >> b > 0
    rows = (x[:, None] >> np.arange(0, 35, 7)) & 127
    keep = np.arange(5) < lens[:, None]
    rows[np.arange(5) < lens[:, None] - 1] |= 128
    return rows[keep].astype(np.uint8), lens


def unvarint(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, first)


def _shard(shard: int, terms: np.ndarray, n_words: np.ndarray, doc_ids: list) -> Iterator[pa.RecordBatch]:
    place = np.arange(len(terms)) + np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(terms, kind="stable")
    ranked, place = terms[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    delta = np.diff(place, prepend=0)
    delta[new] = place[new]
    code, lens = varints(delta)
    at = np.concatenate([[0], np.cumsum(lens)])[np.append(new, len(ranked))].astype(np.int32)
    k = len(new)
    postings = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(at), pa.py_buffer(code)])
    none = lambda t: pa.nulls(k, t)
    names = ["shard", "term", "n", "postings", "doc_ids", "doc_words"]
    ids_type, n_type = pa.list_(pa.int64()), pa.list_(pa.int32())
    if k:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard)), pa.array(ranked[new].view(np.int64)), pa.array(np.diff(np.append(new, len(ranked))), pa.int32()), postings, none(ids_type), none(n_type)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([doc_ids], ids_type), pa.array([n_words], n_type)], names=names)


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_words: int = 1_500_000) -> DataFrame:
    """The stored index: a row per shard and term, and one per shard (null term) with its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        terms, counts, ids = [], [], []
        for b in pieces(batches, "text"):
            t, first = text_terms(*utf8(b.column(1)))
            terms.append(t)
            counts.append(np.diff(first))
            ids += b.column(0).to_pylist()
            if sum(map(len, terms)) >= shard_words:
                yield from _shard(base + seq, np.concatenate(terms), np.concatenate(counts), ids)
                terms, counts, ids, seq = [], [], [], seq + 1
        if terms:
            yield from _shard(base + seq, np.concatenate(terms), np.concatenate(counts), ids)

    return write_table(id_text(docs, text, key).mapInArrow(run, INDEX), "postings")[0]


def item_windows(items: list[tuple[str, str]], size: int) -> tuple[list[np.ndarray], list[list[str]]]:
    """Distinct windows of `size` consecutive words (a shorter item: all its words), and each window's items."""
    found: dict[bytes, tuple[np.ndarray, dict[str, None]]] = {}
    terms, first = text_terms(*utf8(pa.array([t for _, t in items], pa.string())))
    for k, (item, _) in enumerate(items):
        own = terms[first[k] : first[k + 1]]
        for i in range(max(1, len(own) - size + 1) if len(own) else 0):
            w = own[i : i + size]
            found.setdefault(w.tobytes(), (w, {}))[1][item] = None
    return [w for w, _ in found.values()], [list(i) for _, i in found.values()]


def intersect(lists: list[np.ndarray]) -> np.ndarray:
    """Where the phrase starts: lists[k] has the sorted places of its k-th word; rarest first."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    at = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(at):
            break
        want, have = at + k, lists[k]
        near = np.minimum(np.searchsorted(have, want), len(have) - 1)
        at = at[have[near] == want]
    return at


def near(lists: list[np.ndarray], width: int, starts: np.ndarray) -> np.ndarray:
    """Places of the rarest word that have every other word of the same document fewer than `width` words away."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    at = lists[order[0]]
    for k in order[1:]:
        doc = np.searchsorted(starts, at, "right") - 1
        low, high = np.maximum(at - width + 1, starts[doc]), np.minimum(at + width - 1, starts[doc + 1] - 1)
        at = at[np.searchsorted(lists[k], low) < np.searchsorted(lists[k], high, "right")]
    return at


def search(index: DataFrame, benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text", proximity: int = 0, block: int = 20_000, signs: int = 16_000_000) -> DataFrame:
    """A row per indexed document: its words, hit words, items (sorted strings) and merged hit spans (in words).

    proximity 0 asks for exact phrases: all words of a window in a row. proximity p > 0 asks for all words of a
    window within p words of its rarest one, in any order; the span is then that word's.
    """
    asked = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("signs")).first()
    blocks = max(1, -(-sizes.n // block), -(-sizes.signs // signs))  # what the driver and a task hold at once
    parts = [_search_block(index, asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k), size, proximity) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if blocks == 1 else _merge_blocks(out)


def _merge_blocks(found: DataFrame) -> DataFrame:
    both = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    merged = F.expr("aggregate(all, cast(array() as array<struct<s:int,e:int>>), (a, x) -> case when size(a) > 0 and x.s <= a[size(a) - 1].e then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].s as s, greatest(x.e, a[size(a) - 1].e) as e))) else concat(a, array(x)) end)")
    out = both.withColumn("spans", merged).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)"))
    return out.select("shard", "place", "doc_id", "n_words", "n_hit", "items", "spans")


def _search_block(index: DataFrame, asked: DataFrame, size: int, proximity: int) -> DataFrame:
    spark = index.sparkSession
    windows, owners = item_windows([(r.item, r.t) for r in asked.collect()], size)  # at most `block` items
    vocabulary = np.unique(np.concatenate(windows)) if windows else np.empty(0, U64)
    phrases = [np.searchsorted(vocabulary, w) for w in windows]
    wanted = spark.createDataFrame(pa.table({"term": pa.array(vocabulary.view(np.int64))}).to_pandas(), "term long")
    read = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.filter(F.col("term").isNull()))  # bounded by the block

    def shard(rows: pa.Table) -> pa.Table:
        term, own_shard = rows.column("term"), rows.column("shard")[0].as_py()
        head = int(np.flatnonzero(term.is_null().to_numpy())[0])
        doc_ids, n_words = rows.column("doc_ids")[head].as_py(), np.array(rows.column("doc_words")[head].as_py(), np.int64)
        starts = np.concatenate([[0], np.cumsum(n_words + 1)])
        rows = rows.filter(pc.is_valid(term))
        known = np.searchsorted(vocabulary, rows.column("term").to_numpy().view(U64))
        codes = dict(zip(known.tolist(), rows.column("postings").to_pylist(), strict=True))
        lists: dict[int, np.ndarray] = {}

        def places(k: int) -> np.ndarray:
            if k not in lists:
                lists[k] = np.cumsum(unvarint(np.frombuffer(codes[k], np.uint8)))
            return lists[k]

        hit_at, hit_len, hit_window = [], [], []
        for w, phrase in enumerate(phrases):
            own = phrase.tolist()
            if all(k in codes for k in own):
                found = near([places(k) for k in dict.fromkeys(own)], proximity, starts) if proximity else intersect([places(k) for k in own])
                if len(found):
                    hit_at.append(found)
                    hit_len.append(np.full(len(found), 1 if proximity else len(own)))
                    hit_window.append(np.full(len(found), w))
        hit = np.zeros(int(starts[-1]) + 1, np.int64)
        items: dict[int, set[str]] = {}
        if hit_at:
            at, lens, of = np.concatenate(hit_at), np.concatenate(hit_len), np.concatenate(hit_window)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + lens, -1)
            pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, of]), axis=1)
            for d, w in pairs.T.tolist():
                items.setdefault(d, set()).update(owners[w])
        covered = (np.cumsum(hit) > 0)[:-1]
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(starts, s, "right") - 1
        spans: dict[int, list] = {}
        for d, a, b in zip(of.tolist(), (s - starts[of]).tolist(), (e - starts[of]).tolist(), strict=True):
            spans.setdefault(d, []).append({"s": a, "e": b})
        n = len(doc_ids)
        return pa.table({
            "shard": pa.array(np.full(n, own_shard)), "place": pa.array(np.arange(n), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(n_words),
            "n_hit": pa.array([sum(x["e"] - x["s"] for x in spans.get(d, ())) for d in range(n)], pa.int64()), "items": pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
            "spans": pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
        })

    return read.groupBy("shard").applyInArrow(shard, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the rows that share a window of `size` words with the benchmark; all columns stay.

    Rows are known by a hash of doc_id and text, since ids may be null or repeat.
    """
    own = F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    found = search(build_index(docs.select(own.alias("doc_id"), "text")), benchmark, size)
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias("__d")).distinct()
    return docs.join(bad, own == bad["__d"], "left_anti")


ORACLE = r"""
with d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where text is not null),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
       from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as g
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select distinct dw.r, dw.i, dw.n, bw.item from dw join bw using (n, g)),
cov as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
its as (select r, count(distinct item)::bigint as n_items, string_agg(distinct item, ',' order by item) as items from hit group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(cov.n_hit, 0) as n_hit, coalesce(its.n_items, 0) as n_items,
  sha256(coalesce(its.items, '')) as items_sha256, coalesce(cov.n_hit, 0) > 0 as contaminated
from d left join cov using (r) left join its using (r)
"""
