"""BagMinHash near-duplicate detection over multisets of word shingles.

Signature. A document is the multiset of its five-word shingles (fewer words: one shingle of all). Weights are the
counts, discretised at the integers. A shingle of weight w owns the strips (0,1], (1,2], (2,4], (4,8], ... up to w;
each strip is a Poisson process in time whose rate is its width, points falling on a random slot, and a strip that w
covers in part keeps the points at or below w. A slot's value is its first point over all the document's strips, so
two documents agree in a slot with probability exactly their weighted Jaccard similarity. A strip is followed only
while its next point can still come first somewhere, and all strips of a batch advance together in numpy.

Grouping. 40 bands of 6 slots make buckets (a pair at 0.8 is missed with probability 5e-6). Texts of a bucket are not
paired with each other: each is verified against the bucket's most connected text, exactly, on the multisets, which
joins nearly all of a group. The texts of buckets that then still hold several components are looked at once more: each
is known by its rarest shingles, of which two texts of enough similarity must share one (rare_shingles), and where
different components meet in one, the texts outside the main component are gathered in blocks, against which the
others are held inside a task. So no link between different texts is lost, pairs are never listed, and texts that have
only a template in common don't meet. Exact copies are one text throughout; components come from alternating large-star
and small-star steps on written tables. Every document is given with the verified links of its text and the best
similarity among them; links inside a component that is joined already are not looked for.

Defined results: a text without a word (null, empty, blank) is alone in its class; rows that repeat are copies; a
class is named by its least doc_id; a null doc_id never names a class that has another; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, id_text, write_table
from .kernels import NONSPACE, U64, byte_values, fingerprints, mix, pieces, ragged, utf8, words

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 6
_VALUES = byte_values(NONSPACE, False)
_STEP = U64(0x9E3779B97F4A7C15)
_BITS = U64(48)
_LOW = U64((1 << 48) - 1)
#: Cells of the table of shingle frequencies, and how many ways a component's rows are spread.
CELLS, SALTS = 1 << 18, 32


def shingle_bags(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (ascending), 48-bit shingles (ascending within) and counts; at most 65,536 documents."""
    starts, ends, first = words(data, offsets, NONSPACE)
    w = fingerprints(data, starts, ends, _VALUES)
    n = np.diff(first)
    mine = np.maximum(n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), mine)
    at = np.repeat(first[:-1], mine) + np.arange(len(doc)) - np.repeat(np.cumsum(mine) - mine, mine)
    end = first[1:][doc]
    s = np.zeros(len(doc), U64)
    for j in range(k):
        inside = at + j < end
        s = mix(s + np.where(inside, w[np.minimum(at + j, len(w) - 1)], U64(j)) + _STEP) if len(w) else s
    key = np.sort((doc.astype(U64) << _BITS) | (s >> U64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return (key[new] >> _BITS).astype(np.int64), key[new] & _LOW, np.diff(np.append(new, len(key)))


def bag_minhash(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m slot values (64-bit names of points); rows of documents without items are 0."""
    strips = np.ones(len(count), np.int64) + np.ceil(np.log2(count)).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), strips)
    level = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    state = mix(item[of] + level.astype(U64) * _STEP)
    d, most = doc[of], count[of]
    t = np.zeros(len(of))
    first = np.full(n_docs * m, np.inf)
    name = np.zeros(n_docs * m, U64)
    limit = np.full(n_docs, np.inf)
    while len(d):
        state = state + _STEP
        r = mix(state)
        t = t - np.log1p(-(r >> U64(11)).astype(np.float64) * 2.0**-53) / (m * width)
        live = t < limit[d]
        if not live.all():
            d, most, width, state, t, r = d[live], most[live], width[live], state[live], t[live], r[live]
        r2 = mix(r ^ _STEP)
        slot = d * m + (r2 % U64(m)).astype(np.int64)
        if (width > 1).any():
            place = width + 1 + ((r2 >> U64(20)) % width.astype(U64)).astype(np.int64)
            inside = (width == 1) | (place <= most)  # (0,1] and (1,2] are covered whole
            slot_in, t_in, r_in = slot[inside], t[inside], r[inside]
        else:
            slot_in, t_in, r_in = slot, t, r
        np.minimum.at(first, slot_in, t_in)
        won = first[slot_in] == t_in
        name[slot_in[won]] = r_in[won]
        present = np.unique(d)
        limit[present] = first.reshape(n_docs, m)[present].max(axis=1)
    return name.reshape(n_docs, m)


def band_keys(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(names), bands), U64) + np.arange(bands, dtype=U64) * _STEP
    cells = names.reshape(len(names), bands, rows)
    for j in range(rows):
        key = mix(key + cells[:, :, j])
    return key


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (16-byte name of the text) and its band keys (none for a text without words)."""
    schema = "doc_id long, node binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for at in range(0, b.num_rows, 1 << 15):
                part = b.slice(at, 1 << 15)
                doc, item, count = shingle_bags(*utf8(part.column(1)), k)
                n = part.num_rows
                keys = band_keys(bag_minhash(doc, item, count, n, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=n) > 0
                off = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(off), pa.array(keys[some].reshape(-1).view(np.int64)))], names=["doc_id", "node", "bands"])

    return id_text(docs, text, key).withColumn("node", F.unhex(F.md5("text"))).select("doc_id", "text", "node").mapInArrow(run, schema)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags (ascending items, counts): sum of minima over sum of maxima; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def verify(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, block: int = 256) -> DataFrame:
    """pairs (x, p) with their exact similarity; texts: node, text, one row or equal rows per node.

    A pivot's partners are dealt to blocks of about `block`, each of which gets the pivot's text once.
    """
    blocks = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "p").select(F.col("x").alias("node"), "p", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("b"), F.lit(1).alias("o"))
    own = blocks.select(F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("o"))
    rows = dealt.unionByName(own).join(texts, "node").select("p", "b", "o", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, bag = None, (np.empty(0, U64), np.empty(0, np.int64))
        for part in pieces(batches, "text"):
            doc, item, count = shingle_bags(*utf8(part.column(4)), k)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            x, p, sim = [], [], []
            for i, (own_p, b, o, node) in enumerate(zip(*(c.to_pylist() for c in part.columns[:4]), strict=True)):
                mine = item[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
                if o == 0:
                    pivot, bag = (own_p, b), mine
                elif pivot == (own_p, b):
                    x.append(node)
                    p.append(own_p)
                    sim.append(weighted_jaccard(mine, bag))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(p, pa.binary()), pa.array(sim, pa.float64())], names=["x", "p", "sim"])

    return rows.repartition("p", "b").sortWithinPartitions("p", "b", "o").mapInArrow(run, "x binary, p binary, sim double")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's least node) for all nodes of the edges (u, v), by large-star and small-star."""
    now, path = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = write_table(kept.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        got = nxt.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        drop_path(edges.sparkSession, path)  # nothing that is still to run reads the older table
        now, path = nxt, nxt_path
        if mark == tuple(got):
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _links(asked: list[tuple], held: list[tuple], threshold: float) -> Iterator[tuple[bytes, bytes, float]]:
    """Links between asked and held texts (node, component, items, counts) that join what wasn't joined before."""
    if not asked:
        return
    of = np.repeat(np.arange(len(asked)), [len(q[2]) for q in asked])
    items, counts = np.concatenate([q[2] for q in asked]), np.concatenate([q[3] for q in asked])
    order = np.argsort(items, kind="stable")
    items, counts, of = items[order], counts[order], of[order]
    totals = np.array([q[3].sum() for q in asked])
    root: dict[bytes, bytes] = {}

    def find(c: bytes) -> bytes:
        while c in root:
            c = root[c]
        return c

    for node, comp, own, weight in held:
        low, high = np.searchsorted(items, own), np.searchsorted(items, own, "right")
        at = ragged(low, high - low)
        shared = np.bincount(of[at], np.minimum(counts[at], np.repeat(weight, high - low)), len(asked))
        for k in np.flatnonzero(shared >= threshold * (totals + weight.sum() - shared)):
            a, b = find(asked[k][1]), find(comp)
            if a != b and asked[k][0] != node:
                root[a] = b
                yield asked[k][0], node, float(shared[k] / (totals[k] + weight.sum() - shared[k]))


def block_links(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """rows (main, blk, role, node, comp, text) -> links (x, p, sim): role 0 texts of a block against its role 1 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, []
        for part in pieces(batches, "text"):
            doc, item, count = shingle_bags(*utf8(part.column(5)), k)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            links, held = [], []

            def flush(links: list = links, held: list = held) -> None:
                links.extend(_links(asked, held, threshold))
                held.clear()

            for i, (main, blk, role, node, comp) in enumerate(zip(*(c.to_pylist() for c in part.columns[:5]), strict=True)):
                if block != (main, blk):
                    flush()
                    block, asked = (main, blk), []
                (held if role else asked).append((node, comp, item[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]))
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([v[c] for v in links], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["x", "p", "sim"])

    return rows.repartition("main", "blk").sortWithinPartitions("main", "blk", "role").mapInArrow(run, "x binary, p binary, sim double")


def _ranks(rows: DataFrame, k: int) -> np.ndarray:
    """How many texts (column text) have a shingle of each of CELLS hash cells: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for part in pieces(batches, "text"):
            for at in range(0, part.num_rows, 1 << 15):
                counts += np.bincount((shingle_bags(*utf8(part.slice(at, 1 << 15).column(0)), k)[1] % U64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])

    total = rows.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[total.column("cell").to_numpy()] = total.column("n").to_numpy()
    return out


def rare_shingles(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """rows (node, comp, text) -> node, comp, key: the rarest shingles of each text, so many that two texts with that
    similarity share one of them.

    Texts of similarity t share at least t of the larger one's shingles, counted with their repeats; so the rarest ones
    that make up more than 1 - t of a text, in any order that is the same for all texts, can't all be strange to the
    other. The order is by an approximate number of texts, so that shingles of a template come last.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_ranks(rows, k))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for part in pieces(batches, "text"):
            for at in range(0, part.num_rows, 1 << 15):
                own = part.slice(at, 1 << 15)
                doc, item, count = shingle_bags(*utf8(own.column(2)), k)
                order = np.lexsort((item, rank[(item % U64(CELLS)).astype(np.int64)], doc))
                doc, item, count = doc[order], item[order], count[order]
                first = np.searchsorted(doc, np.arange(own.num_rows + 1))
                before = np.cumsum(count) - count
                before -= np.append(before, 0)[first[:-1]][doc]  # repeats of rarer shingles of the text
                total = np.bincount(doc, count, own.num_rows)[doc]
                rare = before <= (1 - threshold) * total + 1e-9
                of = pa.array(doc[rare])
                yield pa.RecordBatch.from_arrays([own.column(0).take(of), own.column(1).take(of), pa.array(item[rare].view(np.int64))], names=["node", "comp", "key"])

    return rows.select("node", "comp", "text").mapInArrow(run, "node binary, comp binary, key long")


def _rest(buckets: DataFrame, comp: DataFrame, texts: DataFrame, threshold: float, k: int, block: int = 256) -> DataFrame | None:
    """Links between texts of buckets that still hold several components; none if there are no such buckets.

    Such texts meet where they share one of their rarest shingles, which texts that have only a template in common don't.
    There the texts outside the main component are dealt to blocks, and what they meet is held against a block at a time,
    in parts of some 2 * block texts.
    """
    now = buckets.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
    left = now.join(split, "key").select("node", "comp").distinct()
    rows, _ = write_table(left.join(texts, "node"), "split")
    if rows.isEmpty():
        return None
    rare, _ = write_table(rare_shingles(rows, threshold, k), "rare")
    sizes = rare.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("m"))
    met, _ = write_table(rare.join(sizes.filter("comps > 1").select("key", F.col("m.comp").alias("main"), F.col("m.c").alias("c")), "key"), "met")
    outside = met.filter("comp <> main").select("key", "main", "c", "node", "comp")
    each = outside.groupBy("main", "node").agg(F.max("c").alias("c"))
    blocks = each.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).alias("k"), F.ceil(F.max("c") / (2 * block)).alias("parts"))
    salted = blocks.select("main", "k", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a hot component's rows are spread
    dealt = outside.withColumn("salt", F.pmod(F.xxhash64("key", "node"), F.lit(SALTS)).cast("int")).join(salted, ["main", "salt"])
    dealt, _ = write_table(dealt.select("key", "main", F.pmod(F.xxhash64("node"), F.col("k")).alias("blk"), "parts", "node", "comp"), "outside")
    part = lambda p: F.col("blk") * F.lit(1 << 20) + p  # what a block meets is dealt to parts, if it is much
    asked = dealt.select("main", "blk", "parts", "node", "comp").distinct().select("main", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), part)).alias("blk"), F.lit(0).alias("role"), "node", "comp")
    held = dealt.select("key", "main", "blk", "parts").distinct().join(met.select("key", "node", "comp"), "key").select("main", part(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("blk"), F.lit(1).alias("role"), "node", "comp").distinct()
    return block_links(asked.unionByName(held).join(texts, "node").select("main", "blk", "role", "node", "comp", "text"), threshold, k)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of its near-duplicate class), copy_of (of its exact copies), and
    of its text's verified links to other texts their number (n_links) and the best similarity (null without links)."""
    return _classes(docs, text, key, threshold, k, bands, rows).select("doc_id", "class_id", "copy_of", "n_links", "similarity")


def _classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates, and of each document its text's hash (node) and whether it stands for its class (main)."""
    signed = signatures(docs, text, key, k, bands, rows)
    every, _ = write_table(signed.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "texts")
    named = every.filter(F.size("bands") > 0)
    members = named.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets, _ = write_table(members.join(shared, "key"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    held = id_text(docs, text, key).withColumn("node", F.unhex(F.md5("text")))
    wanted = buckets.select("node").distinct().join(named.select("node", "doc"), "node")
    texts, _ = write_table(held.join(wanted, (held["node"] == wanted["node"]) & held["doc_id"].eqNullSafe(wanted["doc"])).select(held["node"], "text"), "near-texts")
    hubs = buckets.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("p"))
    stars = buckets.join(hubs, "key").filter("node <> p").select(F.col("node").alias("x"), "p").distinct()
    links, _ = write_table(verify(stars, texts, k).filter(F.col("sim") >= threshold).select(F.col("x").alias("u"), F.col("p").alias("v"), "sim"), "links")
    comp, _ = write_table(components(links), "components")
    more = _rest(buckets, comp, texts, threshold, k)
    if more is not None:
        found, _ = write_table(more.select(F.col("x").alias("u"), F.col("p").alias("v"), "sim"), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            comp, _ = write_table(components(links), "components")
    pairs = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").distinct()  # a bucket's hub may be another one's text
    ends = pairs.select(F.col("u").alias("node"), "sim").unionByName(pairs.select(F.col("v").alias("node"), "sim"))
    linked = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"), F.max("sim").alias("similarity"))
    classed = every.join(comp, "node", "left").join(linked, "node", "left")
    classed = classed.select("node", "doc", F.coalesce("comp", "node").alias("comp"), (F.size("bands") == 0).alias("blank"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity")
    least = classed.groupBy("comp").agg(F.min("doc").alias("class_id"), F.min(F.struct(F.col("doc").isNull(), "doc", "node")).alias("least"))
    names = classed.join(least, "comp").select("node", F.col("doc").alias("copy_of"), "class_id", "blank", "n_links", "similarity", (F.col("node") == F.col("least.node")).alias("first"))
    ids = id_text(docs, text, key).select("doc_id", F.unhex(F.md5("text")).alias("node"))
    own = F.col("blank")
    main = own | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("copy_of")))
    named = [F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "copy_of")]
    return ids.join(names, "node").select("doc_id", *named, "n_links", "similarity", "node", main.alias("main"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each class: the one that names it (a repeated row of it: once); all columns stay.

    Rows are known by doc_id and text, since ids may be null or repeat.
    """
    found, _ = write_table(_classes(docs, text), "classes")
    named = found.select(F.col("doc_id").alias("__d"), F.col("node").alias("__n"), "main")
    same = lambda left, right: left["doc_id"].eqNullSafe(right["__d"]) & (F.unhex(F.md5(F.coalesce(left[text], F.lit("")))) == right["__n"])
    gone = named.filter(~F.col("main")).select("__d", "__n")
    kept = docs.join(gone, same(docs, gone), "left_anti")
    again = named.filter("main").groupBy("__d", "__n").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d", "__n")
    if again.isEmpty():
        return kept
    return kept.join(again, same(kept, again), "left_anti").unionByName(kept.join(again, same(kept, again), "left_semi").dropDuplicates(["doc_id", text]))
