"""Toxic spans by a linear-chain conditional random field.

Labels are per document. Token labels come from the corpus: over all labelled training rows, a term is toxic if it
stands in at least `min_docs` toxic documents and `precision` of the documents that have it are toxic (as if the
classes were equally large); in toxic documents its tokens are labelled 1, all other tokens 0. Tokens are labelled in
the sample alone, so the terms of its toxic documents, all of them, are the ones counted. A two-state chain is fitted to a bounded sample of
labelled documents (`sample` of each class, by hash order) by gradient ascent on the exact likelihood; its features
are each token's word and its first six bytes, hashed, and the transitions. Forward-backward then gives every token
of a text its marginal probability; tokens at or above one half make the offending spans, and a logistic function of
the largest marginal, their sum, their mean and the toxic tokens' number is the document's score.

Chains are lines, of any length. All tokens of a batch are one sequence of 2 x 2 steps in which a chain's first step
forgets what was before it; the sequence is cut into stretches of at most `STRETCH` steps that advance together in numpy, and
messages are carried across the cuts, so that marginals are exact. The model is of fixed size. Inputs of a score are the
text's words alone.

Defined results: null, empty and wordless texts get the score of a document without marginals; rows that repeat get
the same score; without both classes among the labels every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, write_table
from .kernels import ALNUM, U64, byte_values, fingerprints, mix, pieces, utf8, words

STRETCH = 256
#: Bytes of text that are tagged at once: a token takes some 500 bytes on the way.
PIECE = 1 << 19
BUCKETS = 1 << 20
_VALUES = byte_values(ALNUM, True)
_BREAK = 10
#: Up to so many labels (16 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


@dataclass
class Chains:
    """Tokens of a batch: document, byte places, features, and which of them begin a chain."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    feats: np.ndarray  # 2 x n
    first: np.ndarray


def chains(data: np.ndarray, offsets: np.ndarray) -> Chains:
    starts, ends, first = words(data, offsets, ALNUM)
    terms = fingerprints(data, starts, ends, _VALUES)
    head = fingerprints(data, starts, np.minimum(ends, starts + 6), _VALUES)
    feats = np.stack([(terms % U64(BUCKETS)).astype(np.int64), (mix(head + U64(1)) % U64(BUCKETS)).astype(np.int64)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == _BREAK), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    return Chains(doc, starts, ends, terms, feats, new)


@dataclass
class Model:
    weights: np.ndarray  # 2 x BUCKETS, for state 1 against 0
    bias: float
    trans: np.ndarray  # 2 x 2, log scale
    head: np.ndarray  # of the document's score

    def emissions(self, c: Chains) -> np.ndarray:
        return np.clip(self.weights[0][c.feats[0]] + self.weights[1][c.feats[1]] + self.bias, -20, 20)


def _carry(m: np.ndarray) -> np.ndarray:
    """Row vectors (share of state 1) after each of the 2 x 2 matrices m[:, :, k], from (1/2, 1/2) on."""
    n = m.shape[2]
    width = max(1, min(STRETCH, n, 16 + n // 2048))
    rows = -(-n // width)
    pad = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, rows * width - n))
    steps = np.concatenate([m, pad], axis=2).reshape(2, 2, rows, width)
    steps = np.ascontiguousarray(np.moveaxis(steps, 3, 0))  # width x 2 x 2 x rows
    whole = steps[0]
    for k in range(1, width):
        s = steps[k]
        whole = np.stack([whole[:, 0] * s[0, 0] + whole[:, 1] * s[1, 0], whole[:, 0] * s[0, 1] + whole[:, 1] * s[1, 1]], axis=1)
        whole /= whole.sum(axis=(0, 1))
    enter, one = np.empty(rows), 0.5
    for r, (a, b, c, d) in enumerate(zip(*whole.reshape(4, rows).tolist(), strict=True)):
        enter[r] = one
        zero, one = (1 - one) * a + one * c, (1 - one) * b + one * d
        one /= zero + one
    out, p = np.empty((rows, width)), enter
    for k in range(width):
        s = steps[k]
        one = (1 - p) * s[0, 1] + p * s[1, 1]
        p = one / (one + (1 - p) * s[0, 0] + p * s[1, 0])
        out[:, k] = p
    return out.reshape(-1)[:n]


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 and the 2 x 2 expected transitions; e: emissions, first: whether a token begins its chain."""
    if not len(e):
        return np.empty(0), np.zeros((2, 2))
    t, x = np.exp(trans), np.exp(e)
    inner = np.where(first, 1.0, t[:, :, None])  # a first token's step is the same from both states
    steps = np.stack([inner[:, 0], inner[:, 1] * x], axis=1)
    del inner
    f = _carry(steps)
    b = np.full(len(e), 0.5)
    b[:-1] = _carry(np.swapaxes(steps[:, :, ::-1], 0, 1))[::-1][1:]  # messages against the direction: from k to k - 1
    later = ~first
    later[0] = False
    p, one, zero = f[:-1][later[1:]], (x * b)[later], (1 - b)[later]
    joint = np.array([[(1 - p) * t[0, 0] * zero, (1 - p) * t[0, 1] * one], [p * t[1, 0] * zero, p * t[1, 1] * one]])
    pair = (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    return f * b / (f * b + (1 - f) * (1 - b)), pair


def in_blocks(e: np.ndarray, first: np.ndarray, trans: np.ndarray, size: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """forward_backward() over blocks of whole chains, of about `size` tokens each, so that memory stays bounded."""
    if not len(e):
        return np.empty(0), np.zeros((2, 2))
    starts = np.flatnonzero(first)
    cuts = np.unique(starts[np.minimum(np.searchsorted(starts, np.arange(0, len(e), size)), len(starts) - 1)])
    p, pair = np.empty(len(e)), np.zeros((2, 2))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(e)], strict=True):
        p[a:b], own = forward_backward(e[a:b], first[a:b], trans)
        pair += own
    return p, pair


def fit_chain(c: Chains, labels: np.ndarray, steps: int = 40, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Gradient ascent with per-weight rates on the log-likelihood of the token labels."""
    m = Model(np.zeros((2, BUCKETS)), float(np.log((labels.sum() + 1) / (len(labels) + 1))), np.zeros((2, 2)), np.zeros(5))
    y = labels.astype(float)
    seen = np.bincount((2 * y[:-1] + y[1:])[~c.first[1:]].astype(int), minlength=4).reshape(2, 2)
    feats, total = c.feats, max(1.0, labels.sum())
    size_w, size_t, size_b = np.full((2, BUCKETS), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(steps):
        p, pair = in_blocks(m.emissions(c), c.first, m.trans)
        gap = (y - p) / total
        g = np.stack([np.bincount(feats[k], gap, BUCKETS) for k in (0, 1)]) - l2 * m.weights
        size_w += g * g
        m.weights += rate * g / np.sqrt(size_w)
        gt, gb = (seen - pair) / total, gap.sum()
        size_t, size_b = size_t + gt * gt, size_b + gb * gb
        m.trans += rate * 0.3 * gt / np.sqrt(size_t)
        m.bias += rate * 0.3 * gb / np.sqrt(size_b)
    return m


def document_features(p: np.ndarray, c: Chains, n_docs: int) -> np.ndarray:
    """Per document: 1, the largest marginal, log(1 + their sum), the root of their mean, log(1 + toxic tokens)."""
    out = np.zeros((n_docs, 5))
    out[:, 0] = 1
    np.maximum.at(out[:, 1], c.doc, p)
    sums, n = np.bincount(c.doc, p, n_docs), np.bincount(c.doc, minlength=n_docs)
    out[:, 2], out[:, 3] = np.log1p(sums), np.sqrt(sums / np.maximum(n, 1))
    out[:, 4] = np.log1p(np.bincount(c.doc, p >= 0.5, n_docs))
    return out


def marginals(m: Model, c: Chains) -> np.ndarray:
    return in_blocks(m.emissions(c), c.first, m.trans)[0]


def fit_head(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50, l2: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) / weight.sum() - l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def _frequencies(docs: DataFrame, terms: np.ndarray, least: int) -> DataFrame:
    """term, tox, clean: documents that have the term, over (toxic, text) rows, of the terms that `least` toxic ones have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(terms)), np.int64)
        for b in pieces(batches, "text", PIECE) if len(terms) else ():
            toxic = b.column(0).to_numpy()
            starts, ends, first = words(*(d := utf8(b.column(1))), ALNUM)
            t = fingerprints(d[0], starts, ends, _VALUES)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            at = np.searchsorted(terms, t)
            known = terms[np.minimum(at, len(terms) - 1)] == t
            code = np.unique(at[known] * b.num_rows + doc[known])
            hit, of = code // b.num_rows, toxic[code % b.num_rows]
            counts[0] += np.bincount(hit[of == 1], minlength=len(terms))
            counts[1] += np.bincount(hit[of == 0], minlength=len(terms))
        some = counts.sum(axis=0) > 0
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["term", "tox", "clean"])

    return docs.select("toxic", "text").mapInArrow(run, "term long, tox long, clean long").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).filter(F.col("tox") >= least)


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, precision: float = 0.8, sample: int = 1500, min_docs: int = 3) -> Model | None:
    """A model from the labelled rows for which `train` (a condition on doc_id) holds.

    sample bounds the documents of each class that the chain is fitted to; counts are over all training rows.
    """
    known = labels.filter(F.col("toxic").isNotNull()).filter(train if train is not None else F.lit(True)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_tox or not n_clean:
        return None
    few = n_tox + n_clean <= BROADCAST_LABELS
    rows = id_text(docs).join(F.broadcast(known) if few else known, "doc_id").select("doc_id", "toxic", "text")
    rows = rows if few else write_table(rows, "labelled")[0]  # the texts are shuffled once, not once a pass
    taken = [_first(rows.filter(F.col("toxic") == k), n, sample) for k, n in ((0, n_clean), (1, n_tox))]
    taken = pa.concat_tables(taken).combine_chunks()
    toxic = taken.column("toxic").to_numpy()
    c = chains(*utf8(taken.column("text")))
    seen = _frequencies(rows, np.unique(c.terms[toxic[c.doc] == 1]), min_docs).toPandas()
    tox, clean = seen["tox"] / n_tox, seen["clean"] / n_clean  # rates: as if the classes were equally large
    good = tox >= precision * (tox + clean)
    lexicon = np.sort(seen["term"][good].to_numpy(np.int64).view(U64))
    tokens = np.isin(c.terms, lexicon) & (toxic[c.doc] == 1)
    m = fit_chain(c, tokens)
    x = document_features(marginals(m, c), c, len(toxic))
    weight = np.where(toxic == 1, n_tox / max(1, (toxic == 1).sum()), n_clean / max(1, (toxic == 0).sum()))
    m.head = fit_head(x, toxic.astype(float), weight)
    return m


def _first(rows: DataFrame, n: int, sample: int) -> pa.Table:
    """The first rows by the order of a hash: of about n, the lowest hashes alone reach the sort, four times as many
    as are asked for, so that what one task merges doesn't grow with the corpus."""
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 4 * sample / n) * (1 << 30))
    return rows.filter(low).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("toxic", "text").toArrow()


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score, and spans: "start:end" (code points, comma-joined) of runs of toxic tokens."""
    own = id_text(docs, text, key)
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("spans"))
    kept = Model(model.weights.astype(np.float32), model.bias, model.trans, model.head)
    sent = docs.sparkSession.sparkContext.broadcast(kept)  # fixed size: 2 x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in pieces(batches, "text", PIECE):
            data, offsets = utf8(b.column(1))
            c = chains(data, offsets)
            p = marginals(m, c)
            z = document_features(p, c, b.num_rows) @ m.head
            spans: list[list[str]] = [[] for _ in range(b.num_rows)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                new = np.flatnonzero(np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(c.doc[hot]) > 0)]))
                for a, z_ in zip(new.tolist(), np.append(new[1:], len(hot)).tolist(), strict=True):
                    d = int(c.doc[hot[a]])
                    base = points[offsets[d]]
                    spans[d].append(f"{points[c.starts[hot[a]]] - base}:{points[c.ends[hot[z_ - 1]]] - base}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array([",".join(s) for s in spans])], names=["doc_id", "score", "spans"])

    return own.mapInArrow(run, "doc_id long, score double, spans string")
