"""Token counts, packing, binary files and the index against the tokenizers library and plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from alertframe.llm import binary_output, packing, positional_index, token_counts, tokens
from alertframe.llm.common import fresh_path
from alertframe.llm.kernels import utf8

from .helpers import clashing, corpus, frame

TOK = Tokenizer.from_file(tokens.vocab_path())
ODD = ["", "a  b", "a   b", " x", "  x", "x ", "a\n b", "a \n b", "<|endoftext|> x", "x <|endoftext|>  y", "é  b\u2003c　 c", "we're don't 're '", "日本 語", "\t \t", "we'll've 'd'", "\x1c a \x1d"]


def odd_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = [" ", " ", "a", "b", "\n", "é", "\u2003", "'", "re", "ll", "1", ".", "<|endoftext|>", "　", "The", "tion", "\x1c", "\x85"]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(n)]


def ids_of(t: str | None) -> list[int]:
    return TOK.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    texts = odd_texts(1500, 1)
    e = tokens.Encoder(tokens.vocab_path(), keep=500)
    for _ in range(2):
        ids, off = e.encode(*utf8(pa.array([*texts, None])))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [ids_of(t) for t in [*texts, ""]]
    assert (e.frequencies(*utf8(pa.array(texts))) == np.bincount(ids, minlength=e.size)).all()


def test_prefix_counts():
    c = token_counts.PrefixCounter(tokens.vocab_path())
    for t in odd_texts(250, 2):
        assert c.prefix_counts(t).tolist() == [len(ids_of(t[:i])) for i in range(len(t) + 1)]


def test_token_counts(spark):
    rows = corpus()
    got = token_counts.token_counts(clashing(frame(spark, rows), "n_tokens"), budget=40, tables=True)
    again = Counter()
    for r in token_counts.count_at(got, 25).collect():
        again[(r.doc_id, r.n_bytes, r.n_chars, r.n_tokens, r.tokens_at)] += 1
        t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        assert len(ids_of(t[: r.fit_chars])) <= 40
        assert r.fit_chars == r.n_chars or len(ids_of(t[: r.fit_chars + 1])) > 40
    assert again == Counter((r[0], len((r[1] or "").encode()), len(r[1] or ""), len(ids_of(r[1])), len(ids_of((r[1] or "")[:25]))) for r in rows)
    assert token_counts.token_counts(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 1024])
def test_packing(spark, size):
    rows = corpus()
    got = packing.pack(clashing(frame(spark, rows), "part", "rank", "base"), size=size).collect()
    want = Counter()
    for r in rows:
        ids = [*ids_of(r[1]), 2]
        first = len(ids) - (-(-len(ids) // size) - 1) * size
        start, k = 0, 0
        while start < len(ids):
            n = size if k else first
            want[(r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
            start, k = start + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    least = -(-sum(r.length for r in got) // size)
    assert len(bins) <= least + max(1, least // 20)
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def test_plan_against_exhaustive():
    r = random.Random(4)

    def exact(items: tuple[int, ...], size: int) -> int:
        best = len(items)

        def go(k: int, bins: list[int]) -> None:
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] >= items[k] and bins[i] not in bins[:i]:
                    bins[i] -= items[k]
                    go(k + 1, bins)
                    bins[i] += items[k]
            go(k + 1, [*bins, size - items[k]])

        go(0, [])
        return best

    for _ in range(40):
        items = tuple(sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True))
        plan = packing.plan_bins(np.bincount(items, minlength=21), 20)
        assert Counter(x for f, t in plan for x in f * t) == Counter(items)
        assert all(sum(f) <= 20 for f, _ in plan)
        assert sum(t for _, t in plan) == exact(items, 20)
    big = np.random.default_rng(1).integers(0, 5000, 1025)
    big[[0, 1024]] = 0
    plan = packing.plan_bins(big)
    assert sum(t for _, t in plan) <= 1.006 * (big * np.arange(1025)).sum() / 1024 + 1
    small = np.where(np.arange(1025) < 400, big, 0)
    assert sum(t for _, t in packing.plan_bins(small)) <= 1.0005 * (small * np.arange(1025)).sum() / 1024 + 1


def test_rank_code_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 1000):
        x = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> r.integers(0, 32, n).astype(np.uint32)
        control, data = binary_output.encode_ranks(x)
        assert (binary_output.decode_ranks(control, data, n) == x).all()


def test_binary_files(spark):
    rows = corpus()
    folder = fresh_path(spark, "test-ids")
    manifest = binary_output.write_ids(clashing(frame(spark, rows), "h"), folder, file_ids=3000)
    assert manifest.count() > 2
    got = binary_output.read_ids(spark, folder).collect()
    want = Counter((r[0], len(ids_of(r[1])) + 1, zlib.crc32(np.array([*ids_of(r[1]), 0], "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, (False, 0)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        assert (r.doc_id is not None, r.doc_id or 0) >= last
        at, last = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)


def test_binary_files_of_nothing(spark):
    assert binary_output.round_trip(frame(spark, []).limit(0)).count() == 0


def plain_words(t: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def items_for(rows: list[tuple]) -> list[tuple]:
    long_ = plain_words(rows[-4][1])
    mid = plain_words(rows[20][1])
    return [(1, " ".join(long_[100:130])), (2, None), (3, "  ..  "), (4, " ".join(mid[:3]).upper()), (5, "not in any text at all that anyone ever wrote here"), (10, " -- ".join(long_[5000:5015])), (10, " ".join(long_[5000:5015])), (11, "one")]


@pytest.mark.parametrize("block", [20_000, 2])
def test_index_search(spark, block):
    rows = corpus()
    items = items_for(rows)
    wins: dict[tuple, set[str]] = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = Counter()
    for r in rows:
        w = plain_words(r[1])
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        want[(r[0], len(w), len(hit), tuple(sorted(found)))] += 1
    index = positional_index.build_index(clashing(frame(spark, rows), "term", "shard"), shard_words=4000)
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"), "term")
    got = positional_index.search(index, bench, block=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(r.n_hit == sum(s.e - s.s for s in r.spans) for r in got)


def test_index_empty_sides(spark):
    rows = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    index = positional_index.build_index(frame(spark, rows))
    got = positional_index.search(index, none).collect()
    assert len(got) == len(rows) and not any(r.n_hit for r in got)
    assert positional_index.search(positional_index.build_index(frame(spark, []).limit(0)), none).count() == 0


def test_proximity(spark):
    rows = [(1, "alpha x beta y gamma", "", "", 0), (2, "gamma beta z alpha", "", "", 0), (3, "alpha " + "x " * 30 + "beta gamma", "", "", 0)]
    index = positional_index.build_index(frame(spark, rows, 1))
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in positional_index.search(index, bench, proximity=6).collect() if r.n_hit} == {1, 2}
    assert not any(r.n_hit for r in positional_index.search(index, bench).collect())
