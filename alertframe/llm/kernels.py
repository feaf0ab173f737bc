"""Numpy kernels over Arrow text: word and unit boundaries, their 64-bit fingerprints, small lookup structures.

A fingerprint is sum(T[byte] * P**i) mod 2**64 over the item's bytes, with a random 64-bit T per byte, then mixed
with the length. Upper-case A-Z can share T with a-z, which lower-cases for free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_PERIOD = 1 << 14
#: Bytes of text that one numpy pass handles at most, but for a single longer document.
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply-xorshift rounds; x is not changed."""
    x = x ^ (x >> U64(31))
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_T = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_POW = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(_PERIOD - 1, 0xD1342543DE82EF95, U64)]))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: a-z, A-Z, 0-9 and all bytes of non-ASCII characters; and everything but ASCII white space.
ALNUM = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
NONSPACE = ~byte_class((9, 13), (32, 32))


def byte_values(lut: np.ndarray, fold: bool) -> np.ndarray:
    """T for the bytes in lut, 0 for others; fold: A-Z as a-z."""
    t = _T.copy()
    if fold:
        t[65:91] = t[97:123]
    return np.where(lut, t, U64(0))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most limit bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of lut's bytes, and for each document its first word's index (n + 1)."""
    inside = lut[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """The fingerprint of data[starts[k]:ends[k]] for each k; starts ascend and items don't overlap."""
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    cuts = np.searchsorted(starts, np.arange(starts[0], starts[-1] + 1, block))
    cuts = np.unique(np.append(cuts, len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lens = ends[a:b] - starts[a:b]
        at = np.cumsum(lens) - lens
        rel = np.arange(int(lens.sum())) - np.repeat(at, lens)
        v = values[data[rel + np.repeat(starts[a:b], lens)]]
        v *= _POW[rel & (_PERIOD - 1)]
        out[a:b] = np.add.reduceat(v, at) + lens.astype(U64) * U64(0xE7037ED1A0B428DB)
    return mix(out)


class Lookup:
    """A growing map from 64-bit keys to int64, in sorted arrays of two sizes."""

    def __init__(self) -> None:
        self.levels = [(np.empty(0, U64), np.empty(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for have, vals in self.levels:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = vals[at[hit]]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """New keys only."""

        def merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([x[0], y[0]])
            order = np.argsort(k, kind="stable")
            return k[order], np.concatenate([x[1], y[1]])[order]

        big, small = self.levels[0], merged(self.levels[1], (keys, vals))
        if 4 * len(small[0]) > len(big[0]):
            big, small = merged(big, small), (np.empty(0, U64), np.empty(0, np.int64))
        self.levels = [big, small]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0], ..., starts[0] + lens[0] - 1, starts[1], ... in one array."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
