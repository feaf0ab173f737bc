"""Exact token counts of every prefix by dynamic programming.

For byte-pair pieces the last token of a prefix's encoding is the one token that ends there, whose remainder is a
shorter prefix, and that the merges would not have joined or cut differently beside that prefix's own last token. So
walking a piece once gives, for each prefix, its last token and its count: one more than the count of the prefix
before that token. Whether two tokens can stand side by side is decided by merging their bytes, and remembered.

Texts are cut where the pre-tokeniser always cuts (tokens.unit_starts); each distinct unit's table is made once a
worker. A text's table is its units' tables on top of each other's totals: counts at all its prefixes, from which
truncation (longest prefix within a budget) and budget questions are answered without encoding again.

The work is linear in a text's length: a step looks back no further than the longest token with its last two bytes,
and a run of white space is walked once for all its prefixes. Long pieces are kept within a budget of counts.

Defined results: null is empty text with 0 tokens; prefixes end at code points; a special string in a text is its one
token, and the ordinary tokens of what is there while it is incomplete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .kernels import Lookup, byte_class, byte_values, fingerprints, pieces, ragged, utf8
from .tokens import NEWER, unit_starts, vocab_path

_ALL = byte_values(byte_class((0, 255)), False)


def _blank(piece: str) -> bool:
    """White space alone, as the pre-tokeniser sees it: Python also counts four control characters."""
    return piece.isspace() and not any("\x1c" <= c <= "\x1f" for c in piece)


def _alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for one byte-level tokenizers file; keeps up to `keep` units, and `room` counts of units and of pieces."""

    def __init__(self, path: str, keep: int = 1_500_000, room: int = 1 << 24) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        self.id_of = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.name_of = {i: t for t, i in spec["model"]["vocab"].items()}
        self.char = {b: c for c, b in byte.items()}
        self.reach: dict[bytes, int] = {}  # last two bytes -> the longest token that ends in them
        for t in self.id_of:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 1), len(t))
        self.added = [t["content"] for t in spec["added_tokens"]]
        tok = Tokenizer.from_file(path)
        self.cutter, self.model = tok.pre_tokenizer, tok.model
        self.keep, self.room, self.beside, self.pieces = keep, room, {}, {}
        self._reset()

    def _reset(self) -> None:
        self.pieces.clear()
        self.held = 0  # counts in pieces
        self.units, self.n, self.filled = Lookup(), 0, 0
        self.at, self.lens, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32)

    def merge(self, name: str) -> list[int]:
        """The ids that the merges make of a piece in the byte-level alphabet."""
        return [t.id for t in self.model.tokenize(name)]

    def _stand(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b, side by side, as they are."""
        key = a << 32 | b
        if key not in self.beside:
            if len(self.beside) > 4_000_000:
                self.beside.clear()
            self.beside[key] = self.merge(self.name_of[a] + self.name_of[b]) == [a, b]
        return self.beside[key]

    def piece(self, raw: bytes) -> list[int]:
        """Counts at the piece's byte prefixes 0, 1, ..., len(raw)."""
        if raw in self.pieces:
            return self.pieces[raw]
        last, count = [-1], [0]
        id_of, reach = self.id_of, self.reach
        for i in range(1, len(raw) + 1):
            far = reach.get(raw[max(0, i - 2) : i], 1)
            for j in range(max(0, i - far), i):  # longest token first
                t = id_of.get(raw[j:i])
                if t is not None and last[j] != -2 and (self._alone(t) if j == 0 else self._stand(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:  # no token ends here that way: not so for byte-level vocabularies
                last.append(-2)
                count.append(len(self.merge("".join(self.char[c] for c in raw[:i]))))
        if len(raw) < self.room // 16:
            if self.held > self.room:
                self.pieces.clear()
                self.held = 0
            self.pieces[raw] = count
            self.held += len(count) + 16
        return count

    def _alone(self, t: int) -> bool:
        key = -1 - t
        if key not in self.beside:
            self.beside[key] = self.merge(self.name_of[t]) == [t]
        return self.beside[key]

    def _ordinary(self, text: str) -> list[int]:
        """Counts at the code point prefixes 1, 2, ..., of text without special strings."""
        if text[text[:1] == " " :].isalpha() and max(text) < NEWER:  # one piece
            at = self.piece(text.encode())
            return at[1:] if text.isascii() else [at[len(text[:k].encode())] for k in range(1, len(text) + 1)]
        out: list[int] = []
        base, k = 0, 0
        parts = [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        while k < len(parts):
            run = k
            while run < len(parts) and _blank(parts[run]):
                run += 1
            if run > k:  # a prefix that ends in white space has all of it, a next word's blank too, as one piece
                lead = " " if run < len(parts) and parts[run][0] == " " else ""
                own = "".join(parts[k:run])
                at, b = self.piece((own + lead).encode()), 0
                for c in own + lead:
                    b += len(c.encode())
                    out.append(base + at[b])
                base += sum(self.piece(p.encode())[-1] for p in parts[k:run])
            if run == len(parts):
                break
            piece, start = parts[run], int(run > k and parts[run][0] == " ")
            at, b = self.piece(piece.encode()), start
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # a contraction is one piece only when complete
                sign = self.piece(b"'")[-1]
                out.append(base + sign)
                out += [base + sign + self.piece(piece[1:i].encode())[-1] for i in range(2, len(piece))]
                out.append(base + at[-1])
            else:
                for c in piece[start:]:
                    b += len(c.encode())
                    out.append(base + at[b])
            base, k = base + at[-1], run + 1
        return out

    def table(self, text: str) -> list[int]:
        """Counts at the code point prefixes 1, 2, ..., len(text)."""
        out: list[int] = []
        base = start = 0
        while True:
            found = min(((at, a) for a in self.added if (at := text.find(a, start)) >= 0), default=None)
            if found is None:
                return out + [base + c for c in self._ordinary(text[start:])] if start < len(text) else out
            at, special = found
            head = self._ordinary(text[start : at + len(special)])  # what is there while the special string is incomplete
            out += [base + c for c in head[:-1]]
            base += (head[at - start - 1] if at > start else 0) + 1
            out.append(base)
            start = at + len(special)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units' tables: for each unit its place and length in `pool`; and each document's first unit (n + 1)."""
        if self.n > self.keep or self.filled > self.room:
            self._reset()
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        starts = unit_starts(data, offsets, [a.encode() for a in self.added])
        ends = np.append(starts[1:], len(data))
        code, distinct = pd.factorize(fingerprints(data, starts, ends, _ALL))
        place = self.units.get(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            made = [self.table(raw[a:b].decode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            lens = np.fromiter(map(len, made), np.int64, len(made))
            total = int(lens.sum())
            while self.filled + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.filled : self.filled + total] = np.fromiter((c for m in made for c in m), np.int32, total)
            self.at = np.concatenate([self.at, self.filled + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            place[new] = self.n + np.arange(len(new))
            self.units.put(distinct[new], place[new])
            self.filled, self.n = self.filled + total, self.n + len(new)
        place = place[code]
        return self.at[place], self.lens[place], np.searchsorted(starts, offsets)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts at all code point prefixes 0, 1, ..., len(text)."""
        at, lens, _ = self.counts(*utf8(pa.array([text])))
        base = np.cumsum(np.append(0, self.pool[at + lens - 1]))[:-1] if len(at) else np.empty(0, np.int64)
        return np.append(0, self.pool[ragged(at, lens)] + np.repeat(base, lens))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, budget: int = 1024, vocab: str | None = None, text: str = "text", key: str = "doc_id", tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and fit_chars: the most code points whose tokens are within budget, and
    from which on no longer prefix is shorter than the budget again within the unit that crosses it.

    tables adds prefix_deltas: per code point, the count's change from the prefix before (one signed byte or two).
    """
    path = vocab or vocab_path()
    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, fit_chars long" + ", prefix_deltas array<short>" * tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in pieces(batches, "text"):
            data, offsets = utf8(b.column(1))
            at, lens, first = c.counts(data, offsets)
            totals = np.concatenate([[0], np.cumsum(c.pool[at + lens - 1], dtype=np.int64)])
            chars = np.concatenate([[0], np.cumsum(lens)])
            n, size = totals[first[1:]] - totals[first[:-1]], chars[first[1:]] - chars[first[:-1]]
            fit = size.copy()
            for d in np.flatnonzero(n > budget).tolist():  # the unit that crosses the budget, then its table
                u = int(np.searchsorted(totals, totals[first[d]] + budget, "right")) - 1
                own = c.pool[at[u] : at[u] + lens[u]] + totals[u] - totals[first[d]]
                fit[d] = chars[u] - chars[first[d]] + (np.flatnonzero(own <= budget)[-1] + 1 if (own <= budget).any() else 0)
            cols = [b.column(0), pa.array(np.diff(offsets)), pa.array(size), pa.array(n), pa.array(fit)]
            if tables:
                all_ = c.pool[ragged(at, lens)] + np.repeat(totals[:-1], lens)
                delta = np.diff(all_, prepend=0).astype(np.int16)
                cols.append(pa.ListArray.from_arrays(pa.array(chars[first].astype(np.int32)), pa.array(delta)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_chars", "n_tokens", "fit_chars"] + ["prefix_deltas"] * tables)

    return id_text(docs, text, key).mapInArrow(run, schema)


def count_at(table: DataFrame, chars: int) -> DataFrame:
    """From token_counts(tables=True): the tokens of each text's first `chars` code points."""
    return table.withColumn("tokens_at", F.aggregate(F.slice("prefix_deltas", 1, max(1, chars)), F.lit(0).cast("long"), lambda a, x: a + x) if chars else F.lit(0).cast("long"))
