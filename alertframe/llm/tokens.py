"""Token ids of whole texts, by the tokenizers library, with each distinct unit of text encoded once a worker.

A unit is a stretch of text between places where the byte-level pre-tokeniser always cuts: before a lone space
between two non-spaces, between ASCII letters, digits and other signs (but not after an apostrophe), and around a
lone line break. A text's ids are its units' ids in order; tests hold this against the library on whole texts. Units
are found, fingerprinted and looked up by numpy; new ones go to the library's own pre-tokeniser and model.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .kernels import Lookup, byte_class, byte_values, fingerprints, ragged

VOCAB = "byte_bpe_50k.json"
_SPACE = byte_class((9, 13), (28, 32))
_LETTER = byte_class((65, 90), (97, 122))
_ALL = byte_values(byte_class((0, 255)), False)
#: 1 letter, 2 digit, 3 other sign, all of them ASCII; 4 white space but for the space; 0 anything else.
_KIND = np.zeros(256, np.int8)
_KIND[:28] = _KIND[33:128] = 3
_KIND[_LETTER], _KIND[48:58], _KIND[9:14] = 1, 2, 4
#: Letters from here on may be newer than the library's tables; they take the long way.
NEWER = "\u0530"
#: The byte-level alphabet: printable Latin-1 signs stand for their own byte, 256 and on for the other bytes in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_OWN)))}
#: Lead bytes of the other white space characters, and those characters.
_WIDE_LEADS = byte_class((0xC2, 0xC2), (0xE1, 0xE3))
_WIDE = [c.encode() for c in "\u0085                 　"]


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Where units start; never inside one of the strings in whole."""
    n = len(data)
    space, kind = _SPACE[data], _KIND[data]
    lead = np.flatnonzero(_WIDE_LEADS[data])
    if len(lead):
        near = np.stack([data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]], axis=1)
        for w in _WIDE:
            hit = lead[(near[:, : len(w)] == np.frombuffer(w, np.uint8)).all(axis=1)]
            for k in range(len(w)):
                space[np.minimum(hit + k, n - 1)] = True
    edges = np.unique(offsets[offsets < n])
    start = np.zeros(n, bool)
    word = ~space
    lone = data == 32
    lone[-1:] = False
    lone[:-1] &= word[1:]
    lone[edges[edges > 0] - 1] = False  # a document's last character
    before, now = kind[:-1], kind[1:]
    start[1:] = word[:-1] & (lone[1:] | (now == 4))
    start[1:] |= (before != now) & (before % 4 > 0) & (now % 4 > 0) & (data[:-1] != 39)
    broken = (before == 4) & word[1:]
    broken[1:] &= word[:-2]
    broken[:1] = False
    broken[edges[(edges > 0) & (edges < n - 1)]] = False  # the break opens its document
    start[1:] |= broken
    raw = data.tobytes() if whole else b""
    for w in whole:
        at = raw.find(w)
        while at >= 0:
            start[at + 1 : at + len(w)] = False
            at = raw.find(w, at + len(w))
    start[edges] = True
    return np.flatnonzero(start)


class Encoder:
    """encode() for one tokenizers file; keeps what it has encoded, up to `keep` units."""

    def __init__(self, path: str, keep: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        self.model, self.cutter = self.tok.model, self.tok.pre_tokenizer
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.units = Lookup()
        self.at, self.lens, self.pool, self.filled, self.n = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(1 << 16, np.uint32), 0, 0

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _unit(self, raw: bytes) -> list[int]:
        text = raw.decode()
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and (word.isascii() or max(word) < NEWER):  # one piece for the model
            return self._model(raw.decode("latin-1").translate(_BYTE_CHAR))
        if any(a in text for a in self.added):
            return self.tok.encode(text, add_special_tokens=False).ids
        return [i for piece, _ in self.cutter.pre_tokenize_str(text) for i in self._model(piece)]

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each unit its place among the kept units."""
        if self.n > self.keep:
            self._reset()
        code, distinct = pd.factorize(fingerprints(data, starts, ends, _ALL))
        place = self.units.get(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            s, e = starts[first[new]], ends[first[new]]
            raw = data.tobytes()
            found = [self._unit(raw[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum()))
            while self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.at = np.concatenate([self.at, self.filled + np.cumsum(counts) - counts])
            self.lens = np.concatenate([self.lens, counts.astype(np.int32)])
            place[new] = self.n + np.arange(len(new))
            self.units.put(distinct[new], place[new])
            self.filled, self.n = self.filled + len(ids), self.n + len(new)
        return place[code]

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = unit_starts(data, offsets, [a.encode() for a in self.added])
        return starts, self._codes(data, starts, np.append(starts[1:], len(data)))

    def frequencies(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How often each id occurs in all documents together."""
        if not len(data):
            return np.zeros(self.size, np.int64)
        times = np.bincount(self._places(data, offsets)[1], minlength=self.n)
        used = np.flatnonzero(times)
        lens = self.lens[used].astype(np.int64)
        return np.bincount(self.pool[ragged(self.at[used], lens)], np.repeat(times[used], lens), self.size).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids in one array, and n + 1 offsets into it."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, place = self._places(data, offsets)
        lens = self.lens[place].astype(np.int64)
        ids = self.pool[ragged(self.at[place], lens)]
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's Encoder for the file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
