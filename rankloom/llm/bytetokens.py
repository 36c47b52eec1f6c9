"""Token ids of a byte-level vocabulary, for many texts at once.

The pattern of byte-level tokenizers never joins a character that isn't white space with white space behind it, so a text may be cut at
each such place, and the ids of its stretches, one after another, are those of the whole text; special tokens hold no white space
and are never cut. All stretches of a slice of texts are told apart by 64-bit codes at once, and only those whose code isn't known yet reach
the tokenizer. What is known stands in sorted arrays of about `most` entries at most; when they are full, entries unused since they
were last full go. Cuts are made before ASCII white space only, behind characters that surely aren't white space.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .textcodes import Texts, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_rng = np.random.Generator(np.random.PCG64(912))
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E6C63D0876A9A35
_CHUNK = 1 << 20
_kept: dict[str, ByteIds] = {}


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


_UP, _DOWN = _powers(_STEP, 2 * _CHUNK + 1), _powers(pow(_STEP, -1, 2**64), 2 * _CHUNK + 1)


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text of these bytes may be cut before each byte."""
    solid = _PLAIN[data]  # the last byte of a character that isn't white space
    inner = (data & 0xC0) == 0x80
    lead = np.zeros(len(data), np.uint8)
    lead[1:] = data[:-1]
    solid |= inner & (lead >= 0xC3) & (lead <= 0xDF)
    lead[2:], lead[:2] = data[:-2], 0
    solid[1:] |= (inner[1:] & inner[:-1]) & (lead[1:] >= 0xE4) & (lead[1:] <= 0xEF)
    lead[3:], lead[:3] = data[:-3], 0
    solid |= inner & (lead >= 0xF0)
    out = np.zeros(len(data), bool)
    out[1:] = _SPACE[data[1:]] & solid[:-1]
    return out


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)


class ByteIds:
    """Token ids of texts, equal to the tokenizer's own."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.codes, self.at, self.many, self.used, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)

    def _learn(self, codes: np.ndarray, stretches: list[str]) -> None:
        new = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        if len(self.codes) + len(codes) > self.most and len(self.codes):
            keep = np.flatnonzero(self.used)
            at = self.at[keep]
            self.codes, self.many = self.codes[keep], self.many[keep]
            self.ids, self.at, self.used = self.ids[_ranges(at, self.many)], np.cumsum(self.many) - self.many, np.zeros(len(keep), bool)
        many = np.array([len(x) for x in new], np.int64)
        at = len(self.ids) + np.cumsum(many) - many
        self.ids = np.concatenate([self.ids, *new])
        place = np.searchsorted(self.codes, codes)
        self.codes, self.at, self.many, self.used = np.insert(self.codes, place, codes), np.insert(self.at, place, at), np.insert(self.many, place, many), np.insert(self.used, place, True)

    def _stretches(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where stretches start, their ids, and how many each has."""
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        m = len(data)
        up, down = (_UP, _DOWN) if m < len(_UP) else (_powers(_STEP, m + 1), _powers(pow(_STEP, -1, 2**64), m + 1))
        running = np.zeros(m + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[:m], out=running[1:])
        codes = mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))
        index, distinct = pd.factorize(codes, sort=True)
        at = np.searchsorted(self.codes, distinct)
        fresh = at == len(self.codes)
        fresh[~fresh] = self.codes[at[~fresh]] != distinct[~fresh]
        self.used[at[~fresh]] = True  # what this slice uses isn't dropped while it learns
        if fresh.any():
            first = np.empty(len(distinct), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            raw, new = data.tobytes(), first[fresh]
            self._learn(distinct[fresh], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            at = np.searchsorted(self.codes, distinct)
            self.used[at] = True
        many = self.many[at][index]
        return start, self.ids[_ranges(self.at[at][index], many)], many

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts and the bounds of the texts in them."""
        data, offsets = texts.data, texts.offsets
        begins = cuts(data)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        lo, starts, ids, many = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        while lo < len(data):  # a long text in chunks
            hi = len(data)
            if hi - lo > 2 * _CHUNK:
                later = np.flatnonzero(begins[lo + _CHUNK : lo + 2 * _CHUNK])
                if not len(later):
                    later = np.flatnonzero(begins[lo + _CHUNK :])
                hi = lo + _CHUNK + int(later[0]) if len(later) else hi
            got = self._stretches(data[lo:hi], begins[lo:hi])
            starts.append(got[0] + lo)
            ids.append(got[1])
            many.append(got[2])
            lo = hi
        before = np.concatenate([[0], np.cumsum(np.concatenate(many))])
        return np.concatenate(ids), before[np.searchsorted(np.concatenate(starts), offsets)]


def byte_ids(path: str) -> ByteIds:
    """One for each Python worker: workers are used again, and what they know stays."""
    if path not in _kept:
        _kept[path] = ByteIds(path)
    return _kept[path]


def encoded(texts: Iterator[Texts], path: str, end_id: int) -> Iterator[np.ndarray]:
    """Each text's ids, with the end id."""
    encoder = byte_ids(path)
    for part in texts:
        ids, bounds = encoder.encode(part)
        for i in range(part.hi - part.lo):
            yield np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
