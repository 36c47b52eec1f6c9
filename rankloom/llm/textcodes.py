"""Words of many texts at once, as 64-bit codes in numpy arrays.

The functions work on slices of an Arrow string column: the UTF-8 bytes of all texts of a slice stand in one
buffer, and a word's code is a difference of running polynomial sums over that buffer, so no text is split in
Python. Two different words share a code with a probability of about 2**-64. A text with no words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 - 0x10  # 5 modulo 8: its powers repeat as late as they can
_BACK = pow(_STEP, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_TERM = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        x = np.full(max(n, 1 << 21), base, np.uint64)
        x[0] = 1
        _powers[name] = np.cumprod(x)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit codes over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Texts:
    """Rows lo to hi of a batch: row i's bytes are data[offsets[i]:offsets[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def pieces(self, most: int = 1 << 20) -> Iterator[Texts]:
        """The same texts, numbered from 0, in runs of at most about `most` bytes, one text at least."""
        lo, n = 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + most, "right")) - 1)
            yield Texts(lo, hi, self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo])
            lo = hi


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty) in runs of at most about `most` bytes, one text at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """codes of all words of a slice; text i has those from bounds[i] to bounds[i + 1]; start and end are byte positions."""

    codes: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    inside = _IS_WORD[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_TERM[data] * _power("step", _STEP, n), out=running[1:])
    codes = (running[end] - running[start]) * _power("back", _BACK, n)[start]
    return Words(mix(codes + (end - start).astype(np.uint64)), np.searchsorted(start, offsets), start, end)


def codes_of_stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of stretches of bytes, A-Z as a-z; equal stretches have equal codes."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TERM[data] * _power("step", _STEP, len(data)), out=running[1:])
    return mix((running[end] - running[start]) * _power("back", _BACK, len(data) + 1)[start] + (end - start).astype(np.uint64))


def runs_of_words(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of n consecutive words, and bounds by text; a text of fewer words, but not none, is one run."""
    count = np.diff(w.bounds)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(w.bounds[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    last = np.repeat(w.bounds[1:], many)
    total, at = np.zeros(bounds[-1], np.uint64), first.copy()
    padded = np.append(w.codes, np.uint64(0))
    for _ in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + np.where(at < last, padded[np.minimum(at, len(w.codes))], np.uint64(1))
        at += 1
    return mix(total), bounds
