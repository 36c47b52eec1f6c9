"""Ranks and correlations of weighted rows in numpy, for tasks that hold a whole key as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a key that a task takes as arrays: a GB with what is made of them, of which some 20 bytes a row stay. DRAW_ROWS: where they are 32-bit places among different values.
ARRAY_ROWS, DRAW_ROWS = 1 << 25, 1 << 25
_CHUNK = 1 << 20


def places(*columns: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Each column's values as places among the different ones of all columns together, and how many those are."""
    values = np.unique(columns[0]) if len(columns) == 1 else np.unique(np.concatenate([np.unique(c) for c in columns]))
    out = [np.empty(len(c), np.int32) for c in columns]
    for c, at in zip(columns, out, strict=True):
        for lo in range(0, len(c), _CHUNK):
            at[lo : lo + _CHUNK] = np.searchsorted(values, c[lo : lo + _CHUNK])
    return out, len(values)


def value_ranks(held: np.ndarray) -> np.ndarray:
    """Average rank of each different value, in order, where so many rows have it."""
    return np.cumsum(held) - held + (held + 1) / 2.0


def counted(at: np.ndarray, many: int, group: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """How many rows stand at each place; each counts as its group's weight."""
    out, step = np.zeros(many), max(_CHUNK, 2 * many)
    for lo in range(0, len(at), step):
        out += np.bincount(at[lo : lo + step], None if weight is None else weight[group[lo : lo + step]], many)
    return out


class Runs:
    """Rows in order of their places, in stretches that stay in the cache; sums of what is told of the rows, by place."""

    def __init__(self, at: np.ndarray, many: int, step: int = 1 << 16):
        self.many, self.stretches = many, []
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            self.stretches.append((lo, lo + len(part), first.astype(np.int32), part[first]))

    def sums(self, told: Callable[[int, int], tuple[np.ndarray, ...]], count: int = 1) -> np.ndarray:
        """told: `count` arrays of numbers of rows lo to hi."""
        out = np.zeros((count, self.many))
        for lo, hi, first, place in self.stretches:
            for to, x in zip(out, told(lo, hi), strict=True):
                to[place] += np.add.reduceat(x, first)
        return out


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_HASHED = 1 << 15


def md5_heads(messages: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of bytes, all of one length, as numbers; the same as the first 8 hex digits that Spark's md5 gives."""
    n, size = messages.shape
    blocks = (size + 8) // 64 + 1
    padded = np.zeros((n, 4 * (size // 4 + 1)), np.uint8)
    padded[:, :size], padded[:, size] = messages, 0x80
    own = np.ascontiguousarray(padded.view("<u4").T)
    # words that are the same in all rows are numbers; those after the text are 0 but for its length
    words = [w if (w != w[:1]).any() else w[0] if n else np.uint32(0) for w in own] + [np.uint32(0)] * (16 * blocks - len(own))
    words[-2] = np.uint32(8 * size)
    state = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            a += f
            w = words[block + (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
            if isinstance(w, np.ndarray):
                a += w
                a += _SINES[i]
            else:
                a += np.uint32((int(w) + int(_SINES[i])) & 0xFFFFFFFF)
            np.left_shift(a, np.uint32(_TURNS[i]), out=t), np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state[0].byteswap()


def hashed_texts(prefix: str, texts: list[np.ndarray]) -> list[np.ndarray]:
    """md5_heads of prefix and each text; texts: for each of their lengths, rows of bytes."""
    out, head = [], np.frombuffer(prefix.encode(), np.uint8)
    for rows in texts:
        made = np.empty(len(rows), np.uint32)
        for lo in range(0, len(rows), _HASHED):
            part = rows[lo : lo + _HASHED]
            text = np.empty((len(part), len(head) + part.shape[1]), np.uint8)
            text[:, : len(head)], text[:, len(head) :] = head, part
            made[lo : lo + _HASHED] = md5_heads(text)
        out.append(made)
    return out


def digits(n: int) -> list[np.ndarray]:
    """The numbers below n as rows of decimal digits, by their lengths."""
    ends = [0, *[10**k for k in range(1, 19) if 10**k < n], n]
    return [np.arange(lo, hi).astype(f"S{len(str(hi - 1))}").view(np.uint8).reshape(hi - lo, -1) for lo, hi in zip(ends, ends[1:], strict=False) if hi > lo]


#: Values that are whole multiples of 1 / _UNITS go as such, in 32 bits.
_UNITS = 1e6


def _bytes(x: np.ndarray) -> bytes:
    """Doubles as 32-bit numbers of millionths where these give the same doubles again, else as they are; the last byte tells which."""
    if x.dtype != np.float64:
        return x.tobytes()
    with np.errstate(invalid="ignore", over="ignore"):
        units = np.rint(x * _UNITS)
        whole = bool((np.abs(units) < 1 << 31).all()) and bool((units / _UNITS == x).all())
    return units.astype(np.int32).tobytes() + b"i" if whole else x.tobytes() + b"d"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of numbers as bytes, a row for each value of the first column, the key, in a batch, so that a shuffle carries nothing but them."""
    for batch in batches:
        key = batch.column(0)
        for k in pc.unique(key):
            part = batch.filter(pc.equal(key, k) if k.is_valid else pc.is_null(key))
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], key.type), *[pa.array([_bytes(c.to_numpy())], pa.binary()) for c in part.columns[1:]]], names=batch.schema.names)


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of a packed column, written once into their place."""
    held = [memoryview(x.as_buffer()) for x in column]
    if kind is not np.float64:
        sizes = [len(b) // np.dtype(kind).itemsize for b in held]
    else:
        sizes = [(len(b) - 1) // (4 if b[-1] == ord("i") else 8) for b in held]
    out, lo = np.empty(sum(sizes), kind), 0
    for b, n in zip(held, sizes, strict=True):
        to = out[lo : lo + n]
        if kind is np.float64 and b[-1] == ord("i"):
            np.divide(np.frombuffer(b, np.int32, n), _UNITS, out=to)
        else:
            to[:] = np.frombuffer(b, kind, n)
        lo += n
    return out
