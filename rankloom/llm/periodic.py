"""Periodic runs of words within texts, by uniting suffix classes in descending order of their common prefixes.

A run is a maximal stretch of words that repeats itself with its smallest period at least `exponent` times. Each text is worked on where it
is read, without a shuffle, so copies and hot sources don't meet anywhere.

1. Two words a period apart start equal stretches, so only words whose next `least` words stand somewhere else in the
   same text too can start a run. A slice of texts is searched for such words at once, by running sums of 64-bit codes; texts
   without any have no runs. The codes only choose where to look: what follows compares words themselves.
2. For the others a suffix array is built by prefix doubling, whose ranks also give the common prefixes of neighbours.
3. Neighbours are united as Kruskal's algorithm would, by descending common prefix. A class is an ordered set of positions, the smaller set
   is merged into the larger one, and positions that become adjacent at a distance d within the common prefix l are a seed: the
   stretch of l + d words from the first on has the smallest period d, for a smaller one would have put a position
   between them earlier. It can't be extended to the right; if the word before doesn't fit it is a run.

A null text has no words, nor has an empty one; both have no runs and an empty collapsed text. Rows are taken each for itself, whatever
their ids, and other columns are left out. A text of any length costs its words in memory, times the binary logarithm of its longest
repeat if it repeats anything.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textcodes import mix, slices

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(77))
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _WORD_STEP, _TEXT = 0xB2E7D1A45C0F3395, 0xC6A4A7935BD1E995, np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


_UP, _DOWN = _powers(_STEP, _CHUNK + 1), _powers(pow(_STEP, -1, 2**64), _CHUNK + 1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and code of each word of a slice of texts, in chunks of bytes, so that a long text costs its words and not its bytes."""
    starts, ends, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    n, lo, parts = len(data), 0, np.unique(offsets)
    space = _IS_SPACE[data]
    while lo < n:
        hi = min(n, lo + _CHUNK)
        if hi < n:  # not within a word, if a word is shorter than a chunk
            back = np.flatnonzero(space[lo:hi][::-1])
            edge = parts[np.searchsorted(parts, hi, "right") - 1]
            hi = max(hi - int(back[0]) if len(back) else lo, int(edge))
            if hi <= lo:
                after = np.flatnonzero(space[lo:])
                hi = min(lo + int(after[0]) if len(after) else n, int(parts[np.searchsorted(parts, lo, "right")]))
        inside = ~space[lo:hi]
        edges = parts[np.searchsorted(parts, lo, "right") : np.searchsorted(parts, hi)] - lo
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        m = hi - lo
        up, down = (_UP, _DOWN) if m <= _CHUNK else (_powers(_STEP, m + 1), _powers(pow(_STEP, -1, 2**64), m + 1))
        running = np.zeros(m + 1, np.uint64)
        np.cumsum(_LETTER[data[lo:hi]] * up[:m], out=running[1:])
        codes.append(mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64)))
        starts.append(start + lo)
        ends.append(end + lo)
        lo = hi
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(codes)


def repeated(codes: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """The words whose next `least` words stand somewhere else in the same text too (or seem to, by their codes)."""
    n, many = len(codes), np.diff(bounds)
    if n < least:
        return np.zeros(0, np.int64)
    up, down = _powers(_WORD_STEP, n), _powers(pow(_WORD_STEP, -1, 2**64), n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up, out=running[1:])
    key = mix((running[least:] - running[:-least]) * down[: n - least + 1])
    text = np.repeat(np.arange(len(many)), many)
    at = np.flatnonzero(text[: n - least + 1] == text[least - 1 :])
    key = mix(key[at] + text[at].astype(np.uint64) * _TEXT)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    return at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a text's word ids, and the common prefix of each suffix with the one before it (the first: 0)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    ranks, width = [rank], 1
    while rank.max(initial=0) < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int32)
        new[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        rank, width = new, 2 * width
        ranks.append(rank)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b, common = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        live = live[ranks[k][a[live]] == ranks[k][b[live]]]
        a[live] += 1 << k
        b[live] += 1 << k
    common[1:] = a - sa[:-1]
    return sa, common


def runs_of(ids: np.ndarray, shortest: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's word ids of length >= max(shortest, exponent * period), by start and period."""
    least = least_prefix(shortest, exponent)
    sa, common = suffixes(ids)
    at = np.flatnonzero(common >= least)
    at = at[np.argsort(-common[at], kind="stable")]
    home: dict[int, list[int]] = {}
    seeds = []
    for x, y, l in zip(sa[at - 1].tolist(), sa[at].tolist(), common[at].tolist(), strict=True):  # noqa: E741
        small, large = home.get(x) or [x], home.get(y) or [y]
        if len(small) > len(large):
            small, large = large, small
        if len(large) == 1:
            home[large[0]] = large
        for p in small:
            insort(large, p)
        for p in small:
            i = bisect_left(large, p)
            for q in large[max(i - 1, 0) : i] + large[i + 1 : i + 2]:
                d = abs(p - q)
                if d <= l and l + d >= max(shortest, exponent * d) and home.get(q) is large:
                    seeds.append((min(p, q), l + d, d))
        for p in small:
            home[p] = large
    return sorted((p, n, d) for p, n, d in seeds if not p or ids[p - 1] != ids[p + d - 1])


def least_prefix(shortest: int, exponent: int) -> int:
    """The least common prefix of two words a period apart at the start of a run: length less period, over all periods."""
    return min(max(shortest, exponent * q) - q for q in range(1, shortest + 1))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _finder(shortest: int, exponent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = least_prefix(shortest, exponent)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                data, offsets, n = part.data, part.offsets, part.hi - part.lo
                start, end, codes = words_of(data, offsets)
                bounds = np.searchsorted(start, offsets)
                texts_with = np.unique(np.searchsorted(bounds, repeated(codes, bounds, least), "right") - 1)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                # words as they are, one blank before each but a text's first
                keep = np.zeros(len(data), bool)
                inside = ~_IS_SPACE[data]
                keep[inside] = True
                lead = np.ones(len(start), bool)
                lead[bounds[:-1][bounds[:-1] < len(start)]] = False
                blank = start[lead] - 1
                keep[blank] = True
                plain = data.copy()
                plain[blank] = 32
                kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
                plain = plain[keep].tobytes()
                pieces, done = [], 0
                sizes = np.diff(kept)
                for i in texts_with.tolist():
                    lo, hi = bounds[i], bounds[i + 1]
                    own = plain[kept[i] : kept[i + 1]].split(b" ")
                    known: dict[bytes, int] = {}
                    ids = np.array([known.setdefault(w, len(known)) for w in own], np.int64)
                    assert len(ids) == hi - lo
                    if runs := runs_of(ids, shortest, exponent):
                        found[i] = runs
                        new = b" ".join(_collapsed(own, runs))
                        pieces += [plain[done : kept[i]], new]
                        done, sizes[i] = kept[i + 1], len(new)
                pieces.append(plain[done:])
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUNS_TYPE.value_type)))
                bytes_of = pa.py_buffer(b"".join(pieces))
                texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), bytes_of)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, n), lists, texts.cast(pa.string())], names=["id", "runs", "collapsed"])

    return find


def find(documents: DataFrame, shortest: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) per row: its runs by start and period, and its words, without those that a run has after its first period, joined by one space."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(documents[id_col], documents[text_col]).mapInArrow(_finder(shortest, exponent), f"id {kind}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """Of an array of runs, that of the greatest length by period, exactly; of several, that of the smallest start, then period. An empty array has none."""
    first = F.lit(None).cast(RUNS[6:-1])
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.array_sort(runs), first, lambda a, b: F.when(a.isNull() | better(b, a), b).otherwise(a))


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text, or, of one document in ten by its id's checksum, its words with a tail made periodic; what the query's contract plants."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        head = F.slice(w, F.lit(1), a)
        return F.array_join(F.concat(head, F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))), " ")

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(""))[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), made).otherwise(text)
