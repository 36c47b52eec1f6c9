"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

The alphabet is words (as 64-bit codes). Windows are sorted by length class; each class has m, its shortest
window's length. A block is two words (one where m is 1). The shift table, indexed by some bits of a block's hash,
says how far a search may jump when that block ends at the current word; blocks of no window allow m - 1 words.
Where the jump is 0, the block's full hash selects a bucket of windows with that suffix at word m, and comparing all
words of each with the text confirms an occurrence. Texts are cut into lanes of some hundred end positions, and
numpy moves all lanes of a slice on together, each by its own jumps.

The benchmark is a stated set of queries: slices of it of about `slice_bytes` are broadcast, one pass after
another over the documents, without a shuffle. A pass's result is checkpointed before the next slice is built, so a large benchmark
means more passes, not a larger broadcast: one slice's tables are held at a time, about 25 bytes for each byte of the slice.

Nulls and texts without words have no windows and no hits. Repeated items and repeated documents each count for
themselves (an item_id counts once). Windows of an item without an id are hit like others, only no item is listed for them.
A document without words is not contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship
from .textcodes import Texts, Words, mix, slices, words

WINDOW = 13
LANE = 384
#: A word's share of hits from which a document is contaminated: n_hit * SHARE >= n_words.
SHARE = 20
DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


class ShiftTables:
    """The tables of one length class. Window i is the words codes[start[i]] to codes[start[i] + lengths[i] - 1]."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, lengths: np.ndarray):
        self.codes, self.start, self.lengths = codes, start, lengths
        self.m = int(lengths.min())
        self.block = min(2, self.m)
        self.most = self.m - self.block + 1
        self.bits = max(12, int(np.ceil(np.log2(2 * len(start) * self.m))))
        self.shift = np.full(1 << self.bits, self.most, np.uint8)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._slot(self._ends_at(end)), np.uint8(self.m - 1 - end))
        suffix = self._ends_at(self.m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _ends_at(self, end: int) -> np.ndarray:
        """The block that ends at word `end` of each window."""
        return self._block(self.codes[self.start + end - 1] if self.block == 2 else None, self.codes[self.start + end])

    def _block(self, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        return mix(b) if a is None else _pair(a, b)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of all occurrences."""
        m = self.m
        begin, stop = w.bounds[:-1] + m - 1, w.bounds[1:]
        lanes = np.maximum(0, -(-(stop - begin) // LANE))
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[text] + nth * LANE
        end = np.minimum(at + LANE, stop[text])
        limit = stop[text]
        found_at, found = [], []
        while len(at):
            block = self._block(w.codes[at - 1] if self.block == 2 else None, w.codes[at])
            jump = self.shift[self._slot(block)].astype(np.int64)
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                lo = np.searchsorted(self.suffix, block[zero], "left")
                many = np.searchsorted(self.suffix, block[zero], "right") - lo
                if many.any():
                    pick = np.repeat(zero, many)
                    nth = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
                    window = self.order[np.repeat(lo, many) + nth]
                    first, length = at[pick] - m + 1, self.lengths[window]
                    same = first + length <= limit[pick]
                    for j in range(int(self.lengths.max())):
                        live = np.flatnonzero(same & (length > j))
                        if not len(live):
                            break
                        same[live] = w.codes[first[live] + j] == self.codes[self.start[window[live]] + j]
                    found_at.append(first[same])
                    found.append(window[same])
            at = at + np.maximum(jump, 1)
            live = at < end
            at, end, limit = at[live], end[live], limit[live]
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Windows:
    """All windows of a slice of the benchmark, by length class, with the items that have them (an item without an id: none)."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.ids = item_ids
        codes, start, lengths, owner, at = [], [], [], [], 0
        for part in slices(pa.array([x or "" for x in texts], pa.large_string())):
            w = words(part)
            count = np.diff(w.bounds)
            size = np.minimum(count, window)
            many = np.where(count > 0, count - size + 1, 0)
            first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.bounds[:-1], many)
            codes.append(w.codes)
            start.append(at + first)
            lengths.append(np.repeat(size, many))
            owner.append(part.lo + np.repeat(np.arange(part.hi - part.lo), many))
            at += len(w.codes)
        self.classes = []
        if not at:
            return
        codes, start, lengths, owner = (np.concatenate(x) for x in (codes, start, lengths, owner))
        named = np.array([x is not None for x in item_ids])
        for low, high in ((window, window), (2, window - 1), (1, 1)):
            mine = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(mine) and low <= high:
                s, n, o = start[mine], lengths[mine], owner[mine]
                both = [n.astype(np.uint64), n.astype(np.uint64) + np.uint64(7)]
                for j in range(high):
                    code = np.where(j < n, codes[np.minimum(s + j, len(codes) - 1)], np.uint64(0))
                    both = [mix(both[0] * np.uint64(0xD1342543DE82EF95) + code), mix(both[1] * np.uint64(0xC2B2AE3D27D4EB4F) + code)]
                order = np.lexsort((o, both[1], both[0]))
                new = np.ones(len(order), bool)
                new[1:] = (both[0][order][1:] != both[0][order][:-1]) | (both[1][order][1:] != both[1][order][:-1])
                stands, number = order[new], np.cumsum(new) - 1
                keep = named[o[order]]
                bounds = np.searchsorted(number[keep], np.arange(len(stands) + 1))
                self.classes.append((ShiftTables(codes, s[stands], n[stands]), bounds, o[order][keep]))

    def hits(self, w: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Which words are hit; pairs of a text and an item that has an occurring window."""
        change = np.zeros(len(w.codes) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for tables, bounds, owner in self.classes:
            first, window = tables.search(w)
            if not len(first):
                continue
            np.add.at(change, first, 1)
            np.add.at(change, first + tables.lengths[window], -1)
            text = np.searchsorted(w.bounds, first, "right") - 1
            pair = np.unique(np.column_stack([text, window]), axis=0)
            many = np.diff(bounds)[pair[:, 1]]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.column_stack([np.repeat(pair[:, 0], many), owner[np.repeat(bounds[pair[:, 1]], many) + nth]]))
        got = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(change)[:-1] > 0, [(i, self.ids[x]) for i, x in got.tolist()]


def _runs(hit: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each text, first and last-plus-one word of the runs of hit words, counted from the text's first word."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[int]] = [[] for _ in range(len(bounds) - 1)]
    for s, e in zip(start, end, strict=True):  # runs are few; a run may cross into the next text
        i = int(np.searchsorted(bounds, s, "right")) - 1
        while s < e:
            stop = min(e, bounds[i + 1])
            if s < stop:
                out[i] += [int(s - bounds[i]), int(stop - bounds[i])]
            s, i = max(s, stop), i + 1
    return out


def digest(n_words: int, n_hit: int, items: Iterable[str]) -> tuple:
    ids = sorted(set(items))
    return n_words, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n_words


def _judge(texts: Texts, windows: Windows, runs: list | None, items: list | None) -> list[tuple[list[int], list[str], int]]:
    """Runs of hit words, items and the number of words of each text, with what earlier passes found."""
    w = words(texts)
    hit, found = windows.hits(w)
    for i in range(texts.hi - texts.lo) if runs is not None else ():
        for s, e in zip(runs[texts.lo + i][::2], runs[texts.lo + i][1::2], strict=True):
            hit[w.bounds[i] + s : w.bounds[i] + e] = True
    mine: list[list[str]] = [list(items[texts.lo + i]) if items is not None else [] for i in range(texts.hi - texts.lo)]
    for i, x in found:
        mine[i].append(x)
    return list(zip(_runs(hit, w.bounds), mine, np.diff(w.bounds).tolist(), strict=True))


def parts_of(benchmark: DataFrame, slice_bytes: int, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """Items (i, t) of the benchmark in parts of about slice_bytes of text each."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).dropDuplicates()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // slice_bytes))
    return [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def judge(documents: DataFrame, benchmark: DataFrame, keep: bool = False, column: str = "overlap", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """documents with one struct column added (DIGEST), or, with keep, only the documents that are not contaminated.

    The added column takes the given name; a column of documents with that name gives way to it.
    """
    ship(documents.sparkSession)
    parts = parts_of(benchmark, slice_bytes)
    frame = documents if keep else documents.drop(column)
    own = frame.schema
    carried = T.StructType([T.StructField("__runs", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))])
    for k, items in enumerate(parts):
        last = k == len(parts) - 1
        added = (T.StructType([]) if keep else T.StructType([T.StructField(column, DIGEST)])) if last else carried
        rows = items.collect()  # about slice_bytes
        shared = documents.sparkSession.sparkContext.broadcast(Windows([r["i"] for r in rows], [r["t"] for r in rows]))

        def each(batches: Iterator[pa.RecordBatch], k=k, last=last, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                runs = batch.column(batch.num_columns - 2).to_pylist() if k else None
                items = batch.column(batch.num_columns - 1).to_pylist() if k else None
                found = [x for part in slices(batch.column(at)) for x in _judge(part, shared.value, runs, items)]
                columns, names = batch.columns[: len(own)], own.names
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.string()))], names=[*names, "__runs", "__items"])
                    continue
                rows = [digest(n, sum(runs[1::2]) - sum(runs[::2]), items) for runs, items, n in found]
                if keep:
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([not r[-1] for r in rows], pa.bool_()))
                else:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                    struct = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], DIGEST.names)
                    yield pa.RecordBatch.from_arrays([*columns, struct], names=[*names, column])

        frame = frame.mapInArrow(each, T.StructType([*own.fields, *added.fields]))
        if not last:
            frame = cut(frame)
            shared.unpersist()
    return frame
