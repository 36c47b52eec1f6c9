"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Each task tokenises the rows it reads and packs them in groups of `group` consecutive documents, without a shuffle.
Full windows are cut from long documents first; what is left of each is cut into pieces of at most `piece` tokens.
With k windows, every piece starts as a partial partition of its own: k sums of which one isn't 0. The two partial
partitions with the greatest spread between their largest and smallest sum are merged again and again, the largest
sums of one onto the smallest of the other, so that opposing imbalances cancel, until one partition into k
near-equal windows is left. k starts at the least that can hold the tokens and rises whenever a window exceeds its
capacity. Windows that don't fill their length are padded, up to a group's last.

A null text is empty; an empty document is its end token alone. Repeated rows are packed each for itself. Sequence
ids are the reading task's number and a running number in it, so they are unique, not gapless; a task that runs again
makes the same rows. A document of any length costs its tokens in memory, once.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship
from .textcodes import Texts, codes_of_stretches, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
_MOST_KNOWN = 1_000_000
_kept: dict[str, TokenIds] = {}
#: Kinds of bytes: between stretches, of letters (ASCII and Latin ones up to U+024F), digits, apostrophe, other ASCII, of other characters.
_SPACE, _LETTER, _DIGIT, _QUOTE, _OTHER, _BEYOND = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[48:58], _KIND[39], _KIND[128:] = _SPACE, _DIGIT, _QUOTE, _BEYOND
_KIND[65:91] = _KIND[97:123] = _LETTER
#: _SPLIT[8 * a + b]: no token of the tokenizer's pattern reaches from a byte of kind a into the next of kind b.
_SPLIT = np.ones((8, 8), bool)
for _a, _b in ((_LETTER, _LETTER), (_QUOTE, _LETTER), (_QUOTE, _QUOTE), (_QUOTE, _OTHER), (_OTHER, _QUOTE), (_OTHER, _OTHER)):
    _SPLIT[_a, _b] = False
_SPLIT[_BEYOND, 1:] = _SPLIT[1:, _BEYOND] = False
_SPLIT = _SPLIT.ravel()


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # of two bytes, U+00C0 to U+027F
    point = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
    lead = lead[(point < 0x250) & (point != 0xD7) & (point != 0xF7) & (point != 0x130)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenIds:
    """Token ids of texts, equal to the tokenizer's own.

    A slice's bytes are cut, all texts at once, where no token of the tokenizer's pattern can reach across: at white
    space and between Latin letters, digits and ASCII punctuation, never beside another character. Stretches that differ
    are told apart by 64-bit codes (A-Z as a-z); only codes that aren't known yet are turned into strings and reach the
    tokenizer: those of letters alone its model, many in one call, others the whole tokenizer. What is known stands
    in sorted arrays of at most about `most` entries; when they are full, entries that weren't used since they were last full go.
    Texts with special tokens of their own go through the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int = 1, most: int = _MOST_KNOWN):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = json.loads(Path(path).read_text())
        own |= {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}
        self.tokenizer, self.model, self.end, self.most = Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(own)), end_id, most
        self.letters = _byte_letters()
        del self.letters[32]
        ends = own["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(own["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for x, i in own["model"]["vocab"].items() if x.endswith(ends)]] = True
        self.codes, self.at, self.many, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of letters alone, one after another, and how many each has."""
        text = b" ".join(words).decode().lower().encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        assert len(last) == len(words)
        return ids, np.diff(last, prepend=0)

    def _learn(self, codes: np.ndarray, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw, beyond = data.tobytes(), np.concatenate([[0], np.cumsum(kind == _BEYOND)])
        plain = (kind[start] == _LETTER) & (beyond[start] == beyond[end])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        codes, begin, stop = codes[order], start[order].tolist(), end[order].tolist()
        words, n, ids, many = [raw[a:b] for a, b in zip(begin, stop, strict=True)], int(plain.sum()), [], []
        for lo in range(0, n, 5000):
            got = self._of_letters(words[lo : min(lo + 5000, n)])
            ids.append(got[0])
            many.append(got[1])
        rest = self._whole([w.decode() for w in words[n:]])
        ids, many = np.concatenate([*ids, *rest, np.zeros(0, np.uint32)]), np.concatenate([*many, np.array([len(x) for x in rest], np.int64)])
        if len(self.codes) + len(codes) > self.most and len(self.codes):
            keep = np.flatnonzero(self.used)
            self.codes, self.many, at = self.codes[keep], self.many[keep], self.at[keep]
            self.ids = self.ids[_ranges(at, self.many)]
            self.at, self.used = np.cumsum(self.many) - self.many, np.zeros(len(keep), bool)
        at = len(self.ids) + np.cumsum(many) - many
        self.ids = np.concatenate([self.ids, ids])
        codes, at, many = np.concatenate([self.codes, codes]), np.concatenate([self.at, at]), np.concatenate([self.many, many])
        order = np.argsort(codes, kind="stable")
        self.codes, self.at, self.many, self.used = codes[order], at[order], many[order], np.append(self.used, np.ones(len(codes) - len(self.used), bool))[order]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts, an end id behind each, and the bounds of the texts in them."""
        data, offsets = texts.data, texts.offsets
        n = len(offsets) - 1
        kind = _kinds(data)
        begins = np.ones(len(data), bool)
        np.take(_SPLIT, kind[:-1] * np.uint8(8) + kind[1:], out=begins[1:])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        inked = kind[start] != _SPACE
        start, end = start[inked], end[inked]
        index, distinct = pd.factorize(codes_of_stretches(data, start, end), sort=True)
        at = np.searchsorted(self.codes, distinct)
        fresh = at == len(self.codes)
        fresh[~fresh] = self.codes[at[~fresh]] != distinct[~fresh]
        self.used[at[~fresh]] = True  # what this slice uses isn't dropped while it learns
        if fresh.any():
            first = np.empty(len(distinct), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            new = first[fresh]
            self._learn(distinct[fresh], data, kind, start[new], end[new])
            at = np.searchsorted(self.codes, distinct)
            self.used[at] = True
        many = self.many[at][index]
        ids = self.ids[_ranges(self.at[at][index], many)]
        before = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, offsets)]
        bounds = before + np.arange(n + 1)
        out, is_end = np.full(len(ids) + n, self.end, np.uint32), np.zeros(len(ids) + n, bool)
        is_end[bounds[1:] - 1] = True
        out[~is_end] = ids
        raw = data.tobytes()
        if not any(x in raw for x in SPECIAL):
            return out, bounds
        parts = []
        for i in range(n):
            text = raw[offsets[i] : offsets[i + 1]]
            special = any(x in text for x in SPECIAL)
            parts.append(np.append(self._whole([text.decode()])[0], np.uint32(self.end)) if special else out[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, `many` of them, one range after another."""
    return np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)


def token_ids(path: str) -> TokenIds:
    """One for each Python worker: workers are used again, and what they know stays."""
    if path not in _kept:
        _kept[path] = TokenIds(path)
    return _kept[path]


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window, of k near-equal ones, of each piece.

    A partial partition of one piece is kept as its length; others have k ascending sums. Merging one piece puts it onto the smallest sum.
    """
    sums: list = lengths.tolist()
    heap = [(-x, i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int | np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        if not isinstance(sums[b], int) and isinstance(sums[a], int):
            a, b = b, a
        if isinstance(sums[b], int):
            total = sums[a]
            if isinstance(total, int):
                total = np.zeros(k, np.int64)
                total[-1] = sums[a]
            x = int(total[0]) + sums[b]
            to = int(total.searchsorted(x, "right")) - 1
            total[:to] = total[1 : to + 1]
            total[to] = x
            merges.append((a, b, to))
        else:
            total = sums[a] + sums[b][::-1]  # ascending sums onto descending ones
            order = total.argsort(kind="stable")
            total = total[order]
            merges.append((a, b, order))
        sums[a] = total
        heapq.heappush(heap, (int(total[0] - total[-1]), a))
    # the window of each place of a partial partition (of a piece: its own alone), from the last merge back
    of: dict = {heap[0][1]: np.arange(k)} if heap else {}
    for a, b, order in reversed(merges):
        top = of[a]
        if isinstance(order, int):
            own = top[order]
            top[1 : order + 1] = top[:order]
            top[0] = own
            of[b] = own
        else:
            back = np.empty(k, np.int64)
            back[order] = top
            of[a], of[b] = back, back[::-1].copy()
    return np.array([x if np.isscalar(x) else x[-1] for x in (of[i] for i in range(len(lengths)))], np.int64)


def pack_group(totals: list[int], window: int, piece: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that hold each token of documents of these lengths once."""
    out, pieces = [], []
    for d, n in enumerate(totals):
        full = n // window * window
        out += [[(d, at, window)] for at in range(0, full, window)]
        parts = -(-(n - full) // piece)
        cuts = np.linspace(full, n, parts + 1).astype(int).tolist() if parts else []
        pieces += [(d, a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    lengths = np.array([x[2] for x in pieces], np.int64)
    k = -(-int(lengths.sum()) // window)
    while pieces:
        of = differencing(lengths, k)
        if np.bincount(of, lengths, k).max() <= window:
            held: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
            for x, j in zip(pieces, of.tolist(), strict=True):
                held[j].append(x)
            return out + [h for h in held if h]
        k += 1
    return out


def packer(tokenizer_path: str, window: int, group: int, piece: int, id_at: int, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer_path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush(docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for held in pack_group([len(ids) for _, ids in docs], window, piece):
                at = 0
                for d, start, n in held:
                    doc_id, ids = docs[d]
                    rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n]), len(ids), number, at))
                    at += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        waiting: list[tuple[int | None, np.ndarray]] = []
        for batch in batches:
            own = batch.column(id_at).cast(pa.int64()).to_pylist()
            for part in slices(batch.column(text_at), 1 << 21):
                ids, bounds = encoder.encode(part)
                waiting += [(own[part.lo + i], ids[bounds[i] : bounds[i + 1]]) for i in range(part.hi - part.lo)]
                while len(waiting) >= group:
                    yield flush(waiting[:group])
                    waiting = waiting[group:]
        if waiting:
            yield flush(waiting)

    return pack


def pack(documents: DataFrame, tokenizer_path: str, window: int = 2048, group: int = 512, piece: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there, and its sequence and offset in that."""
    ship(documents.sparkSession)
    return documents.select(documents[id_col], documents[text_col]).mapInArrow(packer(tokenizer_path, window, group, piece, 0, 1), SCHEMA)
