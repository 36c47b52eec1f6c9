"""Suffix-array dedup: bytes of a document that a string of `length` bytes covers which also starts in an earlier one.

A suffix array of everything can't be built in one place, so equal strings are brought together first, in four stages.
Stage one cuts every text where its own bytes say so (about every CHUNK bytes); a chunk reaches `length` - 1 bytes into the
next, so each window of `length` bytes lies in the chunk that it starts in. A chunk that an earlier document has too is
dead: all its windows are covered, and nobody needs them as a source. Copies and most of near copies end here, for a hash and an id a
chunk. Chunk hashes are counted before they are shuffled; hashes that more than a thousandth of all chunks share are joined
by a broadcast of at most a thousand rows, so no hash is a task of its own.
Stage two: every other window names one anchor, the `gram`-byte string in it with the smallest hash (the last of several):
equal windows name equal anchors at equal offsets. Hashes of anchors travel packed by bucket, and those that one text alone has are dropped.
Stage three sends, for each anchor left and half of the offsets, the part common to all its windows (the core) as a hash,
and the bytes around it; of entries equal in core and bytes, a task sends one, of its smallest document. Anchors that more than HOT texts share are sent as their
own windows, one by one, for what surrounds a frequent passage is different everywhere. Where one core has several surroundings, suffix
arrays (linear grouping, `lyndon`) of the surroundings, with the core as one symbol, sort the windows; neighbours equal in a window's
length are one window, and it belongs to the smallest document id. A core with many surroundings is split in halves of its offsets, whose cores
are longer, until they are few or equal. Stage four joins what is covered to the texts.

Texts are shuffled once, compressed, by a code of id and text. Text order is by bytes; matches never cross documents. A null
text is empty; a null id is neither earlier nor later than any, so its document keeps everything. Repeated rows, and different texts of one id, are documents of
their own, none earlier than the other. 64-bit hashes stand for chunks, cores and texts; within a bucket 32 bits stand for a
gram, where a collision only lets an anchor through to stage three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, ship
from .lyndon import suffix_arrays
from .textcodes import _BACK, _BYTE, _STEP, Texts, _power, mix, slices

LENGTH, GRAM, CHUNK = 50, 20, 256
BUCKET_BYTES = 1 << 23
#: A chunk hash that more than this part of all chunks share is joined by broadcast.
HEAVY = 1000
#: Texts with one gram from which its windows are sent one by one.
HOT = 1000
_HOT = np.uint32(1 << 31)
_FEW = 48
_PACKED = "bucket int, a binary, b binary, c binary, d binary, e binary"


def _running(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("step", _STEP, len(data)), out=out[1:])
    return out


def _hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    back = _power("back", _BACK, len(running))[start]
    return mix((running[end] - running[start]) * back + (end - start).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def window_starts(texts: Texts) -> np.ndarray:
    """For each byte of a slice, whether a window of its text starts there."""
    ok = np.ones(len(texts.data), bool)
    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
        ok[max(a, b - LENGTH + 1) : b] = False
    return ok


def _codes(running: np.ndarray, width: int) -> np.ndarray:
    """A code of the `width` bytes from each position on; its upper half is well mixed."""
    n = len(running) - width
    x = (running[width:] - running[:n]) * _power("back", _BACK, n)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x7FB5D329728EA185)
    return x


def chunks(texts: Texts, running: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes of all chunks of a slice, the ends of the windows' starts in them, and their texts."""
    n = len(texts.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(n, bool)
    begins[: n - 15] = _codes(running, 16) < np.uint64(2**64 // CHUNK)
    begins[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    start = np.flatnonzero(begins & ok)
    text = np.searchsorted(texts.offsets, start, "right") - 1
    end = texts.offsets[text + 1] - LENGTH + 1
    same = text[1:] == text[:-1]
    end[:-1][same] = start[1:][same]
    return start, end, text


def anchors_of_windows(running: np.ndarray) -> np.ndarray:
    """The anchor of the window that starts at each byte of a slice, as long as windows lie in it."""
    low = np.uint64(0xFFFFFFFF)
    best = _codes(running, GRAM)
    best &= ~low
    best |= low - np.arange(len(best), dtype=np.uint64)
    return (low - (_least(best, LENGTH - GRAM + 1) & low)).astype(np.int64)


def anchors(texts: Texts, running: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of the live windows of a slice's texts, and their hashes."""
    n = len(texts.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = anchors_of_windows(running)
    is_anchor = np.zeros(n, bool)
    is_anchor[of[live[: len(of)]]] = True
    p = np.flatnonzero(is_anchor)
    return p, _hashes(running, p, p + GRAM)


def _text_keys(texts: Texts) -> np.ndarray:
    return _hashes(_running(texts.data), texts.offsets[:-1], texts.offsets[1:])


#: In column e: rows, by text, that later stages only pass on: what is covered; or starts of windows, those of equal windows of the same text, and how many follow.
_MARK, _SAME = b"mark", b"same"


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as a count, then all their first bytes, all their second ones and so on, each compressed for itself: high bytes, mostly equal, take next to nothing."""
    out = [(x.size).to_bytes(8, "little")]
    for plane in np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T:
        same = len(plane) > 0 and bool((plane == plane[0]).all())
        held = plane[:1].tobytes() if same else pa.compress(plane.tobytes(), codec="zstd", asbytes=True)  # no compressed form is a single byte
        out += [len(held).to_bytes(4, "little"), held]
    return b"".join(out)


def _unsqueeze(x: bytes, kind: type) -> np.ndarray:
    many, at = int.from_bytes(x[:8], "little"), 8
    out = np.empty((many, np.dtype(kind).itemsize), np.uint8)
    for j in range(out.shape[1]):
        held = x[at + 4 : at + 4 + int.from_bytes(x[at : at + 4], "little")]
        out[:, j] = held[0] if len(held) == 1 else np.frombuffer(pa.decompress(held, many, "zstd", asbytes=True), np.uint8)
        at += 4 + len(held)
    return out.view(kind).ravel()


def _row(bucket: int, *parts: np.ndarray, mark: bytes = b"") -> tuple:
    return (bucket, *(_squeeze(p) for p in parts), *([b""] * (4 - len(parts))), *([mark] if len(parts) < 5 else []))


def _marks(t: pa.Table) -> tuple[list[tuple], pa.Table]:
    """Rows of what is covered, and the other rows."""
    marked = pc.is_in(t["e"], value_set=pa.array([_MARK, _SAME]))
    own = t.filter(marked)
    return list(zip(*(own[x].to_pylist() for x in ("bucket", *"abcde")), strict=True)), t.filter(pc.invert(marked))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "a", "b", "c", "d", "e"])


def _split(bucket: np.ndarray, *columns: np.ndarray, mark: bytes = b"") -> Iterator[tuple]:
    """Packed rows, one for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield _row(int(bucket[lo]), *(c[lo:hi] for c in columns), mark=mark)


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    return ((codes >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _home(number: np.ndarray) -> np.ndarray:
    """The bucket of a text, which the upper half of its number tells."""
    return (number >> np.uint64(32)).astype(np.int32)


def _row_keys(part: Texts, doc: np.ndarray, running: np.ndarray) -> np.ndarray:
    return mix(_hashes(running, part.offsets[:-1], part.offsets[1:]) ^ mix(doc.view(np.uint64)))


_CHUNKS = "key long, doc long, start int, stop int, hash long"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents that have an id."""
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for part in slices(batch.column(1)):
            running = _running(part.data)
            start, end, text = chunks(part, running, window_starts(part))
            doc = ids[part.lo : part.hi]
            key = _row_keys(part, doc, running)
            go, first = known[part.lo : part.hi][text], part.offsets[text]
            columns = (key[text].view(np.int64), doc[text], (start - first).astype(np.int32), (end - first).astype(np.int32), _hashes(running, start, end + LENGTH - 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c[go]) for c in columns], names=["key", "doc", "start", "stop", "hash"])


def _pack_texts(buckets: int):
    """Documents packed by bucket: ids, whether these are null, lengths, and compressed texts one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1), 1 << 24):
                doc = ids[part.lo : part.hi]
                keys = np.concatenate([_row_keys(x, doc[x.lo : x.hi], _running(x.data)) for x in part.pieces()])
                size = np.diff(part.offsets)
                raw = part.data.tobytes()
                order = np.argsort(of := _buckets(keys, buckets), kind="stable")
                rows = []
                for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    text = b"".join(raw[a:b] for a, b in zip(part.offsets[mine].tolist(), part.offsets[mine + 1].tolist(), strict=True))
                    rows.append((int(of[mine[0]]), doc[mine].tobytes(), known[part.lo : part.hi][mine].tobytes(), size[mine].tobytes(), keys[mine].tobytes(), pa.compress(text, codec="zstd", asbytes=True)))
                yield _batch(rows)

    return run


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, `many` of them, one range after another."""
    return np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)


def _places(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in sorted keys, of what belongs to each text, and those texts."""
    lo, hi = np.searchsorted(keys, number, "left"), np.searchsorted(keys, number, "right")
    return _ranges(lo, hi - lo), np.repeat(np.arange(len(number)), hi - lo)


def _find_anchors(buckets: int):
    """Of a bucket of texts, with their dead chunks: anchors of live windows, packed by gram, and what dead chunks cover."""

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        dead = [_numbers(t, s["key"].to_numpy().view(np.uint64)), s["start"].to_numpy().astype(np.int64), s["stop"].to_numpy().astype(np.int64)]
        order = np.lexsort((dead[1], dead[0]))
        dead_key, first, stop = (x[order] for x in dead)
        new = np.ones(len(dead_key), bool)  # of a repeated row's chunks, one
        new[1:] = (dead_key[1:] != dead_key[:-1]) | (first[1:] != first[:-1])
        dead_key, first, stop = dead_key[new], first[new], stop[new]
        begins = np.ones(len(dead_key), bool)
        begins[1:] = (dead_key[1:] != dead_key[:-1]) | (first[1:] != stop[:-1])
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(dead_key))[: len(at)] - 1
        dead_key, first, stop = dead_key[at], first[at], stop[last]
        rows = list(_split(_home(dead_key), dead_key, first.astype(np.uint32), (stop + LENGTH - 1).astype(np.uint32), mark=_MARK))
        held, done = [], set()
        for part, number, _, known in _texts_of(t):
            running, live = _running(part.data), window_starts(part)
            at, text = _places(dead_key, number)
            change = np.zeros(len(part.data) + 1, np.int8)
            np.add.at(change, first[at] + part.offsets[text], 1)
            np.add.at(change, stop[at] + part.offsets[text], -1)
            live &= np.cumsum(change[:-1], dtype=np.int8) == 0
            for i, k in enumerate(number.tolist()):  # repeated rows send their anchors once
                if k in done or not known[i]:
                    live[part.offsets[i] : part.offsets[i + 1]] = False
                done.add(k)
            p, h = anchors(part, running, live)
            text = np.searchsorted(part.offsets, p, "right") - 1
            held.append((h, number[text], (p - part.offsets[text]).astype(np.uint32)))
        if not held:
            return pa.Table.from_batches([_batch(rows)])
        h, key, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        rows += _split(_buckets(h, buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), key, pos)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _columns(t: pa.Table, *kinds: type) -> list[np.ndarray]:
    out = []
    for name, kind in zip("abcde", kinds, strict=False):
        out.append(np.concatenate([np.zeros(0, kind), *(_unsqueeze(x, kind) for x in t[name].to_pylist())]))
    return out


def _shared(many: int):
    """Of a bucket of anchors: those of grams that two texts have, with a bit where many have them, packed by the text's bucket."""

    def run(t: pa.Table) -> pa.Table:
        rows, t = _marks(t)
        h, key, pos = _columns(t, np.uint32, np.uint64, np.uint32)
        order = np.argsort(h, kind="stable")
        h, key, pos = h[order], key[order], pos[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        mixed = np.zeros(group[-1] + 1 if len(group) else 0, bool)
        mixed[group[1:][(h[1:] == h[:-1]) & (key[1:] != key[:-1])]] = True
        order = np.lexsort((key, group))
        other = np.ones(len(key), bool)
        other[1:] = (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])
        hot = np.bincount(group[order][other], minlength=len(mixed)) > many
        pos = pos | np.where(hot[group], _HOT, np.uint32(0))
        keep = mixed[group]
        rows += _split(_home(key[keep]), key[keep], pos[keep])
        return pa.Table.from_batches([_batch(rows)])

    return run


_HALVES = ((0, 15), (16, 30))  # offsets of windows before their anchor


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key that occurs among keys: its place in wanted, and the first place of it in keys."""
    order = np.argsort(keys, kind="stable")
    at = np.searchsorted(keys[order], wanted)
    ok = at < len(keys)
    ok[ok] = keys[order][at[ok]] == wanted[ok]
    return np.flatnonzero(ok), order[at[ok]]


def _numbers(t: pa.Table, wanted: np.ndarray) -> np.ndarray:
    """Numbers of texts of a bucket, from their row keys: the bucket above, below it a key's place among the bucket's different ones, which is the same in every stage."""
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(d.as_py(), np.uint64) for d in t["d"])]))
    return np.searchsorted(keys, wanted).astype(np.uint64) | np.uint64((t["bucket"][0].as_py() if len(t) else 0) << 32)


def _texts_of(t: pa.Table) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a bucket of packed documents, with numbers of texts, equal in repeated rows, ids and which ids aren't null."""
    keys = [np.frombuffer(d.as_py(), np.uint64) for d in t["d"]]
    numbers = np.split(_numbers(t, np.concatenate([np.zeros(0, np.uint64), *keys])), np.cumsum([len(k) for k in keys])[:-1])
    for a, b, c, number, e in zip(*(t[x] for x in "abc"), numbers if keys else [], t["e"], strict=True):
        size = np.frombuffer(c.as_py(), np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(pa.decompress(e.as_py(), int(offsets[-1]), "zstd", asbytes=True), np.uint8)
        whole = Texts(0, len(size), data, offsets)
        doc, known = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), bool)
        for part in whole.pieces():
            mine = slice(part.lo, part.hi)
            yield part, number[mine], doc[mine], known[mine]


def _entries(buckets: int):
    """Cores and surroundings of shared anchors, packed by core; a: cores, b: numbers of texts, c: ids, d: anchors and halves, e: surroundings.

    Where a task has the same core and surroundings again, in a later document, it sends what that covers instead; in the same document, that the windows are equal.
    """

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        rows, s = _marks(s)
        key, pos = _columns(s, np.uint64, np.uint32)
        pos = pos.astype(np.int64)
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        made: list[tuple[np.ndarray, ...]] = []
        done: set[int] = set()
        for part, number, doc, known in _texts_of(t):
            data = part.data
            running = _running(data)
            fresh = np.array([k not in done for k in number.tolist()], bool) & known
            first = np.zeros(len(number), bool)
            first[np.unique(number, return_index=True)[1]] = True
            fresh &= first  # repeated rows are entered once
            done.update(number[fresh].tolist())
            at, text = _places(key, number)
            at, text = at[fresh[text]], text[fresh[text]]
            hot = (pos[at] & int(_HOT)) > 0
            if hot.any():
                is_hot = np.zeros(len(data), bool)
                is_hot[part.offsets[text[hot]] + (pos[at[hot]] ^ int(_HOT))] = True
                w = np.flatnonzero(is_hot[anchors_of_windows(running)] & window_starts(part)[: len(data) - LENGTH + 1])
                tx = np.searchsorted(part.offsets, w, "right") - 1
                w, tx = w[fresh[tx]], tx[fresh[tx]]
                made.append((_hashes(running, w, w + LENGTH) ^ np.uint64(2), number[tx], doc[tx], ((w - part.offsets[tx]) * 2).astype(np.uint32), np.zeros((len(w), 32), np.uint8)))
                at, text = at[~hot], text[~hot]
            begin, end = part.offsets[text], part.offsets[text + 1]
            a = begin + pos[at]
            for half, (o1, o2) in enumerate(_HALVES):
                w = o2 - o1
                # windows of this half that lie in the text, as offsets from o1
                least, most = np.maximum(0, a - o1 + LENGTH - end), np.minimum(w, a - o1 - begin)
                ok = np.flatnonzero(least <= most)
                if not len(ok):
                    continue
                x, tx = a[ok], text[ok]
                core = _hashes(running, x - o1, x - o2 + LENGTH) ^ np.uint64(half)
                around = np.zeros((len(ok), 2 * 15 + 2), np.uint8)
                for j in range(w):
                    l, r = x - o1 - 1 - j, x - o2 + LENGTH + j
                    inside = l >= part.offsets[tx]
                    around[inside, j] = data[l[inside]]
                    inside = r < part.offsets[tx + 1]
                    around[inside, 15 + j] = data[r[inside]]
                around[:, 30], around[:, 31] = least[ok], most[ok]
                place = ((x - part.offsets[tx]) * 2 + half).astype(np.uint32)
                made.append((core, number[tx], doc[tx], place, around))
        if not made:
            return pa.Table.from_batches([_batch(rows)])
        core, key, doc, place, around = (np.concatenate(x) for x in zip(*made, strict=True))
        code = core.copy()
        for j in range(0, 32, 8):
            code = mix(code * np.uint64(0xD1342543DE82EF95) + np.ascontiguousarray(around[:, j : j + 8]).view(np.uint64)[:, 0])
        order = np.lexsort((place, key, doc, code))
        head = np.ones(len(code), bool)
        head[1:] = code[order][1:] != code[order][:-1]
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = np.zeros(len(code), bool)
        later[order] = doc[order] > doc[first]
        low, high = around[:, 30].astype(np.int64), around[:, 31].astype(np.int64)
        rows += list(_covers(key[later], place[later], low[later], high[later]))
        own = np.ones(len(code), bool)  # the first place of each text
        own[1:] = head[1:] | (key[order][1:] != key[order][:-1])
        leader = order[np.flatnonzero(own)][np.cumsum(own) - 1]
        again = ~own & ~later[order]
        f, l = order[again], leader[again]
        start = lambda i: ((place[i] // 2).astype(np.int64) - np.where(place[i] % 2 == 0, _HALVES[0][0], _HALVES[1][0]) - high[i]).astype(np.uint32)
        rows += _split(_home(key[f]), key[f], start(f), start(l), (high[f] - low[f] + 1).astype(np.uint8), mark=_SAME)
        send = ~later
        send[f] = False
        rows += _split(_buckets(core[send], buckets), core[send], key[send], doc[send], place[send], around[send])
        return pa.Table.from_batches([_batch(rows)])

    return run


def _covers(key: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    """Packed rows of the stretches that the windows of offsets low to high at anchors cover, by text."""
    o1 = np.where(place % 2 == 0, _HALVES[0][0], _HALVES[1][0])
    a = (place // 2).astype(np.int64) - o1
    return _split(_home(key), key, (a - high).astype(np.uint32), (a - low + LENGTH).astype(np.uint32), mark=_MARK)


def first_windows(core: np.ndarray, left: np.ndarray, right: np.ndarray, w: int, least: np.ndarray, most: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the smallest and largest offset at which its window also starts in a smaller document (-1: none).

    left: bytes before the core, nearest first; right: bytes after it. A window of offset o has o bytes of left, the
    core, and w - o of right; those from least to most lie in the text.
    """
    n = len(core)
    low, high = np.full(n, 99), np.full(n, -1)
    if not n:
        return np.full(n, -1), high
    # equal core and surroundings: the smallest id stands for all
    code = core.copy()
    for j in range(w):
        code = mix(code * np.uint64(0xD1342543DE82EF95) + left[:, j]) * np.uint64(3) + right[:, j]
    code = mix(code + (least * 64 + most).astype(np.uint64))
    order = np.lexsort((doc, code))
    head = np.ones(n, bool)
    head[1:] = code[order][1:] != code[order][:-1]
    stands = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    leader = np.empty(n, np.int64)
    leader[order] = stands
    later = doc > doc[leader]
    low[later], high[later] = least[later], most[later]
    tops = np.unique(leader)

    # what else has the same core: only cores with several leaders go on
    _, lane, many = np.unique(core[tops], return_inverse=True, return_counts=True)
    tops, lane = tops[many[lane] > 1], lane[many[lane] > 1]
    if len(tops):
        lane = np.unique(lane, return_inverse=True)[1]
        many = np.bincount(lane)
        small = (many <= _FEW)[lane] if w else np.ones(len(tops), bool)
        if (~small).any():
            r = tops[~small]
            for s, t in ((0, w // 2), (w // 2 + 1, w)):
                a, b = np.maximum(least[r], s) - s, np.minimum(most[r], t) - s
                go = np.flatnonzero(a <= b)
                q, width = r[go], t - s
                longer = core[q] + np.uint64(s + 1)
                for j in range(s):
                    longer = mix(longer * np.uint64(0xC2B2AE3D27D4EB4F) + left[q, j])
                for j in range(w - t):
                    longer = mix(longer * np.uint64(0x9FB21C651E98DF25) + right[q, j])
                x, y = first_windows(longer, left[q][:, s : s + width], right[q][:, w - t : w - t + width], width, a[go], b[go], doc[q])
                hit = y >= 0
                low[q[hit]], high[q[hit]] = np.minimum(low[q[hit]], x[hit] + s), np.maximum(high[q[hit]], y[hit] + s)
        if small.any():
            _sorted_windows(core, left, right, w, least, most, doc, tops[small], lane[small], low, high)
    same = ~later  # what has the leader's id shares its result
    low[same], high[same] = low[leader[same]], high[leader[same]]
    return np.where(high >= 0, low, -1), high


def _sorted_windows(core, left, right, w, least, most, doc, tops, lane, low, high) -> None:
    """Windows of few surroundings of a core, by suffix arrays; low and high are widened in place."""
    by = np.argsort(lane, kind="stable")
    tops, lane = tops[by], lane[by]
    # a window has at least half of w on one side in common with an equal one
    near = (w + 1) // 2
    mark = np.zeros(len(tops), bool)
    for side in (left, right):
        code = lane.astype(np.uint64)
        for j in range(near):
            code = mix(code * np.uint64(0xD1342543DE82EF95) + side[tops, j])
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        mark |= count[inverse] > 1
    tops, lane = tops[mark], lane[mark]
    if not len(tops):
        return
    width = 2 * w + 2  # surroundings with the core as a symbol, and a separator
    text = np.full((len(tops), width), 1, np.int64)
    text[:, :w] = left[tops][:, w - 1 :: -1][:, :w].astype(np.int64) + 2 if w else text[:, :0]
    text[:, w] = 300
    text[:, w + 1 : 2 * w + 1] = right[tops][:, :w].astype(np.int64) + 2
    sizes = np.bincount(np.unique(lane, return_inverse=True)[1])
    lengths = sizes * width + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.zeros(bounds[-1], np.int64)
    first = np.repeat(bounds[:-1], sizes) + (np.arange(len(tops)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * width
    symbols[(first[:, None] + np.arange(width)).ravel()] = text.ravel()
    for lo in range(0, len(sizes), 4096):
        hi = min(lo + 4096, len(sizes))
        a, b = bounds[lo], bounds[hi]
        own = symbols[a:b]
        order = suffix_arrays(own, bounds[lo : hi + 1] - a)
        entry = np.full(b - a, -1, np.int64)
        rows = np.flatnonzero((first >= a) & (first < b))
        entry[(first[rows][:, None] - a + np.arange(width)).ravel()] = np.repeat(rows, width)
        offset = np.full(b - a, -1, np.int64)
        offset[(first[rows][:, None] - a + np.arange(width)).ravel()] = np.tile(w - np.arange(width), len(rows))  # bytes of left
        e, o = entry[order], offset[order]
        ok = (e >= 0) & (o >= 0)
        ok[ok] = (o[ok] >= least[tops[e[ok]]]) & (o[ok] <= most[tops[e[ok]]])
        at, e, o = order[ok], e[ok], o[ok]
        if len(at) < 2:
            continue
        equal = np.ones(len(at) - 1, bool)
        for j in range(w + 1):  # neighbours in the suffix array: equal in a window's w + 1 symbols?
            equal &= own[at[1:] + j] == own[at[:-1] + j]
        run = np.concatenate([[0], np.cumsum(~equal)])
        equal_lane = lane[e]
        run = np.unique(run * (int(lane.max()) + 1) + equal_lane, return_inverse=True)[1]
        least_doc = np.full(run.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_doc, run, doc[tops[e]])
        hit = doc[tops[e]] > least_doc[run]
        np.minimum.at(low, tops[e[hit]], o[hit])
        np.maximum.at(high, tops[e[hit]], o[hit])


def _covered(t: pa.Table) -> pa.Table:
    """Of a bucket of cores: stretches of texts that earlier documents have, packed by the text's bucket."""
    rows, t = _marks(t)
    core, key, doc, place, around = _columns(t, np.uint64, np.uint64, np.int64, np.uint32, np.uint8)
    around = around.reshape(-1, 32)
    for half, (o1, o2) in enumerate(_HALVES):
        r = np.flatnonzero(place % 2 == half)
        low, high = first_windows(core[r], around[r, :15], around[r, 15:30], o2 - o1, around[r, 30].astype(np.int64), around[r, 31].astype(np.int64), doc[r])
        hit = high >= 0
        rows += _covers(key[r][hit], place[r][hit], low[hit], high[hit])
    return pa.Table.from_batches([_batch(rows)])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"


def _results(t: pa.Table, s: pa.Table) -> pa.Table:
    """What is left of each text of a bucket; removed: starts and ends of removed stretches."""
    same = pc.equal(s["e"], _SAME)
    key, start, end = _columns(s.filter(pc.invert(same)), np.uint64, np.uint32, np.uint32)
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    twin_key, *twin = _columns(s.filter(same), np.uint64, np.uint32, np.uint32, np.uint8)
    order = np.argsort(twin_key, kind="stable")
    twin_key, (there, here, run) = twin_key[order], (x[order].astype(np.int64) for x in twin)
    rows = []
    for part, number, doc, known in _texts_of(t):
        twin_lo, twin_hi = np.searchsorted(twin_key, number, "left"), np.searchsorted(twin_key, number, "right")
        lo, hi = np.searchsorted(key, number, "left"), np.searchsorted(key, number, "right")
        for i in range(part.hi - part.lo):
            data = part.data[part.offsets[i] : part.offsets[i + 1]]
            a, b = start[lo[i] : hi[i]], end[lo[i] : hi[i]]
            doc_id = int(doc[i]) if known[i] else None
            if not len(a) or not known[i]:
                rows.append((doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest(), []))
                continue
            if twin_hi[i] > twin_lo[i]:  # equal windows are covered alike
                mine = slice(twin_lo[i], twin_hi[i])
                change = np.bincount(a, minlength=len(data) + 1) - np.bincount(b - LENGTH + 1, minlength=len(data) + 1)
                covered, many = np.cumsum(change) > 0, run[mine]
                x, y = _ranges(there[mine], many), _ranges(here[mine], many)
                x = np.unique(x[covered[y]])
                a, b = np.concatenate([a, x]), np.concatenate([b, x + LENGTH])
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
            reach = np.maximum.accumulate(b)
            new = np.concatenate([[True], a[1:] > reach[:-1]])
            a, b = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            kept = np.ones(len(data), bool)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept[x:y] = False
            rows.append((doc_id, len(data), int((b - a).sum()), len(a), hashlib.sha256(data[kept].tobytes()).hexdigest(), np.column_stack([a, b]).ravel().tolist()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def dead_chunks(docs: DataFrame) -> DataFrame:
    """(key, start, stop) of chunks that an earlier document has too."""
    spark = docs.sparkSession
    docs.mapInArrow(_chunk_rows, _CHUNKS).write.parquet(path := new_path(spark, "chunks"))
    every = spark.read.parquet(path)
    shared = every.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most")
    many = every.count() // HEAVY
    shared = cut(shared.select("hash", "least", "n"))
    heavy, light = F.broadcast(shared.where(F.col("n") > many).select("hash", "least")), shared.where(F.col("n") <= many).select("hash", "least")
    rest = every.join(heavy.select("hash"), "hash", "left_anti").join(light, "hash")
    return every.join(heavy, "hash").unionByName(rest).where("doc > least").select("key", "start", "stop")


def removed_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed stretches."""
    ship(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    group = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    dead = dead_chunks(docs).withColumn("bucket", (F.shiftrightunsigned("key", 33) % buckets).cast("int"))
    texts = group(docs.mapInArrow(_pack_texts(buckets), _PACKED))
    found = texts.cogroup(group(dead)).applyInArrow(_find_anchors(buckets), _PACKED)
    shared = group(found).applyInArrow(_shared(hot), _PACKED)
    entries = texts.cogroup(group(shared)).applyInArrow(_entries(buckets), _PACKED)
    spans = group(entries).applyInArrow(_covered, _PACKED)
    return texts.cogroup(group(spans)).applyInArrow(_results, _RESULT)
