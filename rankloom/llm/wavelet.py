"""Token files: a wavelet matrix per shard, with access, counting and occurrences from the same compressed file.

Documents are dealt out by ranges of their ids and sorted, each task tokenises its range and writes one Parquet file, its shard, block by block. A block
holds `block` consecutive tokens of the shard (its last one fewer) as a wavelet matrix: one plane for each bit of the ids, highest first; a
plane has the bit of each token, in the order that planes above leave, which puts tokens of bit 0 before those of bit 1. With a count of
ones for every 512 bits, rank takes a constant number of steps and select a search of that directory, so that

* the token at a position is found by a rank a plane, down,
* a token's number of occurrences in a block is the width of an interval that two ranks a plane narrow,
* its occurrences are where selects take the places of that interval, up.

Payload of a block: `RLWM`, number of planes (1 byte), number of tokens (4 bytes, little-endian as all), then by plane its number of zeros (4 bytes), its bits
(lowest bit of a byte first, padded to 64 bytes) and the ones before each 512 bits (4 bytes each). Beside it stand the block's documents:
their ids and where each starts and ends in the shard. Parquet compresses all of it; Spark commits a shard's file whole or not at all.

A document that crosses blocks is told from its pieces when it is read: checksums of pieces, moved by what follows them, add up to that of the
whole, so a text of any length is never put together again. A null text is empty; an empty document is its end id alone. Repeated rows are documents of
their own, rows of one id stand in the order in which Spark scans them, and null ids come first. Other columns are left out. Writing costs a
task one block, and a document's text and ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetokens import encoded
from .common import ship
from .textcodes import slices

_MAGIC, _SPAN = b"RLWM", 512


class Plane:
    """A plane's bits with rank and select for arrays of places."""

    def __init__(self, words: np.ndarray, before: np.ndarray, zeros: int):
        self.words, self.before, self.zeros = words.reshape(-1, _SPAN // 64), before, zeros

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 9, at >> 6 & 7] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place (at most the plane's length)."""
        span, within = at >> 9, at & 511
        row = self.words[np.minimum(span, len(self.words) - 1)]
        part = np.arange(8)[None, :] - (within >> 6)[:, None]
        mask = np.where(part < 0, np.uint64(2**64 - 1), np.where(part == 0, (np.uint64(1) << (within & 63).astype(np.uint64))[:, None] - np.uint64(1), np.uint64(0)))
        return self.before[span].astype(np.int64) + np.bitwise_count(row & mask).sum(1, dtype=np.int64)

    def select(self, nth: np.ndarray, one: bool) -> np.ndarray:
        """The place of the nth one, or zero, counted from 0."""
        before = self.before.astype(np.int64) if one else np.arange(len(self.before)) * _SPAN - self.before
        out = np.empty(len(nth), np.int64)
        for lo in range(0, len(nth), 4096):
            k = nth[lo : lo + 4096]
            span = np.searchsorted(before, k, "right") - 1
            bits = np.unpackbits(self.words[span].view(np.uint8), axis=1, bitorder="little") == one
            out[lo : lo + 4096] = span * _SPAN + np.argmax(np.cumsum(bits, 1, dtype=np.int32) == (k - before[span] + 1)[:, None], 1)
        return out


class WaveletMatrix:
    """The tokens of a block."""

    def __init__(self, payload: bytes):
        magic, depth, self.n = struct.unpack_from("<4sBI", payload)
        if magic != _MAGIC:
            raise ValueError("not a block of tokens")
        at, self.planes = 9, []
        spans = -(-self.n // _SPAN)
        for _ in range(depth):
            zeros = struct.unpack_from("<I", payload, at)[0]
            words = np.frombuffer(payload, "<u8", spans * 8, at + 4)
            before = np.frombuffer(payload, "<u4", spans + 1, at + 4 + spans * 64)
            self.planes.append(Plane(words, before, zeros))
            at += 8 + spans * 68

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        n, depth = len(ids), int(ids.max(initial=0)).bit_length()
        ids = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        spans = -(-n // _SPAN)
        out = [struct.pack("<4sBI", _MAGIC, depth, n)]
        for k in range(depth - 1, -1, -1):
            one = (ids >> k & 1).astype(bool)
            bits = np.zeros(spans * 64, np.uint8)
            packed = np.packbits(one, bitorder="little")
            bits[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view("<u8")).reshape(-1, 8).sum(1, dtype=np.int64))])
            out += [struct.pack("<I", n - int(before[-1])), bits.tobytes(), before.astype("<u4").tobytes()]
            ids = np.concatenate([ids[~one], ids[one]])
        return b"".join(out)

    def all(self) -> np.ndarray:
        """All tokens in order."""
        depth = len(self.planes)
        ids = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            one = np.unpackbits(plane.words.view(np.uint8).ravel(), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(ids)
            up[~one], up[one] = ids[: plane.zeros], ids[plane.zeros :] | ids.dtype.type(1 << k)
            ids = up
        return ids.astype(np.uint32)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at these positions."""
        ids = np.zeros(len(at), np.uint32)
        for plane in self.planes:
            one, ones = plane.bit(at), plane.ones(at)
            at = np.where(one, plane.zeros + ones, at - ones)
            ids = ids << np.uint32(1) | one
        return ids

    def interval(self, token: int, lo: int = 0, hi: int | None = None) -> tuple[int, int]:
        """Where the occurrences of a token among positions lo to hi stand below the last plane."""
        ends = np.array([lo, self.n if hi is None else hi])
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            if ends[0] >= ends[1]:
                return 0, 0
            ones = plane.ones(ends)
            ends = plane.zeros + ones if token >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.interval(token, lo, hi)
        return max(b - a, 0)

    def occurrences(self, token: int) -> np.ndarray:
        """The positions of a token, ascending."""
        at = np.arange(*self.interval(token))
        for k, plane in enumerate(reversed(self.planes)):
            one = bool(token >> k & 1)
            at = plane.select(at - plane.zeros if one else at, one)
        return at


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits modulo that of CRC-32, its highest power in the lowest bit."""
    out = 0
    for k in range(31, -1, -1):
        out ^= a if b >> k & 1 else 0
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


def moved(crc: int, n: int) -> int:
    """What a piece of this CRC-32 adds (by exclusive or) to that of a whole in which n bytes follow it."""
    power = 1 << 23  # x to the power of 8
    while n:
        crc = _times(crc, power) if n & 1 else crc
        power, n = _times(power, power), n >> 1
    return crc


def _writer(tokenizer_path: str, end_id: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId() if task else 0
        waiting: list[np.ndarray] = []
        docs: list[tuple[object, int, int]] = []
        first = total = 0
        kind = pa.int64()

        def flush(n: int) -> pa.RecordBatch:
            nonlocal waiting, docs, first
            ids = np.concatenate(waiting)
            upto = first + n
            met = [d for d in docs if d[1] < upto]
            columns = [pa.array([shard], pa.int32()), pa.array([first // block], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([[d[0] for d in met]], pa.list_(kind)), *(pa.array([[d[k] for d in met]], pa.list_(pa.int64())) for k in (1, 2)), pa.array([WaveletMatrix.build(ids[:n])], pa.binary())]
            waiting, docs, first = ([ids[n:]] if len(ids) > n else []), [d for d in docs if d[2] > upto], upto
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "first", "n_tokens", "doc_ids", "starts", "ends", "payload"])

        for batch in batches:
            kind = batch.schema.field(0).type
            own = batch.column(0).to_pylist()
            for doc, ids in zip(own, encoded(slices(batch.column(1)), tokenizer_path, end_id), strict=True):
                waiting.append(ids)
                docs.append((doc, total, total + len(ids)))
                total += len(ids)
                while total - first >= block:
                    yield flush(block)
        if total > first:
            yield flush(total - first)

    return write


def write(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block: int = 1 << 19, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents, in ascending order of their ids, as token files below a path that all executors reach; Spark chooses how many, or `files`."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"), F.monotonically_increasing_id().alias("nth"))
    dealt = rows.repartitionByRange(*([files] if files else []), "id", "nth").sortWithinPartitions("id", "nth").select("id", "text")
    blocks = dealt.mapInArrow(_writer(tokenizer_path, end_id, block), f"shard int, block long, first long, n_tokens long, doc_ids array<{kind}>, starts array<long>, ends array<long>, payload binary")
    options = {"compression": "zstd", "parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4, "parquet.enable.dictionary": "false"}
    blocks.write.options(**options).parquet(path)


def shards(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(shard, its first token among all, its number of tokens): one for each file, from columns beside the planes."""
    sizes = sorted((r["shard"], r["n"]) for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    out, at = [], 0
    for shard, n in sizes:
        out.append((shard, at, n))
        at += n
    return out


def _with_offset(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    return df.join(F.broadcast(spark.createDataFrame(shards(spark, path), "shard int, offset long, size long")), "shard")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        for k in range(batch.num_rows):
            shard, first, payload = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            starts, ends = batch.column(4)[k].as_py(), batch.column(5)[k].as_py()
            raw = WaveletMatrix(payload).all().astype("<u4")
            n, crc = [], []
            for a, b in zip(starts, ends, strict=True):
                lo, hi = max(a - first, 0), min(b - first, len(raw))
                n.append(hi - lo)
                crc.append(moved(zlib.crc32(raw[lo:hi]), 4 * (b - first - hi)))
            columns = [pa.array([shard] * len(n), pa.int32()), pa.array(starts, pa.int64()), ids[k].values, pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "start", "id", "n", "crc"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: all its ids are decoded where their block lies."""
    ship(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = blocks.select("shard", "first", "payload", "doc_ids", "starts", "ends").mapInArrow(_pieces, f"shard int, start long, id {kind}, n long, crc long")
    whole = pieces.groupBy("shard", "start", "id").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    return _with_offset(spark, whole, path).select(F.col("id").alias("doc_id"), (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _for_tokens(tokens: list[int], locate: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, block = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), WaveletMatrix(batch.column(2)[k].as_py())
                for token in tokens:
                    found = first + block.occurrences(token) if locate else np.array([block.count(token)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard, np.int32)), pa.array(np.full(len(found), token, np.int64)), pa.array(found.astype(np.int64))], names=["shard", "token", "x"])

    return look


def count(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the given tokens stands in all files, by ranks alone."""
    ship(spark)
    found = spark.read.parquet(path).select("shard", "first", "payload").mapInArrow(_for_tokens(tokens, False), "shard int, token long, x long")
    return found.groupBy("token").agg(F.sum("x").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, position): where each of the given tokens stands among all tokens of all files."""
    ship(spark)
    found = spark.read.parquet(path).select("shard", "first", "payload").mapInArrow(_for_tokens(tokens, True), "shard int, token long, x long")
    return _with_offset(spark, found, path).select("token", (F.col("offset") + F.col("x")).alias("position"))


def _access(key: tuple, blocks: pa.Table, wanted: pa.Table) -> pa.Table:
    if not blocks.num_rows or not wanted.num_rows:
        return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
    local = wanted["local"].to_numpy() - blocks["first"][0].as_py()
    return pa.table({"position": wanted["position"], "token": pa.array(WaveletMatrix(blocks["payload"][0].as_py()).access(local).astype(np.int64))})


def access(spark: SparkSession, path: str, positions: DataFrame, position_col: str = "position", block: int = 1 << 19) -> DataFrame:
    """(position, token) of the distinct positions of a table that lie within the files; only blocks that hold one are opened, each by one task. `block` as written."""
    ship(spark)
    known = shards(spark, path)
    wanted = positions.select(F.col(position_col).cast("long").alias("position")).where("position >= 0").distinct()
    firsts = np.array([x[1] for x in known], np.int64)
    numbers = np.array([x[0] for x in known], np.int64)
    total = sum(x[2] for x in known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            at = at[at < total]
            k = np.searchsorted(firsts, at, "right") - 1
            local = at - firsts[k] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[k].astype(np.int32), local // block, local, at)], names=["shard", "block", "local", "position"])

    placed = wanted.mapInArrow(place, "shard int, block long, local long, position long")
    used = spark.read.parquet(path).select("shard", "block", "first", "payload").join(placed.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    return used.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInArrow(_access, "position long, token long")
