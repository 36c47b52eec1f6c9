"""WARC archives as a chunked record table.

Writing turns each page into rows of (record, chunk): the payload is cut into chunks of at most `chunk` characters,
and each becomes a WARC record segment (WARC-Segment-Number, continuation records), so that no record of an archive
holds more than one chunk of payload. A chunk also ends inside whatever would look like the start of a record, so
that segments can be told apart by a fixed separator. Spark's text sink writes the archives, with its own commit
protocol, to any file system that Spark knows, compressed by file; a task that is lost and runs again leaves no half
files.

Reading splits the archives at the separator into one row for each segment, an archive (a writing task's share) at a
time.
Segments of records of several chunks are sorted by record and chunk number, and a digest is carried from chunk to
chunk; no record is put together in memory. Records of one segment need no shuffle.

Of pages with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response, the
others revisit it. A null html is an empty payload. Repeated rows with the smallest page_id are responses, all of
them; pages with a null page_id are never referred to, unless all equal ones have none. Other columns than the two
named are not read, apart from url, where there is one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship

SEPARATOR = "\r\n\r\nWARC/1.1\r\n"
CHUNK = 1 << 18
_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload):
    """Bare upper-case base32 SHA-1 of a string or binary column, JVM-side."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _LETTERS)


def chunks(html: str, most: int = CHUNK) -> Iterator[str]:
    """The text in pieces of at most `most` characters that don't contain, nor start or end with half of, a separator."""
    at, n = 0, len(html)
    while at < n or n == 0:
        stop = min(n, at + most)
        if (found := html.find("WARC/1.1\r\n", at, stop)) >= 0:
            stop = found + 4  # between two segments stand headers, so neither half is taken for a separator
        yield html[at:stop]
        at = stop
        if n == 0:
            return


def decide(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages with payload_bytes, payload_digest and refers_to (null for responses)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.encode("html", "UTF-8"))})
    # what is decided by digest goes without html, however common a payload is; html meets the decision by page
    slim = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_bytes", "payload_digest")
    firsts = slim.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = slim.join(firsts, ["payload_digest", "payload_bytes"]).where("first < page_id or (page_id is null and first is not null)")
    later = later.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("first").alias("refers_to")).distinct()
    met = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    return met.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")


def _segments(page_id: int | None, url: str | None, html: str, size: int, digest: str, refers: int | None, most: int) -> Iterator[str]:
    """The record's segments, each without its last line feed, which the text sink adds."""
    name, target = f"urn:page:{'' if page_id is None else page_id}", "".join((url or "").split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    parts = chunks(html, most) if refers is None else iter([""])
    part = next(parts)
    nth, done, total = 1, 0, 0
    while not done:
        after = next(parts, None)
        done = after is None
        block = (head if nth == 1 else "") + part
        total += (length := len(block.encode()))
        kind = ("response" if refers is None else "revisit") if nth == 1 else "continuation"
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}{f':{nth}' if nth > 1 else ''}>", "WARC-Date: 2024-01-01T00:00:00Z"]
        if nth == 1:
            lines += [f"WARC-Target-URI: {target}"] * bool(target) + [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
            lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"] * (refers is not None)
        else:
            lines.append(f"WARC-Segment-Origin-ID: <{name}>")
        if nth > 1 or not done:
            lines.append(f"WARC-Segment-Number: {nth}")
            lines += [f"WARC-Segment-Total-Length: {total}"] * done
        lines.append(f"Content-Length: {length}")
        yield "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r"
        part, nth = after, nth + 1


def write(decided: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Write the archives below path, a folder that doesn't exist yet."""
    ship(decided.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            columns = [batch.column(x) for x in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                for x in _segments(*(c[i].as_py() for c in columns), chunk):
                    out.append(x)
                    held += len(x)
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    decided.mapInArrow(rows, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: record, record_type, chunk (from 1), chunks (null where more follow), headers and payload bytes."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    line = F.when(F.startswith("value", F.lit("WARC/1.1\r\n")), F.substr("value", F.lit(11))).otherwise(F.col("value"))
    cut = raw.select(line.alias("value")).select("*", F.instr("value", "\r\n\r\n").alias("at"))
    head = cut.select(F.concat(F.lit("\r\n"), F.substr("value", F.lit(1), F.col("at") + 1)).alias("head"), F.encode(F.substr("value", F.col("at") + 4), "UTF-8").alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    got = head.select(
        field("WARC-Type").alias("warc_type"), F.regexp_extract(F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")), "^<(.*)>$", 1).alias("record"),
        F.coalesce(field("WARC-Segment-Number").cast("long"), F.lit(1)).alias("chunk"), field("WARC-Segment-Number").isNotNull().alias("segmented"), field("WARC-Segment-Total-Length").cast("long").alias("total"),
        F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("stated_digest"), F.regexp_extract("head", r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>", 1).alias("refers"),
        F.substring("rest", 1, field("Content-Length").cast("int")).alias("block"),
    )
    # the first segment's block begins with an HTTP head, whose length is known from its blank line
    http = F.instr(F.decode(F.substring("block", 1, 512), "ISO-8859-1"), "\r\n\r\n")
    first = F.col("chunk") == 1
    return got.select(
        "record", "warc_type", "chunk", "segmented", "total", "stated_digest", F.nullif("refers", F.lit("")).cast("long").alias("refers_to"),
        F.when(first, F.regexp_extract(F.decode(F.substring("block", 1, 512), "ISO-8859-1"), r"\r\nContent-Length: ([0-9]+)", 1).cast("long")).alias("stated_bytes"),
        F.when(first, F.substring("block", http + 4, 1 << 30)).otherwise(F.col("block")).alias("payload"),
    )


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of each record of rows sorted by record and chunk."""
    record, digest, size = None, hashlib.sha1(), 0
    out: list[tuple[str, int, str]] = []

    def ended() -> list[tuple[str, int, str]]:
        return [(record, size, base64.b32encode(digest.digest()).decode())] if record is not None else []

    def table(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["record", "bytes", "digest"])

    for batch in batches:
        names, chunk, payload = batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("payload")
        for i, (name, nth) in enumerate(zip(names, chunk, strict=True)):
            if name != record or nth == 1:
                out += ended()
                record, digest, size = name, hashlib.sha1(), 0
            part = payload[i].as_buffer()
            digest.update(part)
            size += len(part)
        if out:
            yield table(out)
            out = []
    if rows := ended():
        yield table(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, digests computed anew."""
    ship(spark)
    rows = segments(spark, path)
    heads = rows.where("chunk = 1").select("record", "segmented", "warc_type", "refers_to", "stated_bytes", "stated_digest", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"))
    revisit = F.col("warc_type") == "revisit"
    page = F.nullif(F.regexp_extract("record", "^urn:page:(-?[0-9]*)$", 1), F.lit("")).cast("long").alias("page_id")
    plain = heads.where("not segmented").select(page, F.when(revisit, F.col("stated_bytes")).otherwise(F.col("n")).alias("payload_bytes"), F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
    parts = rows.where("segmented").select("record", "chunk", "payload").repartition("record").sortWithinPartitions("record", "chunk")
    long = parts.mapInArrow(_carried, "record string, bytes long, digest string")
    return plain.unionByName(long.select(page, F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Pages decided, written as archives below path (a new one unless given) and read back: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is empty, repeated rows are records of their own."""
    spark = pages.sparkSession
    return read(spark, write(decide(pages, least_bytes), path or new_path(spark, "warc"), chunk))
