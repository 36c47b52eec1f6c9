"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring of 2**32 places; a row belongs to the arc that ends at the next point
clockwise. A shard takes no more rows than its capacity: rows that overflow a full shard continue clockwise to the
next point whose shard has room. Capacities add up to the number of rows and differ by one at most, so counts do too.

Spark counts the rows of each arc; the number of arcs is fixed by the parameters (shards * virtual), never by the
data, so the walk round the ring works on that small table of counts. Within its arc a row's rank decides where it
goes; ranks are taken arc by arc, in thousands of tasks, none of which holds a whole shard, and a shard's slots
continue from arc to arc by offsets. Rows equal in id, size and checksum are counted before they are dealt out and
take consecutive ranks, so however many there are, they are one row until the end.

Null texts have no bytes, null ids are a value like any other, and repeated rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE_OF_ROW = 16
PLACES = 1 << 32
_CELL = 20  # an arc is found by the cell of 2**20 places first
_RUN = 1 << 16


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending order, and the shard of each; a shard's points don't depend on the number of shards."""
    owner = np.repeat(np.arange(shards, dtype=np.uint64), virtual)
    nth = np.tile(np.arange(virtual, dtype=np.uint64), shards)
    x = (owner * np.uint64(0x9E3779B97F4A7C15)) ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    point = (x >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((owner, point))
    return point[order], owner[order].astype(np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, number of rows, shard) for all rows of all arcs, in rounds clockwise."""
    room, left, done = capacity.copy(), counts.copy(), np.zeros(len(counts), np.int64)
    out, step = [], 0
    while (live := np.flatnonzero(left)).size:
        for arc in live:
            to = owner[(arc + step) % len(owner)]
            if took := int(min(left[arc], room[to])):
                out.append((int(arc), int(done[arc]), took, int(to)))
                room[to] -= took
                left[arc] -= took
                done[arc] += took
        step += 1
    return out


def _arcs(spark, point: np.ndarray) -> DataFrame:
    """(cell, lo, hi, arc): places from lo + 1 to hi belong to the arc; beyond the last point it is the first again."""
    lo, hi = np.concatenate([[-1], point]), np.concatenate([point, [PLACES - 1]])
    arc = np.concatenate([np.arange(len(point)), [0]])
    some = hi > lo  # of points at the same place, the first has the arc
    frame = spark.createDataFrame(pd.DataFrame({"lo": lo[some], "hi": hi[some], "arc": arc[some]}))
    return frame.select("*", F.explode(F.sequence(F.shiftright(F.col("lo") + 1, _CELL), F.shiftright("hi", _CELL))).alias("cell"))


def shard(rows: DataFrame, shards: int = 40, virtual: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and its slot there (from 0, without gaps)."""
    spark = rows.sparkSession
    point, owner = ring(shards, virtual)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = rows.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + SIZE_OF_ROW).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    each = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    placed = each.withColumn("place", place).withColumn("cell", F.shiftright("place", _CELL))
    placed = placed.join(F.broadcast(_arcs(spark, point)), ["cell"]).where("place > lo and place <= hi").drop("cell", "lo", "hi")

    counts = np.zeros(len(owner), np.int64)
    for r in placed.groupBy("arc").agg(F.sum("copies").alias("n")).collect():  # a row for each arc at most
        counts[r["arc"]] = r["n"]
    total = int(counts.sum())
    capacity = np.full(shards, total // shards, np.int64)
    capacity[: total % shards] += 1
    taken, plan = np.zeros(shards, np.int64), []
    for arc, first, n, to in walk(counts, owner, capacity):
        plan.append((arc, first, first + n, to, int(taken[to]) - first))
        taken[to] += n
    plan = F.broadcast(spark.createDataFrame(plan, "arc long, first long, last long, shard int, base long"))

    in_arc = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("over", F.sum("copies").over(in_arc)).withColumn("rank", F.col("over") - F.col("copies"))
    met = ranked.join(plan, ["arc"]).where("rank < last and over > first")
    met = met.select("doc_id", "size", "text_crc32", "shard", (F.greatest("rank", "first") + F.col("base")).alias("lo"), (F.least("over", "last") + F.col("base") - 1).alias("hi"))
    runs = met.select("*", F.explode(F.sequence("lo", "hi", F.lit(_RUN))).alias("at"))
    return runs.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("at", F.least("hi", F.col("at") + _RUN - 1))).alias("slot"))
