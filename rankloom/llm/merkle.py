"""A Merkle manifest of a table, with a proof for every row, by butterfly exchange.

Leaves of a group (a language) ascend by id; while several nodes are left, each `fanout` consecutive ones become the digest of their
concatenation (the last run of a level may be shorter, even one). Subroots, ordered by group, become the root in the same way.

1. Leaves are digests of Spark's own sha2 over a row's fields. They are written once, without texts; from then on only they are read.
2. They are dealt out by ranges of (group, id), and each task numbers what it has of a group; a table of counts by task and group, the only
   thing that is summed up in order, makes that a leaf's place in its group.
3. Places are cut into aligned partitions of fanout ** levels leaves. A partition folds its own levels alone and is one row: its leaves and its node.
4. Butterfly: partitions that form one node of the next level, `fanout` aligned blocks of them, swap nodes. A partition sends its node to the
   partition at its own place in each of the other blocks (places beyond the end of a last, shorter block are served in turn by those it has), so each
   gets one node from each block, hashes their common ancestor itself, and has the siblings on its way. After as many rounds as there are
   levels every partition holds the root and the upper part of its proof; nothing is sent down again. A round is one shuffle of at most
   `fanout` rows of a digest for each partition.
5. Subroots are leaves of a second tree, numbered and exchanged by the same functions.
6. Each partition folds its levels once more to write its leaves' proofs: siblings, level by level, from left to right.

Null fields are leaves of their own kind (`-`), a null group is a group and comes first, rows of one id go by their digests, and repeated rows are leaves of
their own. Other columns are left out. Texts stay in Spark's expressions, whatever their length. An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

FANOUT = 8
#: Levels that a partition folds by itself: 8 ** 4 leaves.
LEVELS = 4


def digest(*fields: Column) -> Column:
    """SHA-256 of fields, each `-` if null, else its number of UTF-8 bytes, `:` and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number among those of its group in this task; rows of a group stand together."""
    task = TaskContext.get()
    part, last, n, begun = task.partitionId() if task else 0, None, 0, False
    for batch in batches:
        numbers = []
        for g in batch.column(0).to_pylist():
            n = n + 1 if begun and g == last else 0
            last, begun = g, True
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "part", "nth"])


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `place`, from 0 without gaps within a group in this order (nulls first), and `total`, the group's number of rows; no group is one task."""
    ship(rows.sparkSession)
    columns = [group, *(c for c in rows.columns if c != group)]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    dealt = rows.select(*columns).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    own = cut(dealt.mapInArrow(_number, f"{fields}, part int, nth long"))
    counts = own.groupBy(F.col(group).alias("__g"), F.col("part").alias("__p")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("__g")
    counts = counts.select("__g", "__p", (F.sum("n").over(by.orderBy("__p")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("total"))
    met = own.join(counts, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__p") == F.col("part")))
    return met.withColumn("place", F.col("before") + F.col("nth")).drop("__g", "__p", "part", "nth", "before")


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def fold(nodes: list[str], total: int, levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The levels of a partition, from its leaves up to its node; `total` leaves of the group tell where levels end."""
    out = [nodes]
    while len(out) <= levels and total > 1:
        out.append([parent(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        total = -(-total // fanout)
    return out


def _fold_partition(levels: int, fanout: int, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def folded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        top = fold(rows["leaf"].to_pylist(), rows["total"][0].as_py(), levels, fanout)[-1]
        one = lambda name, of: pa.array([rows[name].to_pylist()], pa.list_(of))
        return pa.table({"grp": rows["grp"][:1].combine_chunks(), "partition": rows["partition"][:1].combine_chunks(), "total": rows["total"][:1].combine_chunks(), "node": pa.array(top, pa.string()), "ids": one("id", kind), "leaves": one("leaf", pa.string()), "changed": one("changed", pa.string())})

    return folded


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, partition, total) with `node`, now the group's root, and `proof`, the siblings on the way there, one string.

    Of (grp, partition, total, node): the nodes of a group's `total` partitions, numbered from 0.
    """
    state = nodes.select("grp", "partition", "total", "node", F.lit("").alias("proof"))
    most = state.agg(F.max("total")).first()[0] or 0
    step = 1
    while step < most:
        width = F.lit(step).cast("long")
        block, place = F.expr(f"partition div {step}"), F.col("partition") % width
        state = state.withColumn("block", block).withColumn("place", place).withColumn("last", F.expr(f"(total - 1) div {step}"))
        state = state.withColumn("room", F.least(width, F.col("total") - F.col("block") * width))
        begin = F.expr(f"block div {fanout} * {fanout}")
        towards = F.explode(F.sequence(begin, F.least(begin + (fanout - 1), "last"))).alias("to")
        sent = state.select("*", towards).withColumn("seats", F.least(width, F.col("total") - F.col("to") * width))
        # a seat of each block gets the node of this one from its own place here, or, beyond the end, from a place in turn
        sent = sent.where("place < seats").select("*", F.explode(F.sequence("place", F.col("seats") - 1, "room")).alias("seat"))
        own = F.col("block") == F.col("to")
        sent = sent.select("grp", (F.col("to") * width + F.col("seat")).alias("partition"), "total", F.struct("block", "node", own.alias("own")).alias("x"), F.when(own, F.col("proof")).alias("proof"))
        met = sent.groupBy("grp", "partition", "total").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("proof").alias("proof"))
        above = F.col("total") > width  # else the group's root is reached
        joined = F.array_join(F.transform("x", lambda v: v["node"]), "")
        siblings = F.array_join(F.transform(F.filter("x", lambda v: ~v["own"]), lambda v: v["node"]), "")
        state = met.select("grp", "partition", "total", F.when(above, F.sha2(joined, 256)).otherwise(F.col("x")[0]["node"]).alias("node"), F.concat("proof", siblings).alias("proof"))
        step *= fanout
    return cut(state)


def refolded(leaf: str, place: int, total: int, siblings: str, fanout: int = FANOUT, at: int = 0) -> tuple[str, int]:
    """The root that a leaf leads to with its siblings (from character `at` on), and where those of its tree end."""
    node, size = leaf, len(leaf)
    while total > 1:
        first = place // fanout * fanout
        left, others = place - first, min(fanout, total - first) - 1
        a, b = at + left * size, at + others * size
        node = hashlib.sha256((siblings[at:a] + node + siblings[a:b]).encode()).hexdigest()
        place, total, at = place // fanout, -(-total // fanout), b
    return node, at


def _prover(levels: int, fanout: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                leaves, total = row["leaves"], row["total"]
                own = fold(leaves, total, levels, fanout)
                first = row["partition"] * fanout**levels
                upper = row["upper"] + row["top"]
                proofs = []
                for i in range(len(leaves)):
                    parts, at = [], i
                    for level in own[:-1]:
                        begin = at // fanout * fanout
                        parts += [*level[begin:at], *level[at + 1 : begin + fanout]]
                        at //= fanout
                    proofs.append("".join(parts) + upper)
                columns = [pa.array(row["ids"], kind), *(pa.array(x, pa.string()) for x in (leaves, [row["subroot"]] * len(leaves), [row["root"]] * len(leaves), [parent([p]) for p in proofs]))]
                ends = []
                for i, (new, old) in enumerate(zip(row["changed"], leaves, strict=True)):
                    node, at = refolded(old if new is None else new, first + i, total, proofs[i], fanout)
                    ends.append(refolded(node, row["nth"], row["groups"], proofs[i], fanout, at)[0])
                columns += [pa.array(ends, pa.string()), pa.array([e == row["root"] for e in ends], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return prove


def manifest(rows: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", changed: Callable[[DataFrame], Column] | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    `changed` gives, for the input, each row's leaf as found later (null: as it was); folded_root is what that leaf leads to with the
    siblings of the proof, and verified tells whether it is the root.
    """
    leaf = digest(*[rows[f] for f in fields])
    kind = rows.schema[id_col].dataType.simpleString()
    later = changed(rows) if changed else F.lit(None).cast("string")
    leaves = cut(rows.select(rows[group_col].alias("grp"), rows[id_col].alias("id"), leaf.alias("leaf"), later.alias("changed")))
    of_id = leaves.select("id").limit(0).toArrow().schema.field(0).type
    placed = numbered(leaves, "grp", "id", "leaf").withColumn("partition", F.expr(f"place div {fanout**levels}"))
    grp = leaves.schema["grp"].dataType.simpleString()
    packed = cut(placed.groupBy("grp", "partition").applyInArrow(_fold_partition(levels, fanout, of_id), f"grp {grp}, partition long, total long, node string, ids array<{kind}>, leaves array<string>, changed array<string>"))
    parts = F.expr(f"(total - 1) div {fanout**levels} + 1")
    lower = butterfly(packed.select("grp", "partition", parts.alias("total"), "node"), fanout)
    subroots = lower.where("partition = 0").select(F.lit(0).alias("all"), F.col("grp").alias("name"), "node")
    order = numbered(subroots, "all", "name").select(F.col("all").alias("grp"), F.col("place").alias("partition"), "total", "node", "name")
    order = cut(order)
    top = butterfly(order.drop("name"), fanout).select(F.col("partition").alias("nth"), F.col("node").alias("root"), F.col("proof").alias("top"), F.col("total").alias("groups"))
    top = order.select(F.col("partition").alias("nth"), "name").join(top, "nth")
    upper = lower.select(F.col("grp").alias("g"), F.col("partition").alias("p"), F.col("node").alias("subroot"), F.col("proof").alias("upper"))
    whole = packed.drop("node").join(upper, F.col("grp").eqNullSafe(F.col("g")) & (F.col("partition") == F.col("p"))).drop("g", "p")
    whole = whole.join(top, F.col("grp").eqNullSafe(F.col("name"))).select("partition", "total", "ids", "leaves", "changed", "subroot", "upper", "nth", "root", "top", "groups")
    return whole.mapInArrow(_prover(levels, fanout, of_id), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("id", id_col)
