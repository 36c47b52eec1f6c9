"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared only within a label and a dimension. Equal vectors are one point with a number of copies. A tree
of cells is grown over all points of a label, level by level: a cell of more than `block` points gets up to `fan` centres of its own (points with the
smallest hashes), and each of its points goes to the nearest. Cells end where they hold at most `block` points or lie within half the threshold of their
centre; such dense cells are cut by a hash. The number of cells follows the number of points; all of a level is assigned in tasks of bounded
size. Spark then walks down the tree with itself, one level a round: pairs of cells whose centres are farther apart than both covering radii and the
threshold allow are dropped. The pairs of final cells that are left are a task each, for the points of either cell that may have a partner in the other.

A task builds a cover tree of each of its two cells: nested levels of centres with halving radii, every point within
its level's radius of its centre. Both trees are walked down together; a pair of nodes is dropped as soon as the
distance of the centres exceeds the threshold by more than both covering radii, and taken whole where the distance
plus both radii is below it. What is left are pairs of points, whose cosine is computed in double precision. A task
returns counts of links and a spanning forest of them, never the pairs.

Vectors are divided by their largest component before anything is squared, so no finite magnitude over- or underflows. Vectors that are
null, empty, zero or hold null or non-finite components, and vectors without a label, link with
nothing. Repeated rows are vectors of their own; a null id is not the smallest of its component unless all are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .components import components, local_roots

_SLACK = 1e-7
_LEAF = 64
#: Node pairs of at most this many pairs of points are compared outright.
_DIRECT = 1 << 16
_HELD = 1 << 20
#: A child of more than this share of its cell's points isn't divided further.
_DIVIDES = 7 / 8
BLOCK, FAN, CHUNK_ROWS = 2048, 64, 1 << 14


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a largest component of 1, and vectors of length 1."""
    scaled = vectors / np.abs(vectors).max(1)[:, None] if len(vectors) else vectors
    return scaled, scaled / np.sqrt((scaled**2).sum(1))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


@dataclass
class Node:
    centre: int
    points: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)
    #: Of children: their centres and radii.
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover(x: np.ndarray, points: np.ndarray, level: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Points in groups within `level` of the first of each, with their distances to it; no first lies within `level` of another."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = []
    while len(points):
        some, rest = points[:_LEAF], points[_LEAF:]
        near = distances(x[some], x[some]) <= level
        np.fill_diagonal(near, True)
        heads: list[int] = []
        for i in range(len(some)):
            if not near[i, heads].any():
                heads.append(i)
        apart = distances(x[points], x[some[heads]])
        apart[heads, np.arange(len(heads))] = 0
        to, far = apart.argmin(1), apart.min(1)
        inside = far <= level
        inside[: len(some)] = True
        order = np.argsort(to[inside], kind="stable")
        mine, own, far = points[inside][order], to[inside][order], far[inside][order]
        for lo, hi in zip(np.searchsorted(own, np.arange(len(heads))), np.searchsorted(own, np.arange(len(heads)), "right"), strict=True):
            first = lo + int(far[lo:hi].argmin())
            swap = np.concatenate([[first], np.arange(lo, first), np.arange(first + 1, hi)])
            out.append((mine[swap], far[swap]))
        points = points[~inside]
    return out


def build(x: np.ndarray, least: float) -> Node:
    """Cover tree of unit vectors; nodes of few points, or of a radius below `least`, aren't divided further."""

    def node(points: np.ndarray, far: np.ndarray, level: float) -> Node:
        radius = float(far.max())
        out = Node(int(points[0]), points, radius)
        if len(points) <= _LEAF or radius <= least:
            return out
        while level >= radius:
            level /= 2
        out.children = [node(mine, own, level) for mine, own in cover(x, points, level)]
        out.centres = np.array([c.centre for c in out.children])
        out.radii = np.array([c.radius for c in out.children])
        return out

    points = np.arange(len(x))
    far = distances(x, x[:1])[:, 0]
    far[0] = 0
    return node(points, far, 2.0)


@dataclass
class Links:
    """Numbers of linked vectors of n points, and a forest over their links, kept small."""

    copies: np.ndarray
    count: np.ndarray = field(init=False)
    a: list[np.ndarray] = field(default_factory=list)
    b: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def __post_init__(self) -> None:
        self.count = np.zeros(len(self.copies), np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.a.append(i)
        self.b.append(j)
        self.held += len(i)
        if self.held > _HELD:
            root = self.roots()
            self.a, self.b, self.held = [np.arange(len(root))], [root], len(root)

    def roots(self) -> np.ndarray:
        none = np.zeros(0, np.int64)
        return local_roots(len(self.copies), np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.copies[j])
        np.add.at(self.count, j, self.copies[i])
        self.join(i, j)

    def whole(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """Every point of i with every point of j, or all of i with one another."""
        self.count[i] += self.copies[j].sum() - (self.copies[i] if own else 0)
        if not own:
            self.count[j] += self.copies[i].sum()
        both = i if own else np.concatenate([i, j])
        self.join(both, np.full(len(both), both[0]))


def dual(scaled: np.ndarray, unit: np.ndarray, at: np.ndarray, to: np.ndarray | None, cosine: float, out: Links) -> None:
    """Links of the points `at` with the points `to` (with one another where that is None)."""
    far, same = float(np.sqrt(2 - 2 * cosine)), to is None
    top = build(unit[at], far / 16)
    other, to = (top, at) if same else (build(unit[to], far / 16), to)
    stack = [(top, other)]

    def verify(i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        ok = cos >= cosine + 1e-12
        close = np.flatnonzero(~ok & (cos >= cosine - 1e-12))
        if len(close):
            a, b = scaled[i[close]], scaled[j[close]]
            ok[close] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= cosine
        if ok.any():
            out.pairs(i[ok], j[ok])

    while stack:
        p, q = stack.pop()
        self_pair = same and p is q
        if len(p.points) * len(q.points) <= _DIRECT or not (p.children or q.children):
            for lo in range(0, len(p.points), 1024):
                mine, its = at[p.points[lo : lo + 1024]], to[q.points]
                cos = unit[mine] @ unit[its].T
                live = cos >= cosine - 1e-12
                if self_pair:
                    live &= lo + np.arange(len(mine))[:, None] < np.arange(len(its))[None, :]
                i, j = np.nonzero(live)
                verify(mine[i], its[j], cos[i, j])
            continue
        # the children of both, or of the one that has some
        ps, qs = p.children or [p], q.children or [q]
        pc, pr = (p.centres, p.radii) if p.children else (np.array([p.centre]), np.array([p.radius]))
        qc, qr = (q.centres, q.radii) if q.children else (np.array([q.centre]), np.array([q.radius]))
        apart = distances(unit[at[pc]], unit[to[qc]])
        reach = pr[:, None] + qr[None, :]
        live = apart <= far + reach + _SLACK
        whole = apart + reach <= far - 1e-5
        if self_pair:
            live = np.triu(live)
            np.fill_diagonal(whole, pr * 2 <= far - 1e-5)
        single = np.array([len(c.points) == 1 for c in ps])[:, None] & np.array([len(c.points) == 1 for c in qs])[None, :]
        ends = live & single
        for i, j in zip(*np.nonzero(live & whole & ~single), strict=True):
            out.whole(at[ps[i].points], to[qs[j].points], self_pair and i == j)
        if self_pair:
            np.fill_diagonal(ends, False)
        i, j = np.nonzero(ends)
        if len(i):
            i, j = at[pc[i]], to[qc[j]]
            verify(i, j, (unit[i] * unit[j]).sum(1))
        stack += [(ps[i], qs[j]) for i, j in zip(*np.nonzero(live & ~whole & ~single), strict=True)]


def links(ids: np.ndarray, copies: np.ndarray, left: np.ndarray, vectors: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links in a task, their numbers of linked vectors, and the smallest id that each reaches there."""
    order = np.argsort(ids, kind="stable")
    ids, copies, left = ids[order], copies[order], left[order]
    scaled, unit = units(vectors[order])
    at, to = (np.arange(len(ids)), None) if same else (np.flatnonzero(left), np.flatnonzero(~left))
    out = Links(copies)
    if len(at) and (to is None or len(to)):
        dual(scaled, unit, at, to, cosine, out)
    some = out.count > 0
    return ids[some], out.count[some], ids[out.roots()][some]


_POINT = "point long, label long, dim int, copies long, vector array<{t}>, node long, far double, visits array<long>"


def _matrix(t: pa.Table, name: str, dim: int) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _to_nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Points of one cell with the nearest of its centres, their distance, and the other cells that may hold a partner.

    What is nearer to centre c than to centre d lies on c's side of the plane between them; a point as far as the threshold on d's side has no partner there.
    """
    points, dim = points.combine_chunks(), points["dim"][0].as_py() if points.num_rows else 1
    if not points.num_rows:
        return points.drop_columns(["salt"])
    centre = units(_matrix(centres, "centre", dim))[1]
    reach = centres["reach"][0].as_py()
    apart = distances(units(_matrix(points, "vector", dim))[1], centre)
    child = centres["child"].to_numpy()
    own, far = apart.argmin(1), apart.min(1)
    between = distances(centre, centre)[own]
    visit = (apart**2 - far[:, None] ** 2 <= 2 * reach * between + _SLACK) & (np.arange(len(child)) != own[:, None])
    before = [x or [] for x in points["visits"].to_pylist()]
    visits = pa.array([x + child[v].tolist() for x, v in zip(before, visit, strict=True)], pa.list_(pa.int64()))
    points = points.drop_columns(["salt", "node", "far", "visits"])
    return points.append_column("node", pa.array(child[own])).append_column("far", pa.array(far)).append_column("visits", visits)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _unit(vector: Column) -> Column:
    scaled = F.transform(vector, lambda v: v / F.array_max(F.transform(vector, F.abs)))
    return F.transform(scaled, lambda v: v / F.sqrt(_sum(F.transform(scaled, lambda w: w * w))))


def grow(points: DataFrame, cosine: float, block: int, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """Points in their final cells; all cells (node, parent, centre, radius, n, final); and the number of levels."""
    far = float(np.sqrt(2 - 2 * cosine))
    kind = points.schema["vector"].dataType.elementType.simpleString()
    placed = points.withColumns({"label": F.xxhash64("label"), "node": F.xxhash64("label", "dim"), "far": F.lit(4.0), "visits": F.array().cast("array<long>")}).select(*[x.split()[0] for x in _POINT.split(", ")])
    of = placed.groupBy("node").agg(F.count("*").alias("n")).select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("array<double>").alias("centre"), F.lit(4.0).alias("radius"), "n")
    cells, level = cut(of), 0
    last = cells.withColumn("before", F.lit(None).cast("long"))
    while True:
        # a cell that its centres hardly divide, as where most of its points lie in one direction, stays whole and is cut by a hash
        divided = F.col("before").isNull() | (F.col("n") <= F.col("before") * _DIVIDES)
        large = cut(last.where((F.col("n") > block) & (F.col("radius") > far / 2) & divided).select("node", "n", F.least(F.ceil(2 * F.col("n") / block), F.lit(fan)).cast("int").alias("k")))
        if large.isEmpty():
            final = cells.join(cells.select(F.col("parent").alias("node")).distinct().withColumn("divided", F.lit(True)), "node", "left")
            return placed, cut(final.select("node", "parent", "centre", "radius", "n", F.col("divided").isNull().alias("final"))), level
        level += 1
        chance = F.pmod(F.xxhash64("point", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        ranked = placed.join(large, "node").where(chance * F.col("n") < 4 * F.col("k") + 16).withColumn("rank", F.expr(f"row_number() over (partition by node order by xxhash64(point, {level}), point)"))
        centres = cut(ranked.where("rank <= k").select("node", F.xxhash64("node", "rank", F.lit(level)).alias("child"), _unit(F.col("vector").cast("array<double>")).alias("centre"), "n"))
        salts = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
        mine = placed.join(large.select("node", "n"), "node").withColumn("salt", F.pmod(F.xxhash64("point", F.lit(3)), salts).cast("int")).drop("n")
        spread = centres.select(F.col("node").alias("cell"), "child", "centre", F.lit(far).alias("reach"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"))
        moved = mine.groupBy("node", "salt").cogroup(spread.groupBy("cell", "part")).applyInArrow(_to_nearest, _POINT.format(t=kind))
        placed = cut(placed.join(large.select("node"), "node", "left_anti").select(*moved.columns).unionByName(moved))
        sizes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        last = cut(centres.select(F.col("node").alias("parent"), F.col("child").alias("node"), "centre", F.col("n").alias("before")).join(sizes, "node").select(*cells.columns, "before"))
        cells = cells.unionByName(last.drop("before"))


def meeting(cells: DataFrame, levels: int, cosine: float) -> DataFrame:
    """(a, b, via_a, via_b) of final cells, a <= b, that may hold a linked pair: the tree walked down with itself.

    via_b is the ancestor of b, or b, where the paths to both part; points of a that don't visit it have no partner in b. via_a likewise.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    below = cells.where("parent is not null").select(F.col("parent").alias("up"), "node", "centre", "radius")
    kids = cut(below.unionByName(cells.where("final").select(F.col("node").alias("up"), "node", "centre", "radius")))
    none = F.lit(None).cast("long")
    pairs = cells.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), none.alias("via_a"), none.alias("via_b"))

    def side(x: str) -> DataFrame:
        return kids.select(F.col("up").alias(x), F.col("node").alias(f"{x}_node"), F.col("centre").alias(f"{x}_centre"), F.col("radius").alias(f"{x}_radius"))

    for _ in range(levels):
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b or a_node <= b_node")
        apart = F.sqrt(_sum(F.zip_with("a_centre", "b_centre", lambda v, w: (v - w) * (v - w))))
        near = both.where(F.col("a_centre").isNull() | F.col("b_centre").isNull() | (F.col("a_node") == F.col("b_node")) | (apart <= F.col("a_radius") + F.col("b_radius") + reach))
        parts = (F.col("a") == F.col("b")) & (F.col("a_node") != F.col("b_node"))
        near = near.select("a_node", "b_node", F.when(parts, F.col("a_node")).otherwise(F.col("via_a")).alias("via_a"), F.when(parts, F.col("b_node")).otherwise(F.col("via_b")).alias("via_b"))
        turn = F.col("a_node") > F.col("b_node")
        either = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
        pairs = cut(near.select(either("a_node", "b_node").alias("a"), either("b_node", "a_node").alias("b"), either("via_a", "via_b").alias("via_a"), either("via_b", "via_a").alias("via_b")))
    return pairs


def near_duplicates(rows: DataFrame, cosine: float = 0.98, block: int = BLOCK, fan: int = FAN, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"  # exact in half the bytes
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    fit = F.col("label").isNotNull() & finite
    base = base.select("vec_id", "label", fit.alias("fit"), F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")
    valid = base.where("fit")
    points = cut(valid.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("point", F.xxhash64("label", "dim", "h1", "h2")))

    placed, cells, levels = grow(points.select("point", "label", "dim", "copies", "vector"), cosine, block, fan)
    met = meeting(cells, levels, cosine)
    size = cells.where("final").select("node", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    met = met.join(size.select(F.col("node").alias("a"), F.col("salts").alias("a_salts")), "a").join(size.select(F.col("node").alias("b"), F.col("salts").alias("b_salts")), "b")
    one = met.select(F.col("a").alias("node"), F.col("a_salts").alias("salts"), F.col("b").alias("node2"), F.col("b_salts").alias("salts2"), F.col("via_b").alias("via"))
    two = met.where("a <> b").select(F.col("b").alias("node"), F.col("b_salts").alias("salts"), F.col("a").alias("node2"), F.col("a_salts").alias("salts2"), F.col("via_a").alias("via"))
    spread = placed.join(one.unionByName(two), "node").where("via is null or array_contains(visits, via)").withColumn("salt", F.pmod(F.xxhash64("point", F.lit(7)), F.col("salts")).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("salts2") - 1)).alias("salt2"))
    own, its = F.struct("node", "salt"), F.struct(F.col("node2").alias("node"), F.col("salt2").alias("salt"))
    tasks = spread.select(F.least(own, its).alias("a"), F.greatest(own, its).alias("b"), (own <= its).alias("left"), "point", "copies", "dim", "vector")

    def task(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        a, b, dim = t["a"][0].as_py(), t["b"][0].as_py(), t["dim"][0].as_py()
        got = links(t["point"].to_numpy(), t["copies"].to_numpy(), t["left"].to_numpy(), _matrix(t, "vector", dim), cosine, a == b)
        return pa.table({"point": pa.array(got[0], pa.int64()), "links": pa.array(got[1], pa.int64()), "root": pa.array(got[2], pa.int64())})

    found = cut(tasks.groupBy("a", "b").applyInArrow(task, "point long, links long, root long"))
    total = found.groupBy("point").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    named = points.select("label", "dim", "h1", "h2", "point", "copies", "smallest").join(total, "point", "left").join(tree.withColumnRenamed("node", "point"), "point", "left").withColumn("group", F.coalesce("component", "point"))
    smallest = named.groupBy("group").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "group").select("label", "dim", "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    slim = base.select("vec_id", "fit", "label", "dim", "h1", "h2")
    linked = slim.where("fit").join(named, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = slim.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
