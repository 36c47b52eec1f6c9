"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Every text becomes the set of its runs of `n` words (a shorter text, but not one without words, is one run), as 64-bit
codes. Texts of equal sets are a class; what follows is about classes. Each of `trees` trees orders the classes by a label of
DEEPEST minima of the set, 16 bits each: a prefix trie, in which classes equal in the first d minima are a node of depth d. Two sets
of similarity s share a node of depth d with probability s**d.

How long a prefix must match is settled for each class and tree from the sizes of the nodes. A prefix is shortened, from DEEPEST minima on, as long
as its node holds at most `small` classes, down to SHORTEST. Where that leaves a class with less than the target recall for a partner at the threshold,
1 - product over trees of (1 - s**depth), its prefixes are shortened further, cheapest first by added classes for recall gained, until the target is met.
A node that one class needs is opened for all classes in it, so every class is in one node of each tree: its bucket there. Sizes below `small` don't
decide anything, so that a pair's own presence can't; where all nodes are small, every prefix has SHORTEST minima.

No pairs of a bucket become rows. Buckets of two are a pair each; larger ones are cut into blocks by a hash, and
pairs of blocks are the units of work. A first pass over bucket codes alone keeps, for each unit, the classes that have a
partner whose first common tree is this one, so each candidate pair is met once; then texts of those classes are
fetched, and all candidate pairs of a unit are verified with exact set intersections. A unit returns counts of links
and a spanning forest of them.

A null text is empty; texts without words have no set, belong to a class of their own and link with nothing. Repeated
rows are documents of their own, and so are different texts of one id. Rows without an id link like others; where no row of a class has an id,
its class_id is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, ship
from .components import components, local_roots
from .textcodes import Texts, mix, runs_of_words, slices, words

NGRAM, SIMILARITY = 5, 0.8
TREES, SHORTEST, DEEPEST, RECALL = 20, 4, 8, 0.999
SMALL = 64
BLOCK = 384


def depths(sizes: np.ndarray, similarity: float, recall: float, small: int, shortest: int = SHORTEST) -> np.ndarray:
    """How many minima must match, by class and tree; sizes: of the nodes at depths shortest, shortest + 1, ... by class and tree."""
    longest = sizes.shape[2] - 1
    at = np.where((sizes <= small).any(2), (sizes <= small).argmax(2), longest)
    miss = np.log1p(-(similarity ** (shortest + np.arange(longest + 1))))  # logarithm of a tree's chance to miss, by depth
    while True:
        bad = np.flatnonzero((miss[at].sum(1) > np.log(1 - recall)) & (at > 0).any(1))
        if not len(bad):
            return at + shortest
        d = at[bad]
        up = np.maximum(d - 1, 0)
        added = np.take_along_axis(sizes[bad], up[..., None], 2)[..., 0] - np.take_along_axis(sizes[bad], d[..., None], 2)[..., 0]
        price = np.where(d > 0, added / np.maximum(miss[d] - miss[up], 1e-12), np.inf)
        at[bad, price.argmin(1)] -= 1


def sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run codes of each text, sorted, one text after another, and their bounds."""
    codes, bounds = runs_of_words(words(texts), n)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    codes, of = codes[new], of[new]
    return codes, np.searchsorted(of, np.arange(len(bounds)))


def set_keys(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (0 for an empty one)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)).view(np.int64)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240301))
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def labels(codes: np.ndarray, bounds: np.ndarray, trees: int) -> np.ndarray:
    """For each non-empty set and tree: DEEPEST minima of 16 bits in two integers, the first minimum highest."""
    factor, plus = (x.astype(np.uint32) for x in _factors(trees * DEEPEST))
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), trees, 2), np.uint64)
    if not len(starts):
        return out.view(np.int64)
    low = (codes >> np.uint64(32)).astype(np.uint32)
    for i in range(trees * DEEPEST):
        least = np.minimum.reduceat(low * factor[i] + plus[i], starts).astype(np.uint64)
        t, d = divmod(i, DEEPEST)
        out[:, t, d // 4] |= (mix(least + np.uint64(i)) >> np.uint64(48)) << np.uint64(48 - 16 * (d % 4))
    return out.view(np.int64)


def nodes(label: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Codes of the nodes at these depths (one for each class and tree) that hold these labels."""
    high, low = label.view(np.uint64)[..., 0], label.view(np.uint64)[..., 1]
    cut_at = lambda x, d: np.where(d > 0, x >> np.uint64(16) * (4 - np.clip(d, 1, 4)).astype(np.uint64), np.uint64(0))
    return mix(mix(cut_at(high, depth) * np.uint64(0xD1342543DE82EF95) + depth.astype(np.uint64)) + cut_at(low, depth - 4)).view(np.int64)


_SKETCH = "doc_id long, row long, key long, size long, labels array<long>"


def _sketch(n: int, trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, size, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in slices(batch.column(2)):
                codes, bounds = sets(part, n)
                keys.append(set_keys(codes, bounds))
                size.append(np.diff(bounds))
                got = np.zeros((part.hi - part.lo, trees, 2), np.int64)
                got[size[-1] > 0] = labels(codes, bounds, trees)
                found.append(got.ravel())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees * 2), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(keys)), pa.array(np.concatenate(size), pa.int64()), flat], names=["doc_id", "row", "key", "size", "labels"])

    return run


def _labels_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("labels")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, 2)


def _nodes_from(first: int, last: int, trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of classes: their nodes at depths first to last, as array<long> by tree and depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = _labels_of(batch)
            got = np.stack([nodes(label, np.full(label.shape[:2], d)) for d in range(first, last + 1)], 2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees * (last - first + 1)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["key", "nodes"])

    return run


def _wanted_depths(similarity: float, recall: float, small: int, trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of classes in large nodes, with sizes of their nodes by tree and depth: the depth that each needs in each tree."""
    width = DEEPEST - SHORTEST + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.ones((batch.num_rows, trees * width), np.int64)
            found = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            place, n = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
            sizes[row, place] = n
            need = depths(sizes.reshape(batch.num_rows, trees, width), similarity, recall, small)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees), pa.array(need.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["key", "depths"])

    return run


def _chosen(trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of classes with their depths: key and the codes of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column(batch.schema.get_field_index("depths")).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees)
            got = nodes(_labels_of(batch), depth)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["key", "heads"])

    return run


def forest(reps: DataFrame, similarity: float, trees: int, recall: float, small: int) -> DataFrame:
    """key and heads, the codes of its buckets by tree, of classes (key, labels)."""
    width = DEEPEST - SHORTEST + 1
    top = reps.select("key", "labels").mapInArrow(_nodes_from(SHORTEST, SHORTEST, trees), "key long, nodes array<long>")
    short = top.select("key", F.posexplode("nodes").alias("tree", "node"))
    large = cut(short.groupBy("tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > small).select("tree", "node"))
    # classes in large nodes: sizes of all their nodes, those of one class left out
    hot = cut(short.join(large, ["tree", "node"], "left_semi").select("key").distinct().join(reps.select("key", "labels"), "key"))
    below = hot.mapInArrow(_nodes_from(SHORTEST, DEEPEST, trees), "key long, nodes array<long>").select("key", F.posexplode("nodes").alias("place", "node"))
    whole = short.select((F.col("tree") * width).alias("place"), "node").unionByName(below.where(F.col("place") % width > 0).select("place", "node"))
    sizes = whole.groupBy("place", "node").agg(F.count("*").alias("n")).where("n > 1")
    measured = below.join(sizes, ["place", "node"]).groupBy("key").agg(F.collect_list(F.struct("place", F.col("n").cast("int"))).alias("sizes"))
    need = cut(measured.mapInArrow(_wanted_depths(similarity, recall, small, trees), "key long, depths array<int>"))
    # the node of the least depth that any class of a node of depth SHORTEST needs, on each class's own path
    wanted = below.select("key", F.floor(F.col("place") / width).cast("int").alias("tree"), (F.col("place") % width + SHORTEST).cast("int").alias("depth"), "node")
    opened = wanted.join(need.select("key", F.posexplode("depths").alias("tree", "depth")), ["key", "tree", "depth"]).select("tree", "depth", "node").distinct()
    chosen = wanted.join(opened, ["tree", "depth", "node"]).groupBy("key", "tree").agg(F.min("depth").alias("depth"))
    by_key = chosen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "depth"))), lambda x: x["depth"]).alias("depths"))
    deep = hot.join(by_key, "key").select("key", "labels", "depths").mapInArrow(_chosen(trees), "key long, heads array<long>")
    return deep.unionByName(top.join(hot.select("key"), "key", "left_anti").select("key", F.col("nodes").alias("heads")))


def _units(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that consecutive rows equal in the named columns are in one, small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 2048 and sum(x.nbytes for x in held) < 1 << 24:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = rows.num_rows
        keys = [rows.column(x).to_numpy(zero_copy_only=False) for x in names]
        differs = np.zeros(last - 1, bool)
        for k in keys:
            differs |= k[1:] != k[:-1]
        edge = np.flatnonzero(differs)
        if not len(edge):
            held = [rows]
            continue
        yield rows.slice(0, int(edge[-1]) + 1)
        held = [rows.slice(int(edge[-1]) + 1)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bounds(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    differs = np.zeros(rows.num_rows - 1, bool)
    for x in names:
        k = rows.column(x).to_numpy(zero_copy_only=False)
        differs |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1, [rows.num_rows]])


def candidate_pairs(heads: np.ndarray, size: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that are met here: first common tree, sizes that allow the similarity, and one from either side."""
    i, j = [], []
    both = left & right  # a block with itself: every pair once
    for a in range(len(heads)):
        ok = (heads[:, tree] == heads[a, tree]) & (np.minimum(size, size[a]) >= similarity * np.maximum(size, size[a]) - 1e-9)
        ok &= np.arange(len(heads)) > a if both.all() else (right & ~left if left[a] and not right[a] else np.zeros(len(heads), bool))
        b = np.flatnonzero(ok)
        if tree and len(b):
            b = b[~(heads[b, :tree] == heads[a, :tree]).any(1)]
        if len(b):
            i.append(np.full(len(b), a))
            j.append(b)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def common_counts(codes: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    n = len(bounds) - 1
    if len(i) <= 3 * n:
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = codes[bounds[a] : bounds[a + 1]], codes[bounds[b] : bounds[b + 1]]
            at = np.searchsorted(y, x)
            out[k] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        return out
    distinct, column, count = np.unique(codes, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    met = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        met += m @ m.T
    return met[i, j].astype(np.int64)


_UNIT = ["tree", "bucket", "a", "b"]


def _needed(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of units of classes with signatures: the classes that take part in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches, _UNIT):
            at = _bounds(rows, _UNIT)
            heads = rows.column("heads").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            size, tree = rows.column("size").to_numpy(), rows.column("tree").to_numpy()
            left, right = rows.column("left").to_numpy(zero_copy_only=False), rows.column("right").to_numpy(zero_copy_only=False)
            need = np.zeros(rows.num_rows, bool)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1:
                    i, j = candidate_pairs(heads[lo:hi], size[lo:hi], int(tree[lo]), left[lo:hi], right[lo:hi], similarity)
                    need[lo + i] = need[lo + j] = True
            yield rows.filter(pa.array(need)).select([*_UNIT, "left", "right", "key"])

    return run


def _verified(n: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of units with texts: links of each class, weighted by copies, and the smallest class that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches, _UNIT):
            at = _bounds(rows, _UNIT)
            heads = rows.column("heads").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            key, size, copies, tree = (rows.column(x).to_numpy() for x in ("key", "size", "copies", "tree"))
            left, right = rows.column("left").to_numpy(zero_copy_only=False), rows.column("right").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            parts = [sets(x, n) for x in slices(rows.column("text"))]
            all_codes = np.concatenate([c for c, _ in parts])
            all_bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
            right_text = np.concatenate([set_keys(c, b) for c, b in parts]) == key  # an id may have several texts
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                r = lo + np.flatnonzero(right_text[lo:hi])
                r = r[np.unique(key[r], return_index=True)[1]]
                if len(r) < 2:
                    continue
                codes = np.concatenate([all_codes[all_bounds[x] : all_bounds[x + 1]] for x in r.tolist()])
                bounds = np.concatenate([[0], np.cumsum(np.diff(all_bounds)[r])])
                i, j = candidate_pairs(heads[r], size[r], int(tree[lo]), left[r], right[r], similarity)
                both = common_counts(codes, bounds, i, j)
                ok = both >= similarity * (size[r][i] + size[r][j] - both) - 1e-9
                i, j = i[ok], j[ok]
                count = np.zeros(len(r), np.int64)
                np.add.at(count, i, copies[r][j])
                np.add.at(count, j, copies[r][i])
                root = key[r][local_roots(len(r), i, j)]  # keys are sorted
                some = count > 0
                out.append((key[r][some], count[some], root[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in range(3)], names=["key", "links", "root"])

    return run


def _row(id_column: Column, text: Column) -> Column:
    """Rows equal in id and text share it."""
    return F.xxhash64(id_column.cast("string"), F.lit(1), text)


def _classified(documents: DataFrame, n: int, similarity: float, trees: int, recall: float, block: int, small: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, row, key, size), and classes of equal sets (key, class_id, n_links, copies, keeper: the row that stands for all it is linked with)."""
    ship(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), "text")
    sketch = cut(slim.mapInArrow(_sketch(n, trees), _SKETCH))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    reps = cut(sketch.where("size > 0").groupBy("key").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("labels").alias("labels")))
    heads = cut(forest(reps, similarity, trees, recall, small))
    reps = reps.drop("labels")

    grown = heads.select("key", F.posexplode("heads").alias("tree", "bucket"))
    counted = cut(grown.groupBy("tree", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("k1"), F.max("key").alias("k2")).where("n > 1"))
    # a pair may be alone together in several trees; the first of them is the only one that can be its first common tree
    pairs = counted.where("n = 2").groupBy("k1", "k2").agg(F.min(F.struct("tree", "bucket")).alias("at"))
    few = pairs.select("at.tree", "at.bucket", F.explode(F.array("k1", "k2")).alias("key")).select("tree", "bucket", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(True).alias("left"), F.lit(True).alias("right"), "key")
    large = counted.where("n > 2").select("tree", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = grown.join(large, ["tree", "bucket"]).join(reps.select("key", "size"), "key").join(heads, "key")
    mine = F.pmod(F.xxhash64("key", "tree"), F.col("blocks")).cast("int")
    members = members.withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = members.select("tree", "bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "key", "size", "heads")
    shape = "tree int, bucket long, a int, b int, left boolean, right boolean, key long"
    needed = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_needed(similarity), shape)
    work = cut(few.unionByName(needed))

    wanted = work.select("key").distinct().join(reps, "key").join(heads, "key").select("key", F.col("first.row").alias("row"), "size", "copies", "heads")
    texts = slim.select("row", "text").join(wanted, "row").dropDuplicates(["key"])
    fetched = work.join(texts, "key").select(*_UNIT, "left", "right", "key", "size", "copies", "heads", "text")
    found = cut(fetched.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_verified(n, similarity), "key long, links long, root long"))

    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    named = reps.select("key", "first", "copies").join(total, "key", "left").join(tree, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("first").alias("of"))
    named = named.join(smallest, "component").select("key", F.col("of.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", F.col("of.row").alias("keeper"))
    return sketch.select("doc_id", "row", "key", "size"), named


def classes(documents: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest doc_id reachable by links), n_links (other documents linked directly) and copies (documents of an equal set, itself included)."""
    sketch, named = _classified(documents, n, similarity, trees, recall, block, small, id_col, text_col)
    worded = sketch.where("size > 0").select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "n_links", "copies")
    wordless = sketch.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return worded.unionByName(wordless)


def deduplicate(documents: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, with all its columns, of each group of linked documents: that with the smallest id (rows without one come last).

    Of rows equal in id and text one stays, whichever. Different texts of one id are told apart. Texts without words stay.
    """
    sketch, named = _classified(documents, n, similarity, trees, recall, block, small, id_col, text_col)
    kept = named.select("keeper").distinct().unionByName(sketch.where("size = 0").select(F.col("row").alias("keeper")).distinct()).withColumnRenamed("keeper", "__kept")
    row = free(documents, "__row")
    keyed = documents.withColumn(row, _row(F.col(id_col).cast("long"), F.col(text_col)))
    return keyed.join(kept, keyed[row] == kept["__kept"], "left_semi").dropDuplicates([row]).select(*documents.columns)
