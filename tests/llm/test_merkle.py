"""Manifests against trees built level by level in plain Python."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out += [x for k, x in enumerate(level[a : a + fanout], a) if k != i]
        i //= fanout
    return "".join(out)


def expected(rows, fanout):
    """rows: (id, group, leaf, changed)."""
    key = lambda x: (x is not None, x.encode() if isinstance(x, str) else x)
    groups = sorted({r[1] for r in rows}, key=key)
    held = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (key(r[0]), r[2])) for g in groups}
    trees = {g: tree([r[2] for r in rs], fanout) for g, rs in held.items()}
    top = tree([trees[g][-1][0] for g in groups], fanout)
    root, out = top[-1][0], []

    def climb(levels, i, node):
        for level in levels[:-1]:
            a = i // fanout * fanout
            node = h(*(node if k == i else x for k, x in enumerate(level[a : a + fanout], a)))
            i //= fanout
        return node

    for n, g in enumerate(groups):
        for i, (doc, _, leaf, changed) in enumerate(held[g]):
            proof = siblings(trees[g], i, fanout) + siblings(top, n, fanout)
            end = climb(top, n, climb(trees[g], i, changed or leaf))
            out.append((doc, leaf, trees[g][-1][0], root, h(proof), end, end == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(8, 1, [700, 1, 9]), (2, 2, [1, 2, 3, 4, 5, 37, 64]), (3, 1, [100] + [1] * 11), (8, 4, [60]), (2, 1, [33])])
def test_manifest(spark, fanout, levels, sizes):
    rng = random.Random(fanout * 100 + levels)
    names = [None, "é", "zz", "Z", "", "en", "中", *(f"g{i}" for i in range(20))]
    rows = [(rng.choice([None, rng.randrange(10**6), 7]), g, rng.choice([None, "", "Text É A", "text é a", "B" * 50])) for g, n in zip(names, sizes) for _ in range(n)]
    docs = spark.createDataFrame([(d, g, t, 1, "x", 2) for d, g, t in rows], "doc_id long, lang string, text string, total int, leaf string, part int").repartition(4)
    later = lambda df: F.when(F.col("doc_id") % 2 == 0, merkle.digest(F.col("doc_id"), F.col("lang"), F.lower("text")))
    got = merkle.manifest(docs, ["doc_id", "lang", "text"], changed=later, levels=levels, fanout=fanout).collect()
    known = [(d, g, leaf_of(d, g, t), leaf_of(d, g, t and t.lower()) if d is not None and d % 2 == 0 else None) for d, g, t in rows]
    assert sorted((tuple(r) for r in got), key=str) == expected(known, fanout)
    assert {r["verified"] for r in got} == {True, False} or len(rows) < 3


def test_butterfly_gives_each_partition_the_whole_way(spark):
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 26, 27, 28, 61):
        nodes = [h(str(i)) for i in range(n)]
        got = merkle.butterfly(spark.createDataFrame([("g", i, n, x) for i, x in enumerate(nodes)], "grp string, partition long, total long, node string"), 3).collect()
        levels = tree(nodes, 3)
        assert sorted((r["partition"], r["node"], r["proof"]) for r in got) == [(i, levels[-1][0], siblings(levels, i, 3)) for i in range(n)]


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(50)) for _ in range(500)]
    got = merkle.numbered(spark.createDataFrame(rows, "g string, x long").repartition(7), "g", "x").collect()
    for g in (None, "a", "b"):
        mine = sorted((r["place"], r["x"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for k, x in rows if k == g)
        assert {r["total"] for r in got if r["g"] == g} == {len(mine)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, lang string, text string")
    assert merkle.manifest(docs, ["doc_id", "text"]).collect() == []


@pytest.mark.parametrize("name", ["op11_kruskal_runs", "op13_butterfly"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns, want = [c[0] for c in want.description], want.fetchall()
    got = queries.queries()[name](spark, sf)
    assert sorted(map(str, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(str, map(list, want))) and sorted(columns) == sorted(got.columns)
