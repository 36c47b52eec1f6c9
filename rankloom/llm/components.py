"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b) that aren't the smallest of their component.

    Each round links the neighbours of every node to the smallest of them, first those larger than the node, then
    those smaller; edges never grow in number, and after about as many rounds as the logarithm of the longest
    path every node is linked to its component's smallest node alone, which `unsettled` tells. Minima are taken before rows are shuffled, so a node
    with very many edges isn't a task of its own; only a count comes to the driver. Loops and null ends
    are no edges.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        if not unsettled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def unsettled(e: DataFrame) -> int:
    """How many nodes of edges (u, v), u > v, are linked to several smaller ones, or to one that is itself linked to a smaller one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def local_roots(n: int, a, b):
    """The smallest index that each of n points reaches over pairs (a, b), in numpy."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
