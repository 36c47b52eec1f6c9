"""Cells of ranks."""

import random

from pyspark.sql import functions as F

from rankloom.operators import metrics


def test_cells_are_found_by_runs_of_edges(spark):
    """A value's cell is the number of edges below it, at any number of cells."""
    rng = random.Random(13)
    df = spark.createDataFrame([(i % 2, rng.choice([float(rng.randrange(40)), rng.random() * 40])) for i in range(3000)], "k int, v double").cache()
    for cells in (2, 16, 17, 18, 33, 64):
        edges = {r["k"]: r["e"] for r in df.groupBy("k").agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 20 * cells).alias("e")).collect()}
        got = metrics._cells(df, ["k"], "v", F.lit(1), cells)
        assert "__whole" in got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.collect()
        assert len(rows) == 3000 and all(r["__cell"] == sum(e < r["v"] for e in edges[r["k"]]) for r in rows)
