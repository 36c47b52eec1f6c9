"""Cells of ranks are cut once: quantiles that come out differently each time they are asked for change no rank."""

import random

from pyspark.sql import functions as F

from rankloom.operators import metrics, score


def test_ranks_do_not_depend_on_edges(spark, monkeypatch):
    exact = F.percentile_approx
    shaken = F.udf(lambda e: sorted(x + random.SystemRandom().uniform(-300, 300) for x in e), "array<double>").asNondeterministic()
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda v, shares, accuracy: shaken(exact(F.col(v).cast("double"), shares, accuracy)))
    monkeypatch.setattr(score, "cells_for", lambda df, keys: 64)
    df = spark.range(2000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 997).cast("double").alias("activity_score"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model_route")).repartition(3).cache()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {int(r["record_id"]): r for r in score.ranked(df, allow_mixed=True).collect()}
        ranks = {r["id"]: r["r"] for r in metrics.average_rank(spark.range(2000).select("id", F.lit(0).alias("k"), (F.col("id") * 7 % 2000).cast("double").alias("v")).cache(), ["k"], "v", "r", cells=8).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    value, route = {i: i % 997 for i in range(2000)}, {i: i % 3 == 0 for i in range(2000)}
    for i in range(2000):
        assert got[i]["activity_rank"] == 1 + sum(value[j] > value[i] for j in value)
        assert got[i]["rank_within_route"] == 1 + sum(value[j] > value[i] and route[j] == route[i] for j in value)
        assert ranks[i] == 1 + i * 7 % 2000
