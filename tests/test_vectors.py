"""Vectors made by expressions are those assembled from a long table of values."""

from pyspark.sql import functions as F

from rankloom.functions.sequences import normalize_key
from rankloom.operators import design, features


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "ACGTA", "ACGTT", 2.0, 0.0, "x"), (2, "AC-TA", "ACGT", None, 3.5, None), (3, "TTTTT", "T" * 25, 0.0, 0.0, "other")], "record_id long, crRNA_sequence string, target_aligned_25 string, a double, b double, m string")
    fit = F.col("record_id") < 3
    long = rows.select("record_id", "a", "b").unpivot(["record_id"], ["a", "b"], "feature", "value")
    pair = features.pair_onehot(rows).select("record_id", F.format_string("%02d_%s", "position", "pair").alias("feature"), F.lit(1.0).alias("value"))
    flag = rows.select("record_id", F.concat(F.lit("m="), normalize_key("m")).alias("feature"), F.lit(1.0).alias("value"))
    matrix = features.context_matrix([("n", long), ("pair", pair), ("onehot", flag)])
    columns = features.matrix_columns(matrix.where(fit))
    want = {r["record_id"]: (r["indices"], r["values"]) for r in design.assemble(features.numbered_matrix(matrix, columns)).collect()}

    made = features.aligned(rows).withColumn("pairs", features.pair_array())
    met = [f"{r['at'] + 1:02d}_{r['x']}" for r in made.where(fit).select(F.posexplode("pairs").alias("at", "x")).distinct().collect()]
    names = design.matrix_names([("n", ["b", "a"]), ("pair", met), ("onehot", ["m=x", "m=missing"])])
    assert names == [r["feature"] for r in columns.orderBy("column").collect()]
    out = design.vectors(made, names, {"n": ["a", "b"]}, {"pair": "pairs"}, {"onehot": ["m"]}, ["record_id"])
    assert {r["record_id"]: (r["indices"], r["values"]) for r in out.collect()} == want
    assert out._jdf.queryExecution().toString().count("Exchange") == made._jdf.queryExecution().toString().count("Exchange")  # nothing is shuffled
