"""What reviews found: results that differed from SQL, and steps that grew faster than their input."""

import hashlib
import itertools
import random
from decimal import Decimal

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rankloom.functions import sequences
from rankloom.functions.sequences import nearest6
from rankloom.operators import mapping, resample, score, select
from rankloom.operators.arrays import ARRAY_ROWS, digits, hashed_texts
from rankloom.plans import fixtures


def test_sixth_place_of_blends_as_in_sql(spark):
    rng = random.Random(4)
    rows = [(i, round(-2.5 - 0.1 * rng.randrange(5), 6), round(rng.uniform(-3.5, -1.5), 6), round(rng.uniform(-3.5, -1.5), 6)) for i in range(20000)]
    df = spark.createDataFrame(rows, "i int, d double, b double, c double")
    value = F.lit(0.0) + 0.2 * F.col("d") + 0.47 * F.col("b") + 0.33 * F.col("c")
    got = df.select("i", nearest6(value).alias("v"), F.round(value, 6).alias("other")).toPandas()
    con = duckdb.connect()
    con.register("rows_", df.toPandas())
    want = con.execute("select i, round(0.2 * d + 0.47 * b + 0.33 * c, 6) v from rows_").df().set_index("i")["v"]
    assert (got.set_index("i")["v"] == want).all() and (got.set_index("i")["other"] != want).any()


def test_share_of_a_decimal_component_is_exact(spark):
    df = spark.createDataFrame([(0, -2.0, -2.5), (2, -2.123456, -2.7), (5, -1.9, -3.0)], "i int, b double, c double").withColumn("d", F.lit(Decimal("-2.5")) - F.lit(Decimal("0.1")) * F.col("i"))
    got = [r["v"] for r in df.select("i", score.blend(score.FULL_WEIGHTS).alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("select 0.2 * (-2.5 - 0.1 * i) + 0.47 * b + 0.33 * c from (values (0, -2.0::double, -2.5::double), (2, -2.123456, -2.7), (5, -1.9, -3.0)) t(i, b, c) order by i").fetchall()]
    assert got == want


def test_templates_are_dealt_out_before_their_windows(spark, tmp_path):
    """A table of one file is one partition; its templates have a hundred windows each."""
    spark.range(0, 4000).selectExpr("id p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 400).selectExpr("id event_id", "cast(id % 60 as double) value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert fixtures.load(spark, str(tmp_path), "templates").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    one = spark.createDataFrame([(i, "g", "ACGT" * 10) for i in range(20)], "template_no int, template_group_id string, template_sequence_clean string").coalesce(1)
    hits = mapping.all_hits(spark.createDataFrame([("ACGT" * 6,)], "target string"), one)
    assert hits.where("match_mode = 'exact_acgt'").count() == 20 * 5 * 2  # ACGT is its own reverse complement


def test_spellings_by_stretches(spark):
    codes = {k: list(v) for k, v in sequences.IUPAC.items()}
    rng = random.Random(2)
    texts = ["", "A", "N", "ACGT", "RN", "ACXG", "-"] + ["".join(rng.choice("ACGTACGTACGTRYN") for _ in range(8)) for _ in range(40)]
    got = {r["t"]: (r["n"], r["s"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", mapping.spellings(F.col("t")).alias("n"), mapping.spell(F.col("t")).alias("s")).collect()}
    for t in texts:
        want = ["".join(x) for x in itertools.product(*[codes.get(c, []) for c in t])]
        assert got[t][0] == (len(want) if t else 0), t
        assert got[t][0] == 0 or sorted(got[t][1]) == sorted(want)


def test_hashes_in_tasks_are_those_of_md5():
    rng = random.Random(1)
    texts = [[bytes(rng.randrange(256) for _ in range(n)) for _ in range(9)] for n in (0, 1, 25, 54, 55, 56, 63, 64, 119, 200)]
    got = hashed_texts("7|swap|3|", [np.frombuffer(b"".join(t), np.uint8).reshape(9, -1) for t in texts])
    assert [g.tolist() for g in got] == [[int(hashlib.md5(b"7|swap|3|" + x).hexdigest()[:8], 16) for x in t] for t in texts]
    assert [[bytes(r).decode() for r in d] for d in digits(112)] == [list(map(str, r)) for r in (range(10), range(10, 100), range(100, 112))]


def test_draws_and_swaps_are_not_shuffled(spark):
    """Draws made in tasks are those of the table of draws; nothing with as many rows as draws times groups is exchanged."""
    rows = [(m, f"r{i}", f"g{i % 230}é" if i % 7 else "g", float(i % 5), float((i * k) % 11)) for m, k in (("a", 3), ("b", 7)) for i in range(1500)]
    df = spark.createDataFrame(rows, "model_id string, record_id string, group_id string, y_true double, y_pred double").cache()
    groups = resample.numbered_groups(df)
    want = {}
    for r in resample.cluster_draws(groups, 6, 9).collect():
        want.setdefault(r["draw"], {})[r["g"]] = r["multiplicity"]
    n = groups.count()
    assert {d: {g: int(t) for g, t in enumerate(w) if t} for d, w in resample.drawn_groups(9, range(6), n)} == want
    assert "multiplicity" not in resample.bootstrap_metrics(df, 6, 9)._jdf.queryExecution().optimizedPlan().toString()
    one, two = (resample.swap_test(df, "a", "b", 12, 9, most=m).first() for m in (10**6, 1))
    assert one["p_value"] == two["p_value"] and abs(one["observed_delta"] - two["observed_delta"]) < 1e-12 and one["total_draws"] == 12


def test_a_grid_of_a_large_fold_stays_in_arrays(spark):
    """Some five million rows of a fold, as 1 GB has, are no table of rows and candidates; folds that are null count too."""
    assert ARRAY_ROWS > 4_800_000
    df = spark.createDataFrame([(None if i % 2 else 1, float(i % 7), float(i % 5), float(i % 3)) for i in range(60)], "f int, y double, a double, b double")
    grid = select.simplex_grid(spark, 2, 0.5)
    one = select.score_grid(df, grid, ["a", "b"], "f", "y")
    assert {r["f"]: r["n"] for r in one.collect()} == {None: 30, 1: 30}
    pandas = df.toPandas()
    for r in one.collect():
        part = pandas[pandas["f"].isna() if r["f"] is None else pandas["f"] == r["f"]]
        p = r["w1"] * part["a"] + r["w2"] * part["b"]
        assert abs(r["SCC"] - part["y"].rank().corr(p.rank())) < 1e-12 and abs(r["PCC"] - part["y"].corr(p)) < 1e-12
