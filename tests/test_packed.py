"""Keys that go to tasks as arrays: few bytes a row, few passes a draw."""

import numpy as np
import pyarrow as pa

from rankloom.operators import arrays


def test_millionths_take_half_the_bytes():
    rng = np.random.default_rng(2)
    for x, size in ((np.round(rng.normal(size=1000) * 5, 6), 4), (rng.normal(size=1000), 8), (np.array([1e9, -2.5, 0.1]), 8), (np.array([np.nan, 0.5]), 8), (np.zeros(0), 4)):
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x), pa.array(np.arange(len(x), dtype=np.int32))], names=["k", "x", "n"])
        made = pa.Table.from_batches(list(arrays.packed(iter([batch, batch]))) or [batch.slice(0, 0)])
        if len(x):
            assert all(len(b) == size * len(x) + 1 for b in made["x"].to_pylist())
            assert np.array_equal(arrays.unpacked(made["x"], np.float64), np.tile(x, 2), equal_nan=True)
            assert np.array_equal(arrays.unpacked(made["n"], np.int32), np.tile(np.arange(len(x)), 2))


def test_six_gb_of_rows_are_no_rows_times_draws():
    rows = 360 * 80_028  # fit pairs of 360 times sf0.1
    assert rows <= arrays.DRAW_ROWS and rows <= arrays.ARRAY_ROWS


def test_sums_by_place():
    rng = np.random.default_rng(3)
    at, x = np.sort(rng.integers(0, 50, 700)).astype(np.int32), rng.normal(size=700)
    got = arrays.Runs(at, 60, 64).sums(lambda lo, hi: (x[lo:hi], np.ones(hi - lo)), 2)
    assert np.allclose(got[0], np.bincount(at, x, 60)) and (got[1] == np.bincount(at, minlength=60)).all()


def test_wide_predictions_and_families(spark, monkeypatch):
    """Predictions that 64 bits with a label's place don't hold are ranked too; families are one grid, those of equal weights included, and a policy scores them once."""
    from pyspark.sql import functions as F

    from rankloom.operators import metrics, select

    df = spark.range(400).select((F.col("id") % 4).cast("int").alias("inner_fold"), F.col("id").alias("record_id"), ((F.col("id") * 37) % 101 / 10).alias("y_true"), *[((F.col("id") * m) % 97 * s).alias(n) for n, m, s in (("D_xgb", 5, 0.1), ("D_lightgbm", 7, 0.2), ("D_mlp", 11, 0.1), ("B", 13, 0.1), ("C", 17, 1e12), ("SEQ_MAPPING_XGB", 19, 0.1))]).cache()
    made = df.withColumn("D", F.col("D_xgb"))
    got = {(r["family"], r["inner_fold"]): r for r in select.family_scores(made, (1.0, 0.0), (0.2, 0.5, 0.3)).collect()}
    value = {"D": F.col("D"), "SEQ_MAPPING_XGB": F.col("SEQ_MAPPING_XGB"), "D_B": F.col("D"), "D_B_C": 0.2 * F.col("D") + 0.5 * F.col("B") + 0.3 * F.col("C")}
    assert len(got) == 16
    for f, v in value.items():
        for r in metrics.five_metrics(made.withColumn("y_pred", F.round(v, 9)), ["inner_fold"]).collect():
            assert all(abs(got[f, r["inner_fold"]][m] - r[m]) <= 1e-9 * max(1, abs(r[m])) for m in metrics.METRICS), (f, r)
    calls, whole = [], select.family_scores
    monkeypatch.setattr(select, "family_scores", lambda *a: calls.append(a) or whole(*a))
    policy, family = select.policy_and_family(df.drop("C").withColumn("C", F.col("B") * 0.5), 0.5)
    assert policy.first()["family"] == family.first()["family"] and family.first()["mean_MAE"] > 0 and len(calls) == 1
