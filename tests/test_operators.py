"""Tiny vectors and metamorphic cases; whole queries are held against SQL in test_queries.py."""

import random
import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import features, groups, history, mapping, metrics, models, quality, resample, score, select
from rankloom.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_metrics_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0)], "model_id string, y_true double, y_pred double")
    for cells in (1, 8):
        got = {r["model_id"]: r for r in metrics.five_metrics(df, ["model_id"], cells=cells).collect()}
        assert got["a"]["SCC"] == pytest.approx(0.8333333, abs=1e-6)
        assert got["b"]["SCC"] is None and got["b"]["PCC"] is None and got["b"]["RMSE"] is not None
        assert got["c"]["SCC"] is None and got["c"]["R2"] is None and got["c"]["n"] == 1


def test_weighted_rank_equals_expanded_rank(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 1.0, 2), (0, 2.0, 1), (0, 4.0, 0)], "k int, v double, w int")
    got = {(r["v"], r["w"]): r["r"] for r in metrics.average_rank(df, ["k"], "v", "r", "w").collect()}
    assert got[1.0, 1] == got[1.0, 2] == 2.0 and got[2.0, 1] == 4.0


def test_holm_keeps_missing_tests_in_the_family(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.03)], "test_id string, p_value double")
    got = {r["test_id"]: r["p_holm"] for r in resample.holm(df, family_size=4).collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] is None and got["c"] == pytest.approx(0.09)


def test_interval_needs_enough_valid_draws(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (3.0,)], "v double")
    r = resample.percentile_interval(df.withColumn("k", F.lit(0)), ["k"], "v").first()
    assert r["lower"] is None and r["status"] == "insufficient_valid_draws" and r["valid_draws"] == 3


def test_swap_of_a_model_with_itself(spark):
    p = spark.createDataFrame([(str(i), f"g{i % 5}", m, float(i), float(i % 7)) for i in range(40) for m in "ab"], "record_id string, group_id string, model_id string, y_true double, y_pred double")
    r = resample.swap_test(p, "a", "b", 20, 1).first()
    assert r["observed_delta"] == pytest.approx(0) and r["p_value"] == pytest.approx(1.0)


def test_leave_one_out_ignores_own_label(spark):
    base = [("r1", "G", "exact", "exact", "no_gap", 1.0), ("r2", "G", "exact", "exact", "no_gap", 2.0), ("r3", "H", "nonexact", "one", "gap", 3.0)]
    schema = "record_id string, guide string, exactness string, diffcat string, gapcat string, label double"
    a = history.leave_one_out(spark.createDataFrame(base, schema)).where("record_id = 'r1'").drop("label").first()
    changed = [(*base[0][:-1], 1001.0), *base[1:]]
    b = history.leave_one_out(spark.createDataFrame(changed, schema)).where("record_id = 'r1'").drop("label").first()
    assert a == b


def test_crossfit_ignores_own_fold(spark):
    base = [("r1", "k", 0, 1.0), ("r2", "k", 0, 2.0), ("r3", "k", 1, 3.0), ("r4", "m", 2, 5.0)]
    schema = "record_id string, key string, fold int, label double"
    get = lambda d: rows(history.crossfit(spark.createDataFrame(d, schema), "key").where("fold = 0").select("record_id", "key_te", "key_log_count"))
    assert get(base) == get([("r1", "k", 0, 501.0), *base[1:]])


def test_validation_finds_each_error(spark):
    good = "ACGTACGTACGTACGTACGTACGTA"
    df = spark.createDataFrame([(2, "a", good, good), (3, "a", good, good), (4, " ", good, good), (5, "b", good[:-1] + "N", good), (6, "c", good, good[:-1]), (7, "d", good, "-" * 25), (8, "e", None, good)], "source_row long, record_id string, crRNA_sequence string, target_aligned_25 string")
    errors = quality.validate_pairs(df)
    assert [(r[1], r[2]) for r in sorted(rows(errors), key=lambda r: r[1])] == [(2, "record_id"), (3, "record_id"), (4, "record_id"), (5, "crRNA_sequence"), (6, "target_aligned_25"), (7, "target_aligned_25"), (8, "crRNA_sequence")]
    kept = quality.keep_invalid(df, errors)
    assert kept.count() == 7 and kept.where("status = 'valid'").count() == 0
    assert {r["error"] for r in quality.check_header(df.drop("record_id").withColumn("result_x", F.lit(1))).collect()} == {"Missing required column: record_id", "Input contains a reserved result column"}


def test_joins_that_must_be_one_to_one(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1)], "k string, v int")
    with pytest.raises(ValueError):
        quality.join_one_to_one(a, b, "k")
    with pytest.raises(ValueError):
        quality.assert_unique_key(a.union(a), "k")
    with pytest.raises(ValueError):
        quality.label_leak_guard(a.withColumn("y_true", F.lit(1)))


def test_features_of_gaps_and_unknown_names(spark):
    g = "ACGTACGTACGTACGTACGTACGTA"
    df = spark.createDataFrame([("1", g, g[:12] + "-" + g[13:]), ("2", g.lower(), g.replace("T", "U"))], "record_id string, crRNA_sequence string, target_aligned_25 string")
    got = {r["record_id"]: r for r in features.feature_table(df).collect()}
    assert len(got["1"]) == 189 and got["1"]["gap_count_target"] == 1 and got["1"]["first_difference_position_1based"] == 13 and got["2"]["aligned_difference_count"] == 0 and got["2"]["first_difference_position_1based"] is None
    with pytest.raises(ValueError):
        features.feature_table(df, ["no_such_feature"])


def test_ambiguous_windows_by_spelling_and_by_comparison(spark):
    t = spark.createDataFrame([(1, "g1", "ACGTRACGTTGCANGT"), (2, "g2", "TTTTTTTTTTTTTTTT")], "template_no int, template_group_id string, template_sequence_clean string")
    q = spark.createDataFrame([("ACGTGACG",), ("TTGCATGT",), ("GGGGGGGG",), ("RCGTGACG",)], "target string")
    assert rows(mapping.all_hits(q, t)) == rows(mapping.all_hits(q, t, most=1))
    assert {r["target"] for r in mapping.all_hits(q, t).collect()} == {"ACGTGACG", "TTGCATGT", "RCGTGACG"}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = dict(rows(groups.components(spark.createDataFrame([(str(a).zfill(3), str(b).zfill(3)) for a, b in chain], "a string, b string"))))
    assert set(got.values()) == {"000", "100", "200"} and got["040"] == "000"


def test_folds_are_balanced_and_keep_groups(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(30) for _ in range(i % 7 + 1)], "group_id string")
    a = rows(groups.balanced_group_folds(df))
    loads = [sum(n for _, n, f in a if f == k) for k in range(5)]
    assert max(loads) - min(loads) <= 3 and len(a) == 30
    many = groups.balanced_group_folds(df, most=10)
    assert many.count() == 30


def test_folds_follow_one_rule_at_every_size(spark):
    rng = random.Random(5)
    for trial in range(400):
        k, sizes = rng.randint(1, 6), sorted((rng.choice([1, 1, 2, 3, 7, 50]) * rng.randint(1, 3) for _ in range(rng.randint(0, 120))), reverse=True)
        loads, want = [0] * k, []
        for size in sizes:
            want.append(min(range(k), key=lambda i: (loads[i], i)))
            loads[want[-1]] += size
        cycles = groups._fold_cycles([(x, sizes.count(x)) for x in dict.fromkeys(sizes)], k)
        assert [folds[(n - lo) % len(folds)] for _, lo, hi, folds in cycles for n in range(lo, hi)] == want
    df = spark.createDataFrame([(f"g{i}",) for i in range(300) for _ in range(rng.choice([1, 1, 1, 2, 5, 40]))] + [(None,)] * 3, "group_id string")
    assert rows(groups.balanced_group_folds(df, most=10)) == rows(groups.balanced_group_folds(df))


def test_rank_target_round_trip(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(50)], "id int, label double")
    z = models.rank_target(df)
    back = models.inverse_rank_target(z.select("id", "z"), z)
    assert all(r["y_pred"] == pytest.approx(r["id"] ** 2, abs=1e-9) for r in back.collect())
    middle = z.where("id in (24, 25)").agg(F.sum("z")).first()[0]
    assert abs(middle) < 1e-8


def test_ranks_are_withheld_where_routes_are_mixed(spark):
    df = spark.createDataFrame([("a", 3.0, "r"), ("b", 3.0, "r"), ("c", 1.0, "r"), ("d", 2.0, "s")], "record_id string, activity_score double, model_route string")
    got = {r["record_id"]: (r["rank_within_route"], r["activity_rank"]) for r in score.ranked(df).collect()}
    assert got == {"a": (1, None), "b": (1, None), "c": (3, None), "d": (1, None)}
    assert {r["record_id"]: r["activity_rank"] for r in score.ranked(df, allow_mixed=True).collect()} == {"a": 1, "b": 1, "c": 4, "d": 3}


def test_simplex_grid_sizes(spark):
    assert select.simplex_grid(spark, 3, 0.05).count() == 231 and select.simplex_grid(spark, 2, 0.1, ((0.3, 0.7), (0.35, 0.65))).count() == 12


def test_policy_on_small_folds(spark):
    import random

    rng = random.Random(3)
    data = [(str(i), i % 4, float(i % 13), *[i % 13 + rng.random() * s for s in (3, 2, 9, 4, 5, 6, 9)], True) for i in range(80)]
    df = spark.createDataFrame(data, "record_id string, inner_fold int, y_true double, D_xgb double, D_lightgbm double, D_mlp double, B double, C double, SEQ_MAPPING_XGB double, HISTORY_PRIOR double, mapping_found boolean")
    r = select.select_policy(df, 0.5).first()
    assert math.isclose(r["d_w1"] + r["d_w2"] + r["d_w3"], 1) and r["family"] in {"D", "SEQ_MAPPING_XGB", "D_B", "D_B_C"}
    with pytest.raises(ValueError):
        select.select_policy(df.where("inner_fold < 3"), 0.5)


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text("record_id,crRNA_sequence,extra\n1,ACG,\n2,,x\n")
    df = tables.read_pairs(spark, str(tmp_path / "in.csv"))
    assert rows(df) == [("1", "ACG", ""), ("2", "", "x")]
    tables.write_scores(df, str(tmp_path / "out"), "tsv")
    assert rows(tables.read_pairs(spark, str(tmp_path / "out"), "tsv")) == rows(df)
    m = tables.file_manifest(spark, str(tmp_path / "in.csv"))
    assert tables.verify_manifest(m, m).count() == 0
    assert [r["problem"] for r in tables.verify_manifest(m.withColumn("size", F.col("size") + 1), m).collect()] == ["size"]


def test_state_is_applied_without_labels(spark, tmp_path):
    schema = "record_id string, guide string, exactness string, diffcat string, gapcat string, x double, label double, " + ", ".join(f"{f} string" for f in history.MAPPING_FIELDS)
    fit = spark.createDataFrame([(str(i), f"g{i % 3}", "exact", "exact", "no_gap", float(i), float(i), *["k"] * 6) for i in range(9)], schema)
    history.save_state(str(tmp_path / "s"), fit, ["x"])
    query = spark.createDataFrame([("q", "g0", "exact", "exact", "no_gap", None, *["k"] * 6)], schema.replace(", label double", ""))
    r = history.apply_state(str(tmp_path / "s"), query, ["x"]).first()
    assert r["x"] == 4.0 and r["te_guide_all"] == pytest.approx((0 + 3 + 6 + 0.5 * 4) / 3.5) and r["mapping_te_mapping_status_seen"]


def test_stream_scoring_equals_batch(spark, tmp_path):
    from rankloom.plans import fixtures
    from rankloom.streaming.scoring import encode_stream, write_stream

    pairs = fixtures.load(spark, "/root/testdata/sf0.001", "pairs").limit(60)
    pairs.write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    hist = spark.createDataFrame([("all", static.first()["crRNA_sequence"], "", 3.0, 2)], "reference_type string, guide string, category string, sum double, count long")
    mean = spark.createDataFrame([(1.0,)], "mean double")
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    write_stream(encode_stream(stream, hist, mean), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("record_id", "te_guide_all")) == rows(encode_stream(static, hist, mean).select("record_id", "te_guide_all"))


def test_draws_by_arrays_and_by_windows_agree(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", f"g{i % 17}", m, float(rng.randint(0, 9)), round(rng.gauss(0, 1), 1)) for i in range(120) for m in ("a", "b", "flat")]
    rows = [(r, g, m, float(int(r[1:]) % 7), 1.0 if m == "flat" else p) for r, g, m, _, p in rows]
    df = spark.createDataFrame(rows, "record_id string, group_id string, model_id string, y_true double, y_pred double")
    one = {(r["draw"], r["model_id"]): r for r in resample.bootstrap_metrics(df, 60, 5).collect()}
    two = {(r["draw"], r["model_id"]): r for r in resample.bootstrap_metrics(df, 60, 5, most=10).collect()}
    assert set(one) == set(two) and len(one) == 180
    for k in one:
        for m in metrics.METRICS:
            assert (one[k][m] is None) == (two[k][m] is None) and (one[k][m] is None or one[k][m] == pytest.approx(two[k][m], abs=1e-9)), (k, m)
    assert all(one[d, "flat"]["SCC"] is None for d in range(60))
    a, b = resample.swap_test(df, "a", "b", 70, 5).first(), resample.swap_test(df, "a", "b", 70, 5, most=10).first()
    assert a["observed_delta"] == pytest.approx(b["observed_delta"]) and a["p_value"] == b["p_value"] and a["valid_draws"] == b["valid_draws"] == 70
    assert resample.swap_test(df, "a", "flat", 5, 5).first()["status"] == "undefined_observed_scc"


def test_ranks_in_cells_and_quantiles_are_exact(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([rng.gauss(0, 1), 5.0, 1e9])) for _ in range(500)] + [("b", float(i)) for i in range(7)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in metrics.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.93, 1.0], cells=8).collect()}
    import numpy as np

    for k in "ab":
        assert got[k] == pytest.approx(np.quantile([v for n, v in rows if n == k and v is not None], [0.0, 0.1, 0.5, 0.93, 1.0]).tolist())
    with pytest.raises(Exception, match="not finite"):
        metrics.five_metrics(spark.createDataFrame([("a", 1.0, None)], "m string, y_true double, y_pred double"), ["m"]).collect()


def test_contracts_reject(spark):
    bad = spark.createDataFrame([("r", "A" * 44, "G" * 25), ("s", "A" * 44 + "!", "G" * 25)], "record_id string, target_context_45 string, guide string")
    for i in (0, 1):
        with pytest.raises(Exception, match="45 letters|unsupported"):
            features.iupac_tensor(bad.where(F.col("record_id") == "rs"[i])).collect()
    from rankloom.functions.sequences import template_atoms

    one = spark.createDataFrame([("1; 22 ;",), ("missing",), (None,)], "t string")
    assert [r[0] for r in one.select(template_atoms("t")).collect()] == [[1, 22], [], []]
    with pytest.raises(Exception, match="invalid template number"):
        spark.createDataFrame([("1;x",)], "t string").select(template_atoms("t")).collect()
