"""What works on keys beyond a task gives the same as within one; sources of any size; contracts that refuse."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import mapping, metrics, models, quality, resample, score, select
from rankloom.sources import tables


def test_grid_by_arrays_and_by_windows(spark):
    rng = random.Random(3)
    rows = [(i % 3, round(rng.gauss(0, 1), 2), round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1), 0.5) for i in range(90)] + [(7, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "inner_fold int, y_true double, a double, b double, c double")
    grid = select.simplex_grid(spark, 3, 0.25, ((0.2, 0.47, 0.33),))
    one, two = ({(r["w1"], r["w2"], r["inner_fold"]): r for r in select.score_grid(df, grid, ["a", "b", "c"], most=m).collect()} for m in (10**6, 1))
    assert len(one) == 16 * 4 and one.keys() == two.keys()
    for k in one:
        assert all((one[k][c] is None and two[k][c] is None) or abs(one[k][c] - two[k][c]) < 1e-9 for c in ("n", *metrics.METRICS)), (k, one[k], two[k])
    assert one[(0.0, 0.0, 0)]["SCC"] is None and one[(1.0, 0.0, 7)]["R2"] is None


def test_ranks_count_values_before_they_sort(spark):
    rows = [("a", 1.5, i) for i in range(500)] + [("a", float(i % 7), i) for i in range(40)] + [("b", None, 1), ("b", None, 2), ("b", 3.0, 3)]
    df = spark.createDataFrame(rows, "k string, v double, i int").cache()
    one, two = (sorted(map(tuple, metrics.average_rank(df, ["k"], "v", "r", cells=c).collect()), key=str) for c in (1, 8))
    assert one == two
    plan = metrics.average_rank(df, ["k"], "v", "r", cells=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.index("Join") < plan.index("Window")  # windows see the counted values alone


def test_numbers_of_many_ties(spark):
    rows = [("a", 1.0, f"i{i:04}") for i in range(700)] + [(None, 2.0, f"i{i:04}") for i in range(9)]
    df = spark.createDataFrame(rows, "k string, v double, id string").repartition(5).cache()
    one, two = (sorted(map(tuple, metrics.numbered(df, ["k"], ["v", "id"], "at", c).collect()), key=str) for c in (1, 8))
    assert one == two


def test_digest_of_ids_streams(spark):
    rows = [("a", f"r{i}") for i in range(3000)] + [("b", None), ("b", "x"), (None, "y")]
    got = {r["k"]: (r["n"], r["ids_sha256"]) for r in quality.id_set_hash(spark.createDataFrame(rows, "k string, record_id string").repartition(7), ["k"]).collect()}
    sha = lambda ids: hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    assert got == {"a": (3000, sha([f"r{i}" for i in range(3000)])), "b": (2, sha(["x"])), None: (1, sha(["y"]))}
    assert quality.id_set_hash(spark.createDataFrame([], "k string, record_id string"), ["k"]).count() == 0


def test_blank_and_repeated_ids_are_no_window(spark):
    df = spark.createDataFrame([(" ", i, "A" * 25, "A" * 25) for i in range(50)] + [("x", 60, "A" * 25, "A" * 25), (" x", 61, "A" * 25, "A" * 25), ("y", 62, "A" * 25, "A" * 25)], "record_id string, source_row int, crRNA_sequence string, target_aligned_25 string")
    errors = quality.validate_pairs(df)
    got = sorted((r["source_row"], r["error"]) for r in errors.collect())
    assert got == sorted([(i, f"record_id must be {x}") for i in range(50) for x in ("nonempty", "unique")] + [(60, "record_id must be unique"), (61, "record_id must be unique")])
    assert "Window" not in errors._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_any_size_and_broken_runs(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i, n in enumerate((1, 5, 3_000_000)):
        (tmp_path / f"f/{i} é").write_bytes(random.Random(i).randbytes(n))
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "f").iterdir()}
    for whole in (1 << 26, 10):
        got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in tables.file_manifest(spark, str(tmp_path / "f"), whole).collect()}
        assert {k.replace("%20", " ").replace("%C3%A9", "é"): v for k, v in got.items()} == want
    runs = spark.createDataFrame([(m, f, i, float(i)) for m in "ab" for f in range(3) for i in range(4)], "model_id string, outer_fold int, record_id int, y_pred double")
    runs.write.partitionBy("model_id", "outer_fold").parquet(f"{tmp_path}/runs")
    for p in (tmp_path / "runs/model_id=b/outer_fold=2").glob("part-*"):
        p.write_bytes(b"not yet written")
    spark.createDataFrame([(m, f, "running" if (m, f) == ("b", 2) else "complete") for m in "ab" for f in range(3)], "model_id string, outer_fold int, status string").write.parquet(f"{tmp_path}/status")
    got = tables.read_runs(spark, f"{tmp_path}/runs", spark.read.parquet(f"{tmp_path}/status"), ["model_id", "outer_fold"], ["model_id", "outer_fold", "record_id", "y_pred"])
    assert got.count() == 20  # the broken file isn't opened
    assert sorted(map(tuple, got.collect())) == sorted((m, f, i, float(i)) for m in "ab" for f in range(3) for i in range(4) if (m, f) != ("b", 2))


def test_typed_scans(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x,name\n1,2.5,a\n2,,b\n")
    schema = "id long, x double, name string"
    got = tables.read_features(spark, f"{tmp_path}/t.csv", ["x", "id"], schema, "csv")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(2.5, 1), (None, 2)] and got.dtypes == [("x", "double"), ("id", "bigint")]
    with pytest.raises(ValueError, match="needs a schema"):
        tables.read_features(spark, f"{tmp_path}/t.csv", ["x"], fmt="csv")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_features(spark, f"{tmp_path}/t.csv", ["z"], schema, "csv")
    (tmp_path / "u.csv").write_text("id,x,name\n1,word,a\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        tables.read_features(spark, f"{tmp_path}/u.csv", ["x"], schema, "csv").collect()
    df = spark.createDataFrame([("train", 1), ("test", 2), (None, 3)], "baseline_split string, i int")
    assert [r["i"] for r in tables.split_filter(df, "test").collect()] == [2]


def test_labels_and_results_are_dropped(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "record_id int, label_x int, y_true int, result_score int")
    assert quality.drop_reserved(quality.drop_labels(df)).columns == ["record_id"]
    with pytest.raises(ValueError, match="carry labels"):
        quality.label_leak_guard(df)


def test_supplied_mapping_fields_stay_or_are_refused(spark):
    pairs = spark.createDataFrame([("r", "A" * 25, "A" * 25)], "record_id string, crRNA_sequence string, target_aligned_25 string")
    whole = pairs.withColumns({c: F.lit("given") for c in mapping.FIELDS})
    assert mapping.map_pairs(whole, None).first()["mapping_status"] == "given"
    with pytest.raises(ValueError, match="all mapping fields"):
        mapping.map_pairs(pairs.withColumn("mapping_status", F.lit("x")), None)


def test_calibration_that_falls_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0)], "m string, y_true double, y_pred double")
    assert models.affine_calibration(df.where("m = 'b'"), ["m"], rising=True).first()["slope"] == 0.5
    with pytest.raises(Exception, match="doesn't rise"):
        models.affine_calibration(df, ["m"], rising=True).collect()


def test_groups_are_numbered_in_order(spark, monkeypatch):
    df = spark.createDataFrame([(f"t:A{i % 300:03}",) for i in range(900)], "group_id string")
    want = [(f"t:A{i:03}", i) for i in range(300)]
    assert sorted(map(tuple, resample.numbered_groups(df).collect())) == want
    monkeypatch.setattr(metrics, "CELL_ROWS", 10)
    monkeypatch.setattr(metrics.cells_for, "__defaults__", (10,))
    assert sorted(map(tuple, resample.numbered_groups(df).collect())) == want


def test_unmapped_pairs_and_order_of_results(spark):
    df = spark.createDataFrame([(3, f"r{i:02}", 0 if i % 2 else 1, i) for i in range(30)], "source_row int, record_id string, mapping_hit_count int, result int")
    with pytest.raises(ValueError, match="r01, r03, r05, r07, r09, r11, r13, r15, r17, r19$"):
        score.require_mapped(df)
    assert score.require_mapped(df.where("mapping_hit_count = 1")).count() == 15
    table = score.score_table(spark.createDataFrame([(2, "b", 1.0), (1, "a", 2.0)], "source_row int, record_id string, score double"), ["record_id"], ["record_id", "score"])
    assert table.columns == ["record_id", "score"] and [r[0] for r in table.collect()] == ["a", "b"]


def test_draws_in_tasks_of_all_models_of_one_and_by_windows(spark):
    rng = random.Random(8)
    rows = [(m, f"r{i}", f"g{i % 9}", float(i % 5), float(rng.randrange(6)) if m != "flat" else 1.0) for m in ("a", "b", "flat") for i in range(40)]
    df = spark.createDataFrame(rows, "model_id string, record_id string, group_id string, y_true double, y_pred double").cache()
    forms = [{(r["draw"], r["model_id"]): r for r in resample.bootstrap_metrics(df, 30, 5, most=m).collect()} for m in (1000, 50, 10)]
    assert len(forms[0]) == 90 and all(f.keys() == forms[0].keys() for f in forms)
    for k, r in forms[0].items():
        for f in forms[1:]:
            assert all((r[c] is None and f[k][c] is None) or abs(r[c] - f[k][c]) < 1e-9 for c in metrics.METRICS)
        assert k[1] != "flat" or (r["SCC"] is None and r["RMSE"] is not None)
    empty = df.where("false")
    assert resample.bootstrap_metrics(empty, 5, 1).count() == 0
