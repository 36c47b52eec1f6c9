"""Boosted trees, ridge and history columns of all folds at once, against plain forms of one fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import boosting, design, history


def data(n=700, seed=3, folds=5):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 6)) < 0.5, 0.0, np.round(rng.normal(size=(n, 6)), 1))
    x[:, 5] = (x[:, 5] > 0).astype(float)
    h = np.round(rng.normal(size=(n, folds, 2)), 1)
    fold = rng.integers(0, folds, n)
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + 3 * x[:, 5] * (x[:, 2] > 0) + 0.5 * h[np.arange(n), fold, 1] + 0.1 * rng.normal(size=n)
    y[::50] = np.nan
    return x, h, fold, (np.arange(n) % 3 == 0).astype(int), y


def frame(spark, x, h, fold, part, y):
    rows = []
    for i in range(len(x)):
        at = np.flatnonzero(x[i])
        rows.append((f"r{i}", int(fold[i]), int(part[i]), None if np.isnan(y[i]) else float(y[i]), h[i, :, 0].tolist(), at.tolist(), x[i, at].tolist(), h[i].ravel().tolist(), "extra"))
    schema = "record_id string, fold int, part int, y double, anchor array<double>, indices array<int>, values array<double>, history array<double>, sums string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def plain(x, h, fold, part, y, fit, at, shape):
    """One fit by exhaustive search over the same edges, recursively."""
    live = (fold != fit.held) & ~np.isnan(y) & ((part == fit.part) if fit.part is not None else True)
    columns = [(c, x[:, c]) for c in range(at.static) if fit.columns is None or c in fit.columns]
    columns += [(at.static + fit.held * at.history + k, h[:, fit.held, k]) for k in sorted(fit.history)]
    f = h[:, fit.held, 0].copy() if fit.center == "anchor" else np.full(len(y), y[live].mean() if fit.center == "mean" else 0.0)
    for _ in range(shape.rounds):
        step = np.zeros(len(y))

        def grow(member, depth):
            own = member & live
            g, n = (f - y)[own].sum(), own.sum()
            best = (1e-9, None)
            if depth and n:
                for c, v in columns:
                    for e in at.edges[c]:
                        left = own & (v <= e)
                        gl, nl = (f - y)[left].sum(), left.sum()
                        if min(nl, n - nl) >= shape.least:
                            gain = gl**2 / (nl + shape.shrink) + (g - gl) ** 2 / (n - nl + shape.shrink) - g**2 / (n + shape.shrink)
                            if gain > best[0] + 1e-7:
                                best = (gain, (v, e))
            if best[1] is None:
                step[member] = -shape.rate * g / (n + shape.shrink)
            else:
                v, e = best[1]
                grow(member & (v <= e), depth - 1)
                grow(member & (v > e), depth - 1)

        grow(np.ones(len(y), bool), shape.depth)
        f = f + step
    return f


def test_fits_equal_plain_ones(spark, monkeypatch):
    x, h, fold, part, y = data()
    rows = frame(spark, x, h, fold, part, y)
    shape = boosting.Shape(rounds=3, depth=3, rows=1.0, share=1.0, least=5.0, rate=0.5)
    fits = [boosting.Fit(0), boosting.Fit(3, history=frozenset({0, 1}), center="anchor"), boosting.Fit(2, columns=frozenset({0, 5}), center="none"), boosting.Fit(1, part=1), boosting.Fit(1, part=0, history=frozenset({1}))]
    at = boosting.layout(rows, 6, 2, 5)
    want = {i: plain(x, h, fold, part, y, f, at, shape) for i, f in enumerate(fits)}
    for carry, block in ((8, 4096), (1, 50)):  # what is predicted so far in blocks, and many blocks
        monkeypatch.setattr(boosting, "CARRY", carry)
        monkeypatch.setattr(boosting, "BLOCK", block)
        got = boosting.fit_predict(rows, fits, 6, 2, shape=shape).collect()
        assert len(got) == sum(((fold == f.held) & ((part == f.part) if f.part is not None else True)).sum() for f in fits)
        assert max(abs(r["y_pred"] - want[r["fit"]][int(r["record_id"][1:])]) for r in got) < 1e-6


def test_boosting_learns_and_sampling_is_repeatable(spark):
    x, h, fold, part, y = data(1500, 5)
    rows = frame(spark, x, h, fold, part, y)
    fits = [boosting.Fit(f, seed=s, history=frozenset({0, 1})) for f in range(5) for s in (1, 2)]
    shape = boosting.Shape(rounds=12, depth=4, rate=0.4)
    one, two = (sorted(map(tuple, boosting.fit_predict(r, fits, 6, 2, shape=shape).collect())) for r in (rows, rows.repartition(1)))
    p, q = np.array([r[2] for r in one]), np.array([r[2] for r in two])
    assert [r[:2] for r in one] == [r[:2] for r in two] and np.abs(p - q).max() < 0.2
    assert {r[0] for r in one} == set(range(10)) and any(a[2] != b[2] for a, b in zip(one, one[1:]))
    truth = {f"r{i}": v for i, v in enumerate(y)}
    e = np.array([(r[2] - truth[r[1]]) ** 2 for r in one if not np.isnan(truth[r[1]])])
    assert e.mean() < 0.25 * np.nanvar(y)
    assert boosting.fit_predict(rows.where("false"), fits, 6, 2, shape=boosting.Shape(rounds=1, depth=2)).count() == 0


def test_ridge_equals_normal_equations(spark):
    x, h, fold, part, y = data(400, 9)
    got = {r["record_id"]: r["y_pred"] for r in design.ridge_by_fold(frame(spark, x, h, fold, part, y), 6, stripe=3).collect()}
    for f in range(5):
        a = np.column_stack([x, h[:, f]])
        fit = (fold != f) & ~np.isnan(y)
        mean, std = a[fit].mean(0), a[fit].std(0)
        z = (a - mean) / std
        beta = np.linalg.solve(z[fit].T @ z[fit] / fit.sum() + np.eye(8), z[fit].T @ (y[fit] - y[fit].mean()) / fit.sum())
        for i in np.flatnonzero(fold == f):
            assert abs(got[f"r{i}"] - (y[fit].mean() + z[i] @ beta)) < 1e-8


def test_history_by_fold_equals_one_fold_at_a_time(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcd"), rng.choice(["exact", "nonexact"]), rng.choice(["exact", "one", "two_plus"]), rng.choice(["gap", "no_gap"]), rng.choice("xyz"), rng.randrange(5), round(rng.gauss(0, 1), 3)) for i in range(200)]
    rows += [(900, "new", "exact", "one", "gap", "lone", 0, 1.0)]
    df = spark.createDataFrame(rows, "record_id long, guide string, exactness string, diffcat string, gapcat string, key string, fold int, label double").cache()
    got = {r["record_id"]: np.array(r["history"]).reshape(5, -1) for r in design.history_by_fold(df, "key").collect()}
    names = list(design.HISTORY_COLUMNS)
    for f in range(5):
        fit, query = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        own = history.leave_one_out(fit).select("record_id", *names[:11]).collect()
        own += history.guide_encoding(query, history.guide_history(fit), fit.agg(F.avg("label").alias("mean"))).select("record_id", *names[:11]).collect()
        for r in own:
            assert np.allclose(got[r["record_id"]][f, :11], [float(r[n]) for n in names[:11]], atol=1e-9)
        mean = np.mean([r[7] for r in rows if r[6] != f])
        coded = history.crossfit(fit, "key").select("record_id", "key_te", "key_log_count").collect()
        look = history.smoothed_lookup(query, fit.groupBy("key").agg(F.sum("label").alias("sum"), F.count("label").alias("count")), ["key"], float(mean), history.CROSSFIT_K, "key_te")
        for r in [*coded, *look.select("record_id", "key_te", F.col("key_te_log_count").alias("key_log_count")).collect()]:
            assert np.allclose(got[r["record_id"]][f, 11:], [r["key_te"], r["key_log_count"]], atol=1e-9)


def test_vectors(spark):
    long = spark.createDataFrame([("a", 3, 1.5), ("a", 0, 2.0), ("a", 2, 0.0), ("b", 7, -1.0), ("b", 1, None)], "record_id string, column int, value double")
    v = design.assemble(long)
    assert {r["record_id"]: (r["indices"], r["values"]) for r in v.collect()} == {"a": ([0, 3], [2.0, 1.5]), "b": ([7], [-1.0])}
    assert {r["record_id"]: r["features"].toArray().tolist() for r in design.to_ml(v, 8).collect()}["a"] == [2.0, 0, 0, 1.5, 0, 0, 0, 0]
    with pytest.raises(Exception, match="beyond 7"):
        design.to_ml(v, 7).select(F.count("features")).collect()
