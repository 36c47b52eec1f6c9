"""Fits that grow whole in tasks against fits that grow level by level, and the queries' number of rounds."""

import numpy as np

from rankloom.operators import boosting, growing
from rankloom.plans import queries
from test_boosting import data, frame


def test_whole_fits_equal_fits_by_level(spark):
    x, h, fold, part, y = data(900, 11)
    rows = frame(spark, x, h, fold, part, y)
    shape = boosting.Shape(rounds=6, depth=4, rows=0.8, share=0.7, least=4.0, rate=0.3)
    fits = [boosting.Fit(0), boosting.Fit(3, 5, history=frozenset({0, 1}), center="anchor"), boosting.Fit(2, columns=frozenset({0, 2, 5}), center="none"), boosting.Fit(1, part=1), boosting.Fit(4, part=0, history=frozenset({1}))]
    one = {(r["fit"], r["record_id"]): r["y_pred"] for r in boosting.fit_predict(rows, fits, 6, 2, shape=shape).collect()}
    two = {(r["fit"], r["record_id"]): r["y_pred"] for r in boosting.fit_predict(rows, fits, 6, 2, shape=shape, most=0).collect()}
    assert one.keys() == two.keys() and len(one) > 500
    assert max(abs(one[k] - two[k]) for k in one) < 1e-6


def test_whole_fits_do_not_depend_on_how_rows_come(spark):
    rows = frame(spark, *data(500, 12))
    fits = [boosting.Fit(f, history=frozenset({0, 1})) for f in range(3)]
    shape = boosting.Shape(rounds=20, depth=5, rate=0.3)
    one, two = (sorted(map(tuple, boosting.fit_predict(r, fits, 6, 2, shape=shape).collect())) for r in (rows, rows.repartition(7)))
    assert [r[:2] for r in one] == [r[:2] for r in two] and max(abs(a[2] - b[2]) for a, b in zip(one, two, strict=True)) < 1e-12


def test_lists_and_classes():
    rng = np.random.default_rng(4)
    bins = np.where(rng.random((9, 300)) < 0.7, 1, rng.integers(0, 4, (9, 300))).astype(np.uint8)
    bins[:, 250:] = rng.integers(0, 4, (9, 50))  # long lists
    offset = np.arange(10) * 4
    lists, g, times = growing.Lists(bins, offset, 64), rng.normal(size=300), rng.integers(1, 5, 300).astype(float)
    slot = np.sort(rng.integers(0, 3, 300))
    got = lists.added(np.arange(300), slot, g, times, 3)
    for s in range(3):
        for c in range(9):
            for b in range(4):
                met = (slot == s) & (bins[c] == b) & (b != lists.usual[c])
                assert abs(got[0, s, 4 * c + b] - g[met].sum()) < 1e-6 and got[1, s, 4 * c + b] == times[met].sum()
    of, first = growing.classes(bins[:3])
    assert (bins[:3] == bins[:3, first[of]]).all() and len(first) == len({tuple(r) for r in bins[:3].T.tolist()})


def test_queries_take_all_rounds():
    """As many rounds, at the rate and with the samples, that the models have which the queries stand for."""
    s = queries._SHAPE
    assert (s.rounds, s.depth, s.rate, s.shrink, s.least, s.rows, s.share) == (1100, 7, 0.02, 2.0, 8.0, 0.85, 0.8)
