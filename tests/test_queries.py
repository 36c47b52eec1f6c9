"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from rankloom.plans.oracle import ORACLES
from rankloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["metrics_by_fold", "calibration", "validation_errors", "kept_invalid", "pair_features", "pair_identity_long", "iupac_tensor", "map_pairs", "guide_history", "guide_encoding_loo", "mapping_encoding_crossfit", "ranked_pairs", "component_groups", "group_folds", "overlap_audit", "crossfit_weights", "bootstrap_metrics", "swap_test", "holm", "block_permutation"]


def canon(df):
    return df.reindex(sorted(df.columns), axis=1).sort_values(sorted(df.columns)).reset_index(drop=True)


def test_every_query_but_fits_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"oof_gbt", "residual_boost", "centered_baseline", "ridge_oof", "block_arms", "two_expert"}


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    pd.testing.assert_frame_equal(canon(got), canon(want), check_dtype=False, rtol=0, atol=1e-9)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
