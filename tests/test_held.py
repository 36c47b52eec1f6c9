"""Label history of held-out folds: what is shuffled."""

import random

from conftest import SF
from pyspark.sql import functions as F

from rankloom.operators import design
from rankloom.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_history_by_fold_is_taken_apart_in_place(spark):
    """No shuffle by record and fold: records are never grouped."""
    assert "held" not in "".join(x for x in plan(queries.QUERIES["history_by_fold"](spark, SF)).splitlines() if "Aggregate" in x)


def test_frequent_key_meets_its_sums_first(spark):
    """Rows of a key that many share are slim when they meet its sums: sums by guide, which are wide, are joined after that, by guide."""
    rng = random.Random(14)
    rows = [(i, f"g{i % 40}", "exact", "one", "gap", i % 5, rng.random(), "missing" if i % 3 else f"k{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "record_id int, guide string, exactness string, diffcat string, gapcat string, fold int, label double, key string")
    made = design.history_by_fold(df, "key")
    lines = [x for x in plan(made).splitlines() if "Join Inner" in x and "=" in x]
    assert "guide" in lines[0] and "key" in lines[1] and made.count() == 300 and made.select(F.size("history")).distinct().count() == 1
