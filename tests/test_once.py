"""What is derived once, what a shuffle carries, and the alignment against letter by letter."""

import random

from conftest import SF
from pyspark.sql import functions as F

from rankloom.operators import features, groups, mapping
from rankloom.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_derived_once(spark):
    """Mapped pairs read stored pairs, not the events again, and rows are read by column."""
    assert not [f for f in queries._mapped(spark, SF).inputFiles() if "events.parquet" in f]
    rows = queries._rows(spark, SF)
    assert rows.inputFiles() and "ReadSchema: struct<record_id:string>" in rows.select("record_id")._jdf.queryExecution().executedPlan().toString()


def test_a_hit_is_one_row(spark):
    rng = random.Random(8)
    rows = [(f"t{rng.randrange(60)}", n := rng.randrange(12), f"g{n // 3}", rng.randrange(2), rng.choice(["forward", "reverse_complement"]), rng.choice(["exact_acgt"] * 5 + ["iupac_compatible"])) for _ in range(150)]
    rows += rows[:20] + [("one", 11, "g3", 4, "forward", "exact_acgt")] * 2 + [("two", 11, "g3", p, "forward", "exact_acgt") for p in (4, 9)]
    hits = spark.createDataFrame(rows, "target string, template_no int, template_group_id string, start_0based int, orientation string, match_mode string")
    rolled = mapping.rollup_hits(hits)
    assert "Expand" not in plan(rolled)
    got = {r["target"]: r for r in rolled.collect()}
    assert set(got) == {r[0] for r in rows}
    for target, r in got.items():
        mine = [x[1:] for x in rows if x[0] == target]
        nos, gs, places, modes = ({f(x) for x in mine} for f in (lambda x: x[0], lambda x: x[1], lambda x: (x[0], x[2], x[3]), lambda x: x[4]))
        assert (r["mapping_hit_count"], r["mapping_template_count"], r["mapping_group_count"], r["mapping_orientation_count"]) == (len(mine), len(nos), len(gs), len({x[3] for x in mine}))
        assert r["mapping_candidate_template_nos"] == ";".join(map(str, sorted(nos))) and r["mapping_candidate_group_ids"] == ";".join(sorted(gs)) and r["mapping_match_modes"] == ";".join(sorted(modes))
        assert (r["mapping_status"] == "unique_exact_window") == (modes == {"exact_acgt"} and len(places) == 1)
    assert got["one"]["mapping_status"] == "unique_exact_window" and got["two"]["mapping_status"] == "ambiguous_position_same_template"


def test_alignment(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("AC-") for _ in range(n)) for n in (25, 25, 25, 24, 30, 3, 0)] + [None, "-" * 25]
    pairs = spark.createDataFrame([(g, t) for g in texts for t in texts], "g string, t string")

    def event(g, t, i):
        if g is None or t is None:
            return "S"
        a, b = g[i : i + 1], t[i : i + 1]
        return "G" if a == "-" and b != "-" else "T" if b == "-" and a != "-" else "M" if a == b else "S"

    for r in pairs.select("g", "t", features.alignment(F.col("g"), F.col("t")).alias("e")).collect():
        assert r["e"] == "".join(event(r["g"], r["t"], i) for i in range(25)), r


def test_audit_counts_groups_not_records(spark):
    rng = random.Random(10)
    made = [(i, p, f"{p}{rng.randrange(9)}" if i % 11 else None, rng.randrange(3)) for i in range(80) for p in "ab"]
    contexts = spark.createDataFrame([(i, rng.choice(["ok", "missing_context"])) for i in range(60)], "record_id int, context_status string")
    assigned = spark.createDataFrame(made, "record_id int, protocol_id string, group_id string, fold int")
    out = groups.protocol_audit(spark.range(70).select(F.col("id").cast("int").alias("record_id")), contexts, assigned)
    text = plan(out)
    assert "Aggregate" in text[text.index("Expand") : text.index("Join")]
    status, want = {r[0]: r[1] for r in contexts.collect()}, {}
    for i, p, g, f in made:
        if i < 70:
            want.setdefault((p, status.get(i, "no_context")), []).append((g, f))
    assert {(r[0], r[1]): tuple(r)[2:] for r in out.collect()} == {k: (len(v), len({g for g, _ in v} - {None}), len({f for _, f in v})) for k, v in want.items()}
