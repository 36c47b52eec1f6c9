"""Anchors: a template is far fewer rows than it has windows, and hits are those of a comparison of every window."""

import random

from pyspark.sql import functions as F
from test_mapping import brute

from rankloom.operators import mapping


def test_fewer_rows_than_windows(spark):
    rng = random.Random(3)
    texts = [(i, "g", 25, 0, "".join(rng.choice("ACGT") for _ in range(97))) for i in range(200)]
    rows = mapping.anchored(spark.createDataFrame(texts, "template_no int, template_group_id string, k int, start int, text string"))
    covered = rows.agg(F.count("*").alias("n"), F.sum(F.length("stretch") - 24).alias("windows")).first()
    assert covered["windows"] == 200 * 73 and covered["n"] < 200 * 73 / 4


def test_common_anchors(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = letters(20)
    templates = [(i, f"g{i // 3}", "A" * 40 if i == 0 else letters(15) + shared + letters(5) + ("RN" if i % 2 else "") + letters(20)) for i in range(12)]
    targets = sorted({x for _, _, t in templates[1:] for x in (t[14:38].replace("R", "A").replace("N", "C"), t[20:44].replace("R", "G").replace("N", "T"), t[3:27])} | {"A" * 24, "T" * 24, letters(24), shared})
    made = spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(templates, "template_no int, template_group_id string, template_sequence_clean string")
    want = brute(targets, templates)
    assert {m for *_, m in want} == {"exact_acgt", "iupac_compatible"}
    for most, shared_by in ((1024, 256), (1024, 1), (1, 1)):
        got = [tuple(r) for r in mapping.all_hits(*made, most, shared_by).select("target", "template_no", "template_group_id", "start_0based", "orientation", "match_mode").collect()]
        assert len(got) == len(set(got)) and set(got) == want
