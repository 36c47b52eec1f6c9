"""Lengths of a class share their anchors, and hits are those of a comparison of every window."""

import random

from pyspark.sql import functions as F
from test_mapping import brute

from rankloom.operators import mapping


def test_lengths_of_a_class_share_rows(spark):
    """A template is as many rows for lengths of 24 to 31 as for 24 alone, and windows stand in one row each."""
    rng = random.Random(11)
    texts = [(i, "g", "".join(rng.choice("ACGT") for _ in range(97))) for i in range(100)]
    lengths = spark.createDataFrame([(k,) for k in (12, 24, 25, 31)], "k int")
    assert {tuple(r) for r in mapping.by_class(lengths).collect()} == {(12, 12), (24, 31)}
    made = spark.createDataFrame(texts, "template_no int, template_group_id string, template_sequence_clean string")
    whole = made.join(mapping.by_class(lengths.where("k >= 24"))).select("template_no", "template_group_id", "k", "upto", F.lit(0).alias("start"), F.col("template_sequence_clean").alias("text"))
    rows = mapping.anchored(whole).agg(F.count("*").alias("n"), F.sum("windows").alias("windows"), F.count_if((F.length("stretch") < 31) & (F.col("start") < 66)).alias("short")).first()
    assert rows["windows"] == 100 * 74 and rows["n"] < 100 * 74 / 4 and rows["short"] == 0


def test_hits_of_lengths_of_a_class(spark):
    """Lengths of one class, of several and of less than an anchor, with repeats whose anchors recur within a few letters, and anchors that many targets share."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = letters(5)
    templates = [(i, f"g{i // 3}", unit * 12 if i == 0 else "AC" * 25 if i == 1 else letters(20) + ("R" if i % 3 == 0 else "A") + letters(30)) for i in range(15)]
    targets = {letters(25), "AC" * 12, "AC" * 14, "ACACACACACACACACA"}
    for _, _, t in templates:
        for k in (3, 7, 15, 16, 17, 23, 24, 25, 27, 31, 32, 33):
            at = rng.randrange(len(t) - k + 1)
            targets.add(t[at : at + k].replace("R", rng.choice("AG")))
    targets = sorted(targets)
    made = spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(templates, "template_no int, template_group_id string, template_sequence_clean string")
    want = brute(targets, templates)
    assert {m for *_, m in want} == {"exact_acgt", "iupac_compatible"}
    for shared in (256, 1):
        got = [tuple(r) for r in mapping.all_hits(*made, 1024, shared).select("target", "template_no", "template_group_id", "start_0based", "orientation", "match_mode").collect()]
        assert len(got) == len(set(got)) and set(got) == want
