"""A query makes and writes the columns that it reads."""

from conftest import SF

from rankloom.operators import history, mapping
from rankloom.plans import queries


def test_rows_are_written_by_column(spark, monkeypatch):
    """A query writes the columns that it reads; guides' support needs no mapping."""
    written, mapped = [], []
    stored, map_pairs = queries.stored, mapping.map_pairs
    monkeypatch.setattr(queries, "stored", lambda df: written.append(df.columns) or stored(df))
    monkeypatch.setattr(mapping, "map_pairs", lambda *a: mapped.append(1) or map_pairs(*a))
    queries.QUERIES["support_summary"](spark, SF)
    assert written == [["baseline_split", "guide"]] and not mapped
    for name in ("mapping_history", "smoothed_lookup", "support_counts", "reference_diagnostics"):
        written.clear()
        queries.QUERIES[name](spark, SF)
        assert not {"events", "target", "crRNA_sequence", "aligned_difference_count"} & set(written[-1]), name


def test_totals_are_those_of_the_history(spark):
    rows = spark.createDataFrame([("a", "exact", "one", "gap", 1.5), ("a", "nonexact", "one", "gap", None), (None, "exact", "exact", "no_gap", 2.0), ("b", "exact", "one", "gap", None)], "guide string, exactness string, diffcat string, gapcat string, label double")
    want = history.guide_history(rows).where("reference_type = 'all'")
    assert sorted(map(str, history.guide_totals(rows).collect())) == sorted(map(str, want.collect()))
