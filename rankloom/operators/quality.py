"""Validation with row-level errors, checked joins and audits of prediction tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import normalize_sequence

REQUIRED = ("record_id", "crRNA_sequence", "target_aligned_25")
#: Prefix of result columns, which input may not have.
RESERVED = "result_"
_ERRORS = "record_id string, source_row long, field string, error string"


def check_header(df: DataFrame, forbidden: tuple[str, ...] = (), reserved: str = RESERVED) -> DataFrame:
    """Errors of the header: missing, reserved and forbidden columns."""
    rows = [("", 1, c, f"Missing required column: {c}") for c in REQUIRED if c not in df.columns]
    rows += [("", 1, c, "Input contains a reserved result column") for c in df.columns if c.startswith(reserved)]
    rows += [("", 1, c, "Mapping is calculated; remove supplied mapping columns") for c in sorted(set(forbidden) & set(df.columns))]
    return df.sparkSession.createDataFrame(rows, _ERRORS)


def _sequence_error(name: str, gaps: bool) -> Column:
    s = normalize_sequence(name)
    bad = F.array_sort(F.array_distinct(F.filter(F.split(s, ""), lambda x: (x != "") & ~x.rlike("^[ACGT-]$" if gaps else "^[ACGT]$"))))
    error = F.when(s.isNull(), f"Missing {name}").when(F.size(bad) > 0, F.concat(F.lit(f"Invalid characters in {name}: "), F.array_join(bad, ",")))
    error = error.when(F.length(s) != 25, F.concat(F.lit(f"{name} must contain exactly 25 aligned positions; got "), F.length(s).cast("string")))
    return error.when(F.translate(s, "-", "") == "", f"{name} cannot contain gaps only") if gaps else error


def validate_pairs(df: DataFrame, row: str = "source_row") -> DataFrame:
    """One row for each error: (record_id, source_row, field, error). Of the two sequences, the first that is wrong is told.

    Repeated ids are counted before rows are shuffled, and only ids that repeat are joined back; blank ids need no count where they are
    alone, so however many rows have one id, they are no window.
    """
    rid = F.trim(F.coalesce("record_id", F.lit("")))
    named = df.select("*", rid.alias("__id"))
    repeated = named.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1")
    counted = named.join(repeated, "__id", "left")
    guide, target = _sequence_error("crRNA_sequence", False), _sequence_error("target_aligned_25", True)
    found = F.array(
        F.struct(F.lit("record_id").alias("field"), F.when(F.col("__id") == "", "record_id must be nonempty").alias("error")),
        F.struct(F.lit("record_id").alias("field"), F.when(F.col("__n") > 1, "record_id must be unique").alias("error")),
        F.struct(F.lit("crRNA_sequence").alias("field"), guide.alias("error")),
        F.struct(F.lit("target_aligned_25").alias("field"), F.when(guide.isNull(), target).alias("error")),
    )
    return counted.select(F.col("__id").alias("record_id"), F.col(row).cast("long").alias("source_row"), F.explode(F.filter(found, lambda x: x["error"].isNotNull())).alias("e")).select("record_id", "source_row", "e.field", "e.error")


def keep_invalid(df: DataFrame, errors: DataFrame, scores: tuple[str, ...] = (), row: str = "source_row") -> DataFrame:
    """All rows; those with errors get null scores, a status and their errors, joined. Rows are told apart by their number, so blank and repeated ids are flagged too."""
    joined = errors.groupBy(F.col("source_row").alias(row)).agg(F.array_join(F.array_sort(F.collect_list("error")), " | ").alias("input_errors"))
    out = df.join(joined, row, "left").withColumn("status", F.when(F.col("input_errors").isNotNull(), "invalid_input").otherwise("valid"))
    return out.withColumns({c: F.when(F.col("input_errors").isNull(), F.col(c)) for c in scores}).withColumn("input_errors", F.coalesce("input_errors", F.lit("")))


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null, empty and repeated keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(F.col(key).cast("string") == "", F.col("n"))), F.lit(0)).alias("empty_keys"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"))


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    v = key_violations(df, key).first()
    if v["null_keys"] or v["empty_keys"] or v["repeated_keys"]:
        raise ValueError(f"{key}: {v.asDict()}")
    return df


def lost_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    l, r = left.select(key), right.select(key)
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join that loses and repeats nothing, or an error."""
    assert_unique_key(left, key)
    assert_unique_key(right, key)
    if lost := [r[key] for r in lost_keys(left, right, key).limit(10).collect()]:
        raise ValueError(f"{key} on one side only: {lost}")
    return left.join(right, key)


def coverage(predictions: DataFrame, expected: DataFrame, keys: list[str], folds: int = 5) -> DataFrame:
    """For each model: how its rows agree with the expected (record_id, group_id, fold, y_true)."""
    models = predictions.select(*keys).distinct()
    want = models.crossJoin(expected.select("record_id", F.col("group_id").alias("w_group"), F.col("fold").alias("w_fold"), F.col("y_true").alias("w_y")))  # models are few
    both = predictions.withColumn("__has", F.lit(1)).join(want.withColumn("__want", F.lit(1)), [*keys, "record_id"], "full_outer")
    met = F.col("__has").isNotNull() & F.col("__want").isNotNull()
    return both.groupBy(*keys).agg(
        F.count("__has").alias("rows"), F.count_if(F.col("__has").isNull()).alias("missing_ids"), F.count_if(F.col("__want").isNull()).alias("extra_ids"), F.count_if(met & ~F.col("y_true").eqNullSafe(F.col("w_y"))).alias("label_mismatch"),
        F.count_if(met & ~F.col("group_id").eqNullSafe(F.col("w_group"))).alias("group_mismatch"), F.count_if(met & ~F.col("outer_fold").eqNullSafe(F.col("w_fold"))).alias("fold_mismatch"), F.count_if(F.col("__has").isNotNull() & ~F.coalesce(F.col("outer_fold").between(0, folds - 1), F.lit(False))).alias("bad_fold"),
    )


def method_consistency(predictions: DataFrame, columns: list[str], key: str = "record_id") -> DataFrame:
    """Records for which a column isn't the same for all models."""
    counts = predictions.groupBy(key).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns])
    return counts.where(reduce(lambda a, b: a | b, (F.col(c) > 1 for c in columns)))


def single_assignment(predictions: DataFrame) -> DataFrame:
    """Records in several folds or groups, and groups in several folds."""
    r = predictions.groupBy(F.lit("record").alias("what"), F.col("record_id").alias("id")).agg(F.count_distinct("outer_fold").alias("folds"), F.count_distinct("group_id").alias("groups"))
    g = predictions.groupBy(F.lit("group").alias("what"), F.col("group_id").alias("id")).agg(F.count_distinct("outer_fold").alias("folds"), F.lit(1).cast("long").alias("groups"))
    return r.unionByName(g).where("folds > 1 or groups > 1")


def allowed_routes(predictions: DataFrame, roster: DataFrame) -> DataFrame:
    """(model_id, prediction_route) that the roster doesn't allow, with counts."""
    return predictions.join(F.broadcast(roster), ["model_id", "prediction_route"], "left_anti").groupBy("model_id", "prediction_route").agg(F.count("*").alias("n"))


def numeric_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: missing or not finite, not whole, and negative values."""
    x = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "column", "value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return x.groupBy("column").agg(F.count_if(bad).alias("not_finite"), F.count_if(~bad & (F.floor("value") != F.col("value"))).alias("not_whole"), F.count_if(~bad & (F.col("value") < 0)).alias("negative"))


def max_abs_diff(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """For each column: rows on one side only, largest difference and whether it is within tolerance; null equals null."""
    both = a.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a")).join(b.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(1).alias("in_b")), key, "full_outer")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"), (F.col("in_a").isNull() | F.col("in_b").isNull()).alias("lost")) for c in columns])).alias("x")).select("x.*")
    differs = F.col("lost") | (F.col("a").isNull() != F.col("b").isNull())
    out = long.groupBy("column").agg(F.count_if(differs).alias("unmatched"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
    return out.withColumn("within", (F.col("unmatched") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance))


def label_leak_guard(df: DataFrame) -> DataFrame:
    """The frame itself, if it carries no label."""
    if found := [c for c in df.columns if c.startswith("label_") or c == "y_true"]:
        raise ValueError(f"query rows carry labels: {found}")
    return df


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("label_") or c == "y_true"])


def drop_reserved(df: DataFrame, prefix: str = RESERVED) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def identity_agreement(source: DataFrame, assigned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column, matched rows and those that differ (null equals null)."""
    both = source.alias("s").join(assigned.alias("a"), key)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")).alias("same")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("differing"))


def id_set_hash(df: DataFrame, keys: list[str], id_col: str = "record_id") -> DataFrame:
    """keys, n and ids_sha256: SHA-256 of each group's sorted ids, joined by line feeds; null ids don't count in it.

    A group's ids are sorted by Spark and hashed as they stream by, so a group of any size takes the memory of one batch; by its
    definition the digest of a group is one task's work.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in keys}
    rows = df.select(*keys, F.col(id_col).cast("string").alias("__id")).repartition(*keys).sortWithinPartitions(*keys, "__id")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sha, schema = None, 0, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(now, schema, strict=False)), pa.array([n], pa.int64()), pa.array([sha[0].hexdigest()])], names=[*kinds, "n", "ids_sha256"])

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for *key, i in zip(*columns, strict=True):
                if key != now:
                    if n:
                        yield told()
                    now, n, sha = key, 0, [hashlib.sha256(), b""]
                n += 1
                if i is not None:
                    sha[0].update(sha[1] + i.encode())
                    sha[1] = b"\n"
        if n:
            yield told()

    return rows.mapInArrow(digests, ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), "n long, ids_sha256 string"]))
