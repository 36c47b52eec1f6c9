"""Registered queries of the evaluation and ranking operators: each reads whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, stored
from ..functions.sequences import nearest6, normalize_key, normalize_sequence, r6, template_atoms, ungap
from ..operators import boosting, design, features, groups, history, mapping, metrics, models, quality, resample, score, select
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Parameters that oracles share.
DRAWS, SWAPS, SEED, STEP = 2000, 2000, "20261012", 0.05


def query(f: Query) -> Query:
    """Register a query; doubles are rounded to 6 places and counts are longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = metrics.rounded(f(spark, sf_dir))
        return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


def _fx(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fixtures.load(spark, d, name)


# --- metrics ---------------------------------------------------------------------------------------------------------
@query
def metrics_by_fold(spark, d):
    return metrics.metrics_by_fold(_fx(spark, d, "predictions"))


@query
def metric_delta(spark, d):
    return metrics.metric_delta(metrics.metrics_by_fold(_fx(spark, d, "predictions")), "M_STRONG", "M_WEAK", ["level"])


@query
def constant_folds(spark, d):
    return metrics.constant_folds(_fx(spark, d, "predictions"))


@query
def tail_bias(spark, d):
    return metrics.tail_bias(_fx(spark, d, "predictions"), ["model_id"])


@query
def component_correlation(spark, d):
    return metrics.component_correlation(_fx(spark, d, "components"), [("D_xgb", "B"), ("D_xgb", "C"), ("B", "C")])


@query
def within_group_rank(spark, d):
    return metrics.within_group_rank(_fx(spark, d, "predictions"))


@query
def calibration(spark, d):
    return metrics.calibration(_fx(spark, d, "predictions"))


@query
def observed_bins(spark, d):
    return metrics.observed_bins(_fx(spark, d, "predictions"))


@query
def quantile_bins(spark, d):
    return metrics.quantile_bins(_fx(spark, d, "predictions"))


@query
def route_counts(spark, d):
    p = _fx(spark, d, "predictions").withColumn("prediction_route", F.when(F.col("outer_fold") < 2, "fallback").otherwise("fusion"))
    return metrics.route_counts(p)


@query
def win_rate(spark, d):
    return metrics.win_rate(_fx(spark, d, "components"), "B", "D_xgb")


@query
def metric_rank_profile(spark, d):
    return metrics.metric_rank_profile(metrics.five_metrics(_fx(spark, d, "predictions"), ["model_id"])).select("model_id", "metric", "rank")


@query
def density_2d(spark, d):
    return metrics.density_2d(_fx(spark, d, "predictions"), 0.25)


@query
def metric_regression(spark, d):
    m = metrics.five_metrics(_fx(spark, d, "predictions"), ["model_id", "outer_fold"])
    pooled = m.groupBy("model_id").agg(*[F.avg(x).alias(x) for x in metrics.METRICS])
    return quality.max_abs_diff(m, m.select("model_id", "outer_fold").join(pooled, "model_id"), ["model_id", "outer_fold"], list(metrics.METRICS), 0.05)


# --- quality ---------------------------------------------------------------------------------------------------------
@query
def validation_errors(spark, d):
    return quality.validate_pairs(_fx(spark, d, "damaged"))


@query
def kept_invalid(spark, d):
    rows = _fx(spark, d, "damaged")
    return quality.keep_invalid(rows, quality.validate_pairs(rows), ("label_normalized",)).select("source_row", "record_id", "label_normalized", "status", "input_errors")


@query
def key_violations(spark, d):
    return quality.key_violations(_fx(spark, d, "damaged"), "record_id")


@query
def lost_keys(spark, d):
    return quality.lost_keys(_fx(spark, d, "pairs"), _fx(spark, d, "contexts"), "record_id")


@query
def coverage_audit(spark, d):
    p = _fx(spark, d, "predictions")
    expected = p.where("model_id = 'M_MID'").select("record_id", "group_id", F.col("outer_fold").alias("fold"), "y_true")
    broken = p.where("not (model_id = 'M_WEAK' and outer_fold = 3)").withColumn("y_true", F.when((F.col("model_id") == "M_CONST") & (F.col("outer_fold") == 1), F.col("y_true") + 1).otherwise(F.col("y_true")))
    return quality.coverage(broken, expected, ["model_id"])


@query
def method_consistency(spark, d):
    p = _fx(spark, d, "predictions").withColumn("y_true", F.when((F.col("model_id") == "M_WEAK") & (F.col("outer_fold") == 2), F.round(F.col("y_true") + 0.5, 6)).otherwise(F.col("y_true")))
    return quality.method_consistency(p, ["y_true", "group_id", "outer_fold"])


@query
def single_assignment(spark, d):
    p = _fx(spark, d, "predictions").withColumn("outer_fold", F.when((F.col("model_id") == "M_WEAK") & (F.col("outer_fold") == 2), 4).otherwise(F.col("outer_fold")))
    return quality.single_assignment(p)


@query
def allowed_routes(spark, d):
    p = _fx(spark, d, "predictions").withColumn("prediction_route", F.when(F.col("outer_fold") < 2, "fallback").otherwise("fusion"))
    roster = spark.createDataFrame([("M_STRONG", "fusion"), ("M_STRONG", "fallback"), ("M_MID", "fusion"), ("M_CONST", "fallback")], "model_id string, prediction_route string")
    return quality.allowed_routes(p, roster)


@query
def numeric_contract(spark, d):
    c = _fx(spark, d, "components").select("inner_fold", "y_true", F.when(F.col("outer_fold") > 0, F.col("B")).alias("B"))
    return quality.numeric_contract(c, ["inner_fold", "y_true", "B"])


@query
def identity_agreement(spark, d):
    c = _fx(spark, d, "components").withColumn("group_id", F.when(F.col("outer_fold") == 1, F.lower("group_id")).otherwise(F.col("group_id")))
    p = _fx(spark, d, "predictions").where("model_id = 'M_MID'")
    return quality.identity_agreement(p, c, "record_id", ["group_id", "outer_fold", "y_true"])


@query
def id_set_hash(spark, d):
    return quality.id_set_hash(_fx(spark, d, "predictions"), ["model_id", "outer_fold"])


@query
def normalized_keys(spark, d):
    p = _fx(spark, d, "pairs")
    return p.select("record_id", normalize_sequence(F.lower("crRNA_sequence")).alias("guide"), ungap("target_aligned_25").alias("target"), normalize_key(F.nullif(F.substr("record_id", F.lit(1), F.lit(1)), F.lit("7"))).alias("key"), F.size(template_atoms(F.concat_ws(";", "record_id", F.lit(" "), F.lit(" 12 ")))).alias("atoms"))


@query
def pivoted_predictions(spark, d):
    return score.pivot_predictions(_fx(spark, d, "predictions"), ["record_id", "y_true"], ["M_STRONG", "M_MID", "M_WEAK"])


@query
def melted_predictions(spark, d):
    return score.melt_predictions(_fx(spark, d, "components"), ["record_id", "inner_fold"])


@query
def completed_runs(spark, d):
    p = _fx(spark, d, "predictions")
    status = p.select("model_id", "outer_fold").distinct().withColumn("status", F.when((F.col("model_id") == "M_MID") & (F.col("outer_fold") >= 3), "failed").otherwise("complete"))
    from ..sources.tables import collect_runs

    return collect_runs(p, status, ["model_id", "outer_fold"], ["model_id", "outer_fold", "record_id", "y_true", "y_pred"])


@query
def runs_from_folder(spark, d):
    """Predictions written as a folder of runs, and read back for completed runs alone."""
    from ..functions.checkpoints import new_path
    from ..sources.tables import read_runs

    p = _fx(spark, d, "predictions")
    root = new_path(spark, "runs")
    p.repartition("model_id", "outer_fold").write.partitionBy("model_id", "outer_fold").parquet(f"{root}/rows")
    p.select("model_id", "outer_fold").distinct().withColumn("status", F.when((F.col("model_id") == "M_MID") & (F.col("outer_fold") >= 3), "failed").otherwise("complete")).write.parquet(f"{root}/status")
    return read_runs(spark, f"{root}/rows", spark.read.parquet(f"{root}/status"), ["model_id", "outer_fold"], ["model_id", "outer_fold", "record_id", "y_true", "y_pred"])


@query
def feature_scan(spark, d):
    """A typed scan of two of the events' columns."""
    from ..sources.tables import read_features

    return read_features(spark, f"{d}/events.parquet", ["event_id", "value"], "event_id bigint, value double")


@query
def split_rows(spark, d):
    from ..sources.tables import split_filter

    return split_filter(_fx(spark, d, "pairs"), "baseline_validation").select("record_id", "crRNA_sequence")


@query
def label_free(spark, d):
    """Pairs without labels and without columns of an earlier result."""
    p = _fx(spark, d, "pairs").withColumns({"label_other": F.lit(1.0), "result_score": F.lit(2.0)})
    return quality.label_leak_guard(quality.drop_reserved(quality.drop_labels(p)))


@query
def pairs_round_trip(spark, d):
    """Pairs written as a delimited table and read again, as text."""
    from ..functions.checkpoints import new_path
    from ..sources.tables import read_pairs, write_scores

    write_scores(_fx(spark, d, "pairs").select("record_id", "crRNA_sequence", "target_aligned_25"), path := new_path(spark, "pairs"), "tsv")
    return read_pairs(spark, path, "tsv").select("record_id", "crRNA_sequence", "target_aligned_25")


@query
def applied_state(spark, d):
    """Rows without labels, encoded by a state that was saved from the training rows."""
    from ..functions.checkpoints import new_path

    rows = _rows(spark, d)
    history.save_state(path := new_path(spark, "state"), _train(rows), ["aligned_difference_count"])
    out = history.apply_state(path, quality.drop_labels(rows.where("baseline_split <> 'baseline_train'")).drop("label"), ["aligned_difference_count"])
    return out.select("record_id", *_TE, F.col("mapping_te_mapping_candidate_template_nos").alias("template_te"))


@query
def supplied_mapping(spark, d):
    """Mapping fields that pairs bring along stay as they are."""
    return mapping.map_pairs(_mapped(spark, d), _fx(spark, d, "templates")).select("record_id", *mapping.FIELDS)


@query
def scored_table(spark, d):
    """Input columns first, then results, of pairs that must all be mapped."""
    p = _fx(spark, d, "damaged").withColumns({"mapping_hit_count": F.lit(1), "activity_score": F.col("label_normalized")})
    return score.score_table(score.require_mapped(p), ["source_row", "record_id"], ["record_id", "activity_score"])


@query
def first_unmapped(spark, d):
    """The first ten ids that a policy of refusing names."""
    p = _fx(spark, d, "pairs").withColumn("mapping_hit_count", F.when(F.col("baseline_split") == "baseline_train", 1).otherwise(0))
    return spark.createDataFrame([(x,) for x in score.unmapped_ids(p)], "record_id string")


@query
def clean_templates(spark, d):
    from ..sources.tables import clean_templates as clean

    raw = _fx(spark, d, "templates").select((F.col("template_no") + 1).alias("template_no"), F.concat(F.lower("template_sequence_clean"), F.lit(" x-5")).alias("template_sequence"))
    return clean(raw)


# --- features --------------------------------------------------------------------------------------------------------
def _features(spark, d, names):
    return features.feature_table(_fx(spark, d, "pairs"), list(names))


@query
def pair_features(spark, d):
    return features.feature_table(_fx(spark, d, "pairs"))


@query
def alignment_summary(spark, d):
    return _features(spark, d, features.alignment_summary())


@query
def position_flags(spark, d):
    return _features(spark, d, features.position_flags())


@query
def substitutions(spark, d):
    return _features(spark, d, features.substitution_counts())


@query
def pair_identity_long(spark, d):
    return features.pair_onehot(_fx(spark, d, "pairs"))


@query
def iupac_tensor(spark, d):
    return features.iupac_tensor(_fx(spark, d, "contexts"))


@query
def context_profile(spark, d):
    return features.context_profile(_fx(spark, d, "contexts"))


@query
def alignment_events(spark, d):
    return features.events_long(_fx(spark, d, "pairs"))


# --- mapping ---------------------------------------------------------------------------------------------------------
def _hits(spark, d):
    return mapping.all_hits(mapping.targets_of(_fx(spark, d, "pairs")), _fx(spark, d, "templates"))


@query
def template_windows(spark, d):
    targets = mapping.targets_of(_fx(spark, d, "pairs"))
    w = mapping.template_windows(_fx(spark, d, "templates"), targets.select(F.length("target").alias("k")).distinct())
    return w.groupBy("template_no", F.length("window").alias("k")).agg(F.count("*").alias("windows"), F.count_if("plain").alias("plain_windows"))


@query
def exact_hits(spark, d):
    return _hits(spark, d).where("match_mode = 'exact_acgt'")


@query
def iupac_hits(spark, d):
    return _hits(spark, d).where("match_mode = 'iupac_compatible'")


@query
def mapping_rollup(spark, d):
    return mapping.rollup_hits(_hits(spark, d))


def _mapped(spark, d):
    return mapping.map_pairs(stored(_fx(spark, d, "pairs")), _fx(spark, d, "templates"))  # read for targets and for rows, derived once


@query
def map_pairs(spark, d):
    return _mapped(spark, d).select("record_id", *mapping.FIELDS)


@query
def mapping_parity(spark, d):
    m = _mapped(spark, d).select("record_id", *mapping.FIELDS)
    changed = m.withColumn("mapping_status", F.when(F.col("mapping_hit_count") > 1, "changed").otherwise(F.col("mapping_status")))
    return quality.identity_agreement(m, changed, "record_id", mapping.FIELDS)


# --- history ---------------------------------------------------------------------------------------------------------
def _rows(spark, d, with_mapping=True, columns=None):
    """Pairs with guide, target, difference and gap classes, fold and mapping fields. With columns, only these are made and written."""
    p = features.aligned(_mapped(spark, d) if with_mapping else _fx(spark, d, "pairs"))
    made = features.alignment_summary()
    p = p.withColumns({"aligned_difference_count": made["aligned_difference_count"], "gap_count": made["gap_count_target"] + made["gap_count_guide"], "label": F.col("label_normalized")})
    p = history.classes(p.withColumn("target", F.col("target_ungapped")))
    fold = (F.conv(F.substr(F.md5(F.concat("crRNA_sequence", F.lit("|f"))), F.lit(1), F.lit(6)), 16, 10).cast("long") % 5).cast("int")
    out = p.withColumn("fold", fold).drop("target_ungapped", "events")
    slim = out if with_mapping else out.select("record_id", "baseline_split", "guide", "target", "exactness", "diffcat", "gapcat", "label", "fold")
    return stored(slim.select(*columns) if columns else slim)  # alignment and mapping run once, whatever is made of them


def _train(rows):
    return rows.where("baseline_split = 'baseline_train'")


@query
def guide_history(spark, d):
    return history.guide_history(_train(_rows(spark, d, False)))


@query
def mapping_history(spark, d):
    return history.mapping_history(_train(_rows(spark, d, columns=["baseline_split", "label", *history.MAPPING_FIELDS])))


_TE = ["te_guide_all", "te_guide_all_log_count", "te_guide_seen", "te_guide_exact_ref", "te_guide_exact_log_count", "te_guide_nonexact_ref", "te_guide_nonexact_log_count", "te_guide_diffcat", "te_guide_diffcat_log_count", "te_guide_gapcat", "te_guide_gapcat_log_count"]


@query
def guide_encoding_query(spark, d):
    rows = _rows(spark, d, False)
    train = _train(rows)
    out = history.guide_encoding(rows.where("baseline_split <> 'baseline_train'"), history.guide_history(train), train.agg(F.avg("label").alias("mean")))
    return out.select("record_id", *_TE)


@query
def guide_encoding_loo(spark, d):
    return history.leave_one_out(_train(_rows(spark, d, False))).select("record_id", *_TE)


@query
def mapping_encoding_crossfit(spark, d):
    rows = _train(_rows(spark, d, columns=["record_id", "baseline_split", "label", "fold", "mapping_candidate_group_ids"])).withColumn("key", normalize_key("mapping_candidate_group_ids"))
    return history.crossfit(rows, "key").select("record_id", "key_te", "key_log_count")


@query
def interaction_encoding(spark, d):
    rows = _train(_rows(spark, d, columns=["record_id", "baseline_split", "label", "fold", "diffcat", "mapping_candidate_group_ids"])).withColumn("key", history.interaction_key("mapping_candidate_group_ids", "diffcat"))
    return history.crossfit(rows, "key").select("record_id", "key", "key_te", "key_log_count")


#: The mapping field that templates are looked up by.
_TEMPLATES = "mapping_candidate_template_nos"


@query
def smoothed_lookup(spark, d):
    rows = _rows(spark, d, columns=["record_id", "baseline_split", "label", _TEMPLATES])
    h = history.mapping_history(_train(rows), fields=[_TEMPLATES]).select("key", "sum", "count")
    q = rows.where("baseline_split <> 'baseline_train'").select("record_id", normalize_key("mapping_candidate_template_nos").alias("key"))
    return history.smoothed_lookup(q, h, ["key"], -2.7, history.MAPPING_K, "te").withColumn("te", r6("te"))


@query
def onehot(spark, d):
    fields = ["mapping_status", "mapping_confidence", "mapping_match_modes"]
    rows = _rows(spark, d, columns=["record_id", "baseline_split", *fields])
    return history.apply_onehot(rows.where("baseline_split <> 'baseline_train'"), history.fit_onehot(_train(rows), fields), fields)


_NUMERIC = ["first_difference_position_1based", "last_difference_position_1based", "guide_gc_content", "gap_count_guide", "longest_match_run"]


@query
def median_impute(spark, d):
    p = _fx(spark, d, "pairs")
    t = features.feature_table(p, _NUMERIC).join(p.select("record_id", "baseline_split"), "record_id")
    fit = t.where("baseline_split = 'baseline_train'")
    return history.median_impute(t.where("baseline_split <> 'baseline_train'"), history.medians(fit, _NUMERIC), _NUMERIC).drop("baseline_split")


@query
def active_columns(spark, d):
    return history.active_columns(features.feature_table(_fx(spark, d, "pairs"), _NUMERIC), _NUMERIC)


@query
def support_counts(spark, d):
    rows = _rows(spark, d, columns=["record_id", "baseline_split", "guide", "mapping_hit_count", _TEMPLATES])
    return history.support_counts(rows.where("baseline_split <> 'baseline_train'"), _train(rows)).select("record_id", "guide_support_n", "template_support_n")


@query
def reference_diagnostics(spark, d):
    rows = _rows(spark, d, columns=["record_id", "baseline_split", "label", "guide", _TEMPLATES])
    train = _train(rows)
    out = history.reference_diagnostics(rows.where("baseline_split <> 'baseline_train'"), history.guide_totals(train), history.mapping_history(train, fields=[_TEMPLATES]))
    return out.select("record_id", "guide_seen", "guide_reference_count", "template_key_seen", "template_reference_count")


@query
def support_summary(spark, d):
    rows = _rows(spark, d, False, ["baseline_split", "guide"])  # support of guides alone, which no mapping changes
    return metrics.support_summary(history.guide_support(rows, _train(rows)), ["baseline_split"], "guide_support_n")


@query
def support_distribution(spark, d):
    rows = _rows(spark, d)
    q = history.support_counts(rows.where("baseline_split <> 'baseline_train'"), _train(rows))
    q = q.withColumns({"mapped": F.col("mapping_hit_count") > 0, "y_true": F.col("label"), "group_id": F.col("guide"), "y_pred": F.round(-2.5 - 0.1 * F.col("aligned_difference_count"), 6)})
    return metrics.support_distribution(q, "guide_support_n")


@query
def mean_baselines(spark, d):
    """Global, guide, template and mixed means as predictions."""
    rows = _rows(spark, d, columns=["record_id", "baseline_split", "label", "guide", "exactness", "diffcat", "gapcat", _TEMPLATES])
    train = _train(rows)
    mean = cut(train.agg(F.avg("label").alias("mean")))
    q = history.guide_encoding(rows.where("baseline_split <> 'baseline_train'"), history.guide_history(train), mean)
    h = history.mapping_history(train, fields=[_TEMPLATES]).select(F.col("key").alias("tkey"), "sum", "count")
    q = history.smoothed_lookup(q.withColumn("tkey", normalize_key("mapping_candidate_template_nos")), h, ["tkey"], -2.7, history.MAPPING_K, "te_template")
    out = history.anchors(q).crossJoin(F.broadcast(mean))
    return out.select("record_id", F.col("mean").alias("global_mean"), "guide_anchor", r6("template_anchor").alias("template_anchor"), r6("mixed_anchor").alias("mixed_anchor"))


@query
def numeric_mapping(spark, d):
    m = _mapped(spark, d).select("record_id", *[F.nullif(F.col(c).cast("string"), F.lit("0")).alias(c) for c in history.MAPPING_COUNTS])
    return history.numeric_mapping(m)


@query
def feature_parity(spark, d):
    """All features against themselves with two of them changed."""
    made = features.feature_table(_fx(spark, d, "pairs"))
    stored = made.withColumns({"substitution_count": F.col("substitution_count") + F.when(F.col("gap_count_target") > 0, 1).otherwise(0), "first_difference_position_1based": F.nullif("first_difference_position_1based", F.lit(10))})
    return features.feature_parity(made, stored, 1e-9)


def _matrix_blocks(spark, d, with_history):
    rows = _rows(spark, d)
    train = _train(rows)
    long = lambda df, names: df.select("record_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["record_id"], names, "feature", "value")
    pairs = _fx(spark, d, "pairs")
    table = features.feature_table(pairs, _NUMERIC).join(rows.select("record_id", "baseline_split"), "record_id")
    filled = history.median_impute(table, history.medians(table.where("baseline_split = 'baseline_train'"), _NUMERIC), _NUMERIC)
    fields = ["mapping_status", "mapping_confidence", "mapping_match_modes"]
    onehot = history.apply_onehot(rows, history.fit_onehot(train, fields), fields).select("record_id", F.concat_ws("=", "field", "key").alias("feature"), F.lit(1.0).alias("value"))
    pair = features.pair_onehot(pairs).select("record_id", F.format_string("%02d_%s", F.col("position"), F.col("pair")).alias("feature"), F.lit(1.0).alias("value"))
    encoded = history.leave_one_out(train).select("record_id", *_TE).unionByName(history.guide_encoding(rows.where("baseline_split <> 'baseline_train'"), history.guide_history(train), train.agg(F.avg("label").alias("mean"))).select("record_id", *_TE))
    coded = train.withColumn("key", normalize_key("mapping_candidate_group_ids"))
    query = history.smoothed_lookup(rows.where("baseline_split <> 'baseline_train'").withColumn("key", normalize_key("mapping_candidate_group_ids")), history.mapping_history(train).where("field = 'mapping_candidate_group_ids'").select("key", "sum", "count"), ["key"], -2.7, history.MAPPING_K, "key_te")
    mapped = history.crossfit(coded, "key").select("record_id", "key_te", "key_log_count").unionByName(query.select("record_id", "key_te", F.col("key_te_log_count").alias("key_log_count")))
    blocks = [("numeric", long(filled, _NUMERIC))]
    blocks += [("guide", long(encoded, _TE))] if with_history else []
    blocks += [("pair", pair), ("mapping", long(history.numeric_mapping(rows), history.MAPPING_COUNTS))]
    blocks += [("history", long(mapped, ["key_te", "key_log_count"]))] if with_history else []
    return features.context_matrix([*blocks, ("onehot", onehot)]), train.select("record_id")


def _matrix(spark, d, with_history):
    """Values of the ordered design matrix, columns numbered by what the fit rows have."""
    matrix, fit = _matrix_blocks(spark, d, with_history)
    matrix = cut(matrix)
    columns = cut(features.matrix_columns(matrix.join(fit, "record_id", "left_semi")))
    return features.numbered_matrix(matrix, columns).join(F.broadcast(columns), "column").groupBy("column", "feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def context_matrix(spark, d):
    return _matrix(spark, d, True)


@query
def seq_mapping_matrix(spark, d):
    return _matrix(spark, d, False)


# --- scores ----------------------------------------------------------------------------------------------------------
def _scored(spark, d):
    """Validation pairs with components (guide, template and mixed history as b, c and d), mapping and diagnostics."""
    mapped = ["mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_confidence", _TEMPLATES]
    rows = _rows(spark, d, columns=["record_id", "baseline_split", "label", "guide", "exactness", "diffcat", "gapcat", "aligned_difference_count", *mapped])
    train = _train(rows)
    q = rows.where("baseline_split <> 'baseline_train'")
    gh, mh = history.guide_history(train), history.mapping_history(train, fields=[_TEMPLATES])
    mean = cut(train.agg(F.avg("label").alias("mean")))
    out = history.guide_encoding(history.reference_diagnostics(q, gh, mh), gh, mean)
    h = mh.select(F.col("key").alias("tkey"), "sum", "count")
    out = history.smoothed_lookup(out.withColumn("tkey", normalize_key("mapping_candidate_template_nos")), h, ["tkey"], -2.7, history.MAPPING_K, "te_template")
    out = history.anchors(out)
    return out.select("record_id", "label", "mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_confidence", "guide_seen", "template_key_seen", nearest6("guide_anchor").alias("b"), nearest6("mixed_anchor").alias("c"), (F.lit(Decimal("-2.5")) - F.lit(Decimal("0.1")) * F.col("aligned_difference_count")).alias("d"))


@query
def routed_scores(spark, d):
    return score.routed_fusion(_scored(spark, d)).select("record_id", "prediction_full", "activity_score", "model_route", "prediction_status")


@query
def warning_codes(spark, d):
    return _scored(spark, d).select("record_id", score.warning_codes().alias("warning_codes"))


@query
def ranked_pairs(spark, d):
    """Flagship: pairs mapped, encoded by label history, blended, routed, warned about and ranked."""
    routed = score.routed_fusion(_scored(spark, d)).withColumn("activity_score", nearest6("activity_score"))
    out = score.ranked(routed)
    return out.select("record_id", "activity_score", "model_route", "rank_within_route", "activity_rank", score.warning_codes(F.col("rank_withheld")).alias("warning_codes"))


@query
def ranked_mixed(spark, d):
    routed = score.routed_fusion(_scored(spark, d)).withColumn("activity_score", nearest6("activity_score"))
    return score.ranked(routed, allow_mixed=True).select("record_id", "activity_score", "activity_rank")


@query
def top_scores(spark, d):
    routed = score.routed_fusion(_scored(spark, d)).withColumn("activity_score", nearest6("activity_score"))
    return score.top_k(routed, 20).select("record_id", "activity_score")


@query
def history_strata(spark, d):
    return metrics.history_strata(_scored(spark, d).withColumns({"y_true": F.col("label"), "d": F.col("d").cast("double")}), "b", "d")


@query
def candidate_strata(spark, d):
    return metrics.candidate_strata(_scored(spark, d).select("mapping_template_count", F.col("label").alias("y_true"), F.col("b").alias("y_pred")))


def _components(spark, d):
    """Components with d, b and c and a mapping hit count, for blends."""
    c = _fx(spark, d, "components")
    return c.select("record_id", "group_id", "y_true", "outer_fold", F.col("HISTORY_PRIOR").alias("history_prior"), F.col("SEQ_MAPPING_XGB").alias("seq_mapping"), F.col("D_xgb").alias("d_xgb"), F.col("D_lightgbm").alias("d_lgbm"), F.col("D_mlp").alias("d_mlp"), F.col("B").alias("b"), F.col("C").alias("c"), F.col("mapping_found").cast("int").alias("mapping_hit_count")).withColumn("d", score.blend(score.D_WEIGHTS))


@query
def blend_profiles(spark, d):
    return score.fusion_profiles(_components(spark, d)).withColumn("y_pred", r6("y_pred"))


@query
def profile_metrics(spark, d):
    c = _components(spark, d)
    long = score.fusion_profiles(c).withColumn("y_pred", nearest6("y_pred")).join(c.select("record_id", "y_true"), "record_id")
    return metrics.five_metrics(long, ["profile"])


@query
def primary_scores(spark, d):
    """Scores, routes, status and versions under each model that may be primary."""
    c = _components(spark, d)
    made = [score.primary_score(c, p).select(F.lit(p).alias("primary_model"), "record_id", "activity_score", "model_route", "prediction_status", "model_version") for p in ("full", "d", "legacy")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def seed_means(spark, d):
    return score.mean_over_seeds(_fx(spark, d, "predictions"))


# --- groups ----------------------------------------------------------------------------------------------------------
def _identities(spark, d):
    columns = ["record_id", "target", "guide", _TEMPLATES, "fold", "label_normalized"]
    return _train(_rows(spark, d, columns=["baseline_split", *columns])).select(*columns)


@query
def component_groups(spark, d):
    return groups.component_groups(_identities(spark, d), True).select("record_id", "group_id")


@query
def protocol_groups(spark, d):
    return groups.protocol_groups(_identities(spark, d))


@query
def group_folds(spark, d):
    return groups.balanced_group_folds(_fx(spark, d, "predictions").where("model_id = 'M_MID'"))


@query
def nested_roles(spark, d):
    p = _fx(spark, d, "predictions").where("model_id = 'M_MID'").select("record_id", "group_id", F.col("outer_fold").alias("fold"))
    return groups.nested_roles(p).groupBy("outer", "inner", "role").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))


@query
def isolation_violations(spark, d):
    p = _identities(spark, d).select("record_id", F.col("target").alias("group_id"), "fold")
    return groups.isolation_violations(groups.nested_roles(p), ["outer", "inner"], "group_id")


@query
def overlap_audit(spark, d):
    return groups.overlap_audit(_identities(spark, d))


@query
def assignment_audit(spark, d):
    return groups.assignment_audit(_identities(spark, d), group="target")


@query
def stop_roles(spark, d):
    p = _fx(spark, d, "predictions").where("model_id = 'M_MID'").select("record_id", F.col("outer_fold").alias("fold"))
    return groups.stop_roles(p)


@query
def cohort_common(spark, d):
    return groups.load_cohort(_fx(spark, d, "pairs"), _fx(spark, d, "contexts")).select("record_id", "crRNA_sequence", "target_context_45", "label_normalized")


@query
def context_audit(spark, d):
    return groups.context_audit(groups.load_cohort(_fx(spark, d, "pairs")), _fx(spark, d, "contexts"))


@query
def data_audit(spark, d):
    return groups.data_audit(_fx(spark, d, "pairs"), target="target_aligned_25", guide="crRNA_sequence")


@query
def protocol_audit(spark, d):
    assignments = groups.protocol_groups(_identities(spark, d))
    fold = (F.conv(F.substr(F.md5(F.concat("group_id", F.lit("|p"))), F.lit(1), F.lit(6)), 16, 10).cast("long") % 5).cast("int")
    return groups.protocol_audit(groups.load_cohort(_fx(spark, d, "pairs")), _fx(spark, d, "contexts"), assignments.withColumn("fold", fold))


@query
def encoding_folds(spark, d):
    p = _fx(spark, d, "predictions").where("model_id = 'M_MID'").select("record_id", F.lit("guide").alias("protocol_id"), F.col("outer_fold").alias("fold"))
    return groups.encoding_folds(p, "guide", 2)


@query
def pending_work(spark, d):
    plan = quality.id_set_hash(_fx(spark, d, "predictions"), ["model_id", "outer_fold"])
    done = plan.withColumn("status", F.when(F.col("outer_fold") == 0, "failed").otherwise("complete")).withColumn("ids_sha256", F.when(F.col("model_id") == "M_MID", F.lit("other")).otherwise(F.col("ids_sha256")))
    return groups.pending_work(plan, done, ["model_id", "outer_fold"])


# --- selection -------------------------------------------------------------------------------------------------------
def _grid_scores(spark, d):
    grid = select.simplex_grid(spark, 3, STEP, (select.D_ORIGINAL,))
    return select.score_grid(_fx(spark, d, "components"), grid, ["D_xgb", "D_lightgbm", "D_mlp"])


@query
def grid_scores(spark, d):
    return _grid_scores(spark, d).select("w1", "w2", "w3", "inner_fold", "SCC", "MAE")


@query
def chosen_weights(spark, d):
    s = select.summarize(_grid_scores(spark, d), ["w1", "w2", "w3"], 4)
    return select.choose_weights(s, select.D_ORIGINAL).select("w1", "w2", "w3", "mean_SCC", "mean_MAE")


def _policy(spark, d):
    return cut(select.select_policy(cut(_fx(spark, d, "components")), STEP))


@query
def selected_policy(spark, d):
    """Weights and family chosen on four inner folds: D, then D/B and D/B/C given D, then the family."""
    return _policy(spark, d)


@query
def replayed_selection(spark, d):
    """The policy that is chosen again, against a stored one: the frozen weights and the family of all three."""
    names = [*(f"d_w{k}" for k in (1, 2, 3)), "db_w1", "db_w2", *(f"tri_w{k}" for k in (1, 2, 3))]
    stored = spark.createDataFrame([(*select.D_ORIGINAL, *select.DB_ORIGINAL, *select.TRI_ORIGINAL, "D_B_C")], ", ".join([*(f"{n} double" for n in names), "family string"]))
    return select.replay_selection(cut(_fx(spark, d, "components")), stored, STEP)


@query
def chosen_family(spark, d):
    family = select.policy_and_family(cut(_fx(spark, d, "components")), STEP)[1]
    return family.select("family", "mean_SCC", "mean_MAE", "n_learners")


@query
def policy_predictions(spark, d):
    return select.apply_policy(_fx(spark, d, "components"), _policy(spark, d)).withColumn("y_pred", r6("y_pred"))


@query
def blend_grid(spark, d):
    return select.blend_grid(_fx(spark, d, "components"), "D_xgb", "B", 0.01).select("alpha", "SCC", "RMSE")


@query
def pairwise_weights(spark, d):
    """The best of 101 weights: highest SCC, then lowest RMSE."""
    return select.best_blend(select.blend_grid(_fx(spark, d, "components"), "D_lightgbm", "C", 0.01).withColumns({"SCC": F.round("SCC", 11), "RMSE": F.round("RMSE", 11)})).select("alpha", "SCC", "RMSE")


@query
def crossfit_weights(spark, d):
    return select.crossfit_weights(_grid_scores(spark, d), ["w1", "w2", "w3"], "inner_fold", 4)


@query
def near_optimal(spark, d):
    return select.near_optimal(select.summarize(_grid_scores(spark, d), ["w1", "w2", "w3"], 4), ["w1", "w2", "w3"], 0.01)


@query
def selection_frequency(spark, d):
    """How often each family wins when weights stay as they were and one inner fold decides."""
    made = _fx(spark, d, "components").withColumn("D", 0.35 * F.col("D_xgb") + 0.59 * F.col("D_lightgbm") + 0.06 * F.col("D_mlp"))
    scores = select.family_scores(made, select.DB_ORIGINAL, select.TRI_ORIGINAL)
    best = scores.groupBy("inner_fold").agg(F.max_by("family", F.struct(F.round("SCC", 9), F.col("family"))).alias("family"))
    return select.selection_frequency(best)


@query
def promotion_gate(spark, d):
    return select.promotion_gate(metrics.metrics_by_fold(_fx(spark, d, "predictions")), "M_MID", 0.001, 0.0, 4)


# --- resampling ------------------------------------------------------------------------------------------------------
@query
def cluster_draws(spark, d):
    return resample.cluster_draws(cut(resample.numbered_groups(_fx(spark, d, "predictions"))), DRAWS, int(SEED))


def _two(spark, d):
    return cut(_fx(spark, d, "predictions").where("model_id in ('M_STRONG', 'M_MID')"))


@query
def bootstrap_metrics(spark, d):
    return resample.bootstrap_metrics(cut(_fx(spark, d, "predictions")), DRAWS, int(SEED))


@query
def bootstrap_delta(spark, d):
    return resample.bootstrap_delta(_two(spark, d), "M_STRONG", "M_MID", DRAWS, int(SEED)).drop("status")


@query
def swap_test(spark, d):
    return resample.swap_test(_two(spark, d), "M_STRONG", "M_MID", SWAPS, int(SEED))


@query
def comparison_table(spark, d):
    """The strong model against two others, one of them constant: differences, intervals, swap p and Holm p in a family of sixteen."""
    return resample.comparison_table(_fx(spark, d, "predictions"), "M_STRONG", ["M_MID", "M_CONST"], DRAWS, int(SEED), family_size=16)


@query
def holm(spark, d):
    m = metrics.metrics_by_fold(_fx(spark, d, "predictions"))
    t = m.select(F.concat_ws("|", "model_id", "level").alias("test_id"), F.round(F.col("RMSE") / 10, 6).alias("p"), "SCC").select("test_id", F.when(F.col("SCC").isNotNull(), F.col("p")).alias("p_value"))
    return resample.holm(t, family_size=30)


@query
def label_shuffle(spark, d):
    p = _fx(spark, d, "predictions").where("model_id = 'M_MID'").select("record_id", "outer_fold", "y_true")
    return resample.label_shuffle(p, ["outer_fold"], "y_true", int(SEED))


@query
def block_permutation(spark, d):
    c = _fx(spark, d, "components").select("record_id", "outer_fold", "B", "C", "y_true")
    return resample.block_permutation(c, ["outer_fold"], ["B", "C"], int(SEED))


@query
def multiset_unchanged(spark, d):
    c = _fx(spark, d, "components").select("record_id", "outer_fold", "B", "C")
    return resample.multiset_unchanged(c, resample.block_permutation(c, ["outer_fold"], ["B", "C"], int(SEED)), ["outer_fold", "B", "C"])


@query
def perturbation_effect(spark, d):
    return resample.perturbation_effect(cut(_fx(spark, d, "predictions").where("model_id in ('M_WEAK', 'M_STRONG')")), "M_STRONG", "M_WEAK", DRAWS, int(SEED)).select("metric", "observed", "lower", "upper")


@query
def bootstrap_histogram(spark, d):
    """All metrics of all models."""
    drawn = resample.bootstrap_metrics(cut(_fx(spark, d, "predictions")), DRAWS, int(SEED)).unpivot(["draw", "model_id"], list(metrics.METRICS), "metric", "value")
    return resample.histogram(cut(drawn.select("model_id", "metric", r6("value").alias("v"))), "v", 10, ("model_id", "metric"))


# --- models ----------------------------------------------------------------------------------------------------------
#: Seeds of the residual fits; rounds, depth, rate, shrinkage and samples of all fits, as the models have them that the queries stand for.
_SEEDS, _SHAPE = (42, 52, 62, 72, 82), boosting.Shape(rounds=1100, depth=7, rate=0.02, shrink=2.0, least=8.0, rows=0.85, share=0.8)
_FOLDS = 5


_MARKS = ["mapping_status", "mapping_confidence", "mapping_match_modes"]


def _kept(names):
    """Columns of pairs that stand beside their features: some of theirs, mapping fields and counts, and pairs of letters."""
    counts = {c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in history.MAPPING_COUNTS}
    return {c: F.col(c) for c in (*names, *_MARKS)} | counts | {"pairs": features.pair_array()}


def _met(rows):
    """Names of the letter pairs and flags that rows have: as many as the model has columns."""
    pairs = [f"{r['at'] + 1:02d}_{r['x']}" for r in rows.select(F.posexplode("pairs").alias("at", "x")).distinct().collect()]
    return pairs, [f"{r['field']}={r['key']}" for r in history.fit_onehot(rows, _MARKS).collect()]


@query
def design_vectors(spark, d):
    """Sparse vectors of the ordered design matrix: their columns, and sums that tell their values and places."""
    rows = _rows(spark, d)
    base = cut(features.feature_table(rows, _NUMERIC, _kept(["baseline_split", "guide", "exactness", "diffcat", "gapcat", "label", "fold", "mapping_candidate_group_ids"])))
    base = history.median_impute(base, history.medians(_train(base), _NUMERIC), _NUMERIC).withColumn("key", normalize_key("mapping_candidate_group_ids"))
    train, q = _train(base), base.where("baseline_split <> 'baseline_train'")
    h = history.mapping_history(_train(rows)).where("field = 'mapping_candidate_group_ids'").select("key", "sum", "count")
    coded = history.smoothed_lookup(history.guide_encoding(q, history.guide_history(_train(rows)), _train(rows).agg(F.avg("label").alias("mean"))), h, ["key"], -2.7, history.MAPPING_K, "key_te")
    columns = ["record_id", "pairs", *_MARKS, *_NUMERIC, *_TE, *history.MAPPING_COUNTS, "key_te", "key_log_count"]
    whole = history.crossfit(history.leave_one_out(train), "key").select(*columns).unionByName(coded.withColumnRenamed("key_te_log_count", "key_log_count").select(*columns))
    pairs, marks = _met(_train(base))
    fixed = lambda names: names if pairs else []  # without fit rows there are no columns
    names = design.matrix_names([("numeric", fixed(_NUMERIC)), ("guide", fixed(_TE)), ("pair", pairs), ("mapping", fixed(history.MAPPING_COUNTS)), ("history", fixed(["key_te", "key_log_count"])), ("onehot", marks)])
    plain = {"numeric": _NUMERIC, "guide": _TE, "mapping": history.MAPPING_COUNTS, "history": ["key_te", "key_log_count"]}
    v = design.vectors(whole, names, plain, {"pair": "pairs"}, {"onehot": _MARKS}, ["record_id"]).where(F.size("indices") > 0)
    total = lambda of: F.aggregate(F.zip_with("indices", "values", of), F.lit(0.0), lambda a, x: a + x)
    return v.select("record_id", F.size("indices").alias("n"), F.array_join("indices", ",").alias("columns"), F.round(total(lambda i, x: x), 4).alias("total"), F.round(total(lambda i, x: x * (i + 1)), 2).alias("weighted"))


def _keyed_train(spark, d, columns=None):
    return _train(_rows(spark, d, columns=columns)).withColumn("key", normalize_key("mapping_candidate_group_ids"))


@query
def history_by_fold(spark, d):
    """Label-history columns of each training record under each held-out fold."""
    columns = ["record_id", "baseline_split", "label", "guide", "exactness", "diffcat", "gapcat", "fold", "mapping_candidate_group_ids"]
    made = design.history_by_fold(_keyed_train(spark, d, columns), "key")
    n = len(design.HISTORY_COLUMNS)
    # a record's array is taken apart where it is, not shuffled by value
    held = made.select("record_id", "history", F.explode(F.array(*map(F.lit, range(_FOLDS)))).alias("held"))
    return held.select("record_id", "held", *[F.get("history", F.col("held") * n + k).alias(c) for k, c in enumerate(design.HISTORY_COLUMNS)])


def _design(spark, d):
    """Training records with sparse static columns, the columns of each held-out fold, and the names of the static ones by number.

    All 188 pair features, pairs of letters by position, mapping counts and mapping fields; features that may be missing are filled with medians of each fold's fit rows,
    so they stand with the label history, which differs by fold.
    """
    rows = _keyed_train(spark, d)
    made = list(features.features())
    table = cut(features.feature_table(rows, keep=_kept(["fold"])))
    numeric = [*made, *history.MAPPING_COUNTS]
    seen = table.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in made], *[F.count_if(F.col(c).cast("double") != 0).alias(f"used_{c}") for c in numeric]).first()
    gaps = [c for c in made if seen[c] < seen["n"]]
    used = lambda cs: [c for c in cs if seen[f"used_{c}"]]
    whole = used([c for c in made if c not in gaps])
    pairs, marks = _met(table)
    static = design.matrix_names([("numeric", whole), ("pair", pairs), ("mapping", used(history.MAPPING_COUNTS)), ("onehot", marks)])
    vectors = design.vectors(table, static, {"numeric": whole, "mapping": history.MAPPING_COUNTS}, {"pair": "pairs"}, {"onehot": _MARKS}, ["record_id", *gaps])
    by_fold = design.history_by_fold(rows, "key").join(vectors, "record_id")
    if gaps:
        held = table.select("fold", *[F.col(c).cast("double").alias(c) for c in gaps]).unpivot(["fold"], gaps, "column", "v").select("column", "v", "fold", F.explode(F.array(*map(F.lit, range(_FOLDS)))).alias("held"))
        middle = {(r["column"], r["held"]): r["q"][0] for r in metrics.quantiles(held.where("fold <> held"), ["column", "held"], "v", [0.5]).collect()}  # a number for each such column and fold
        fill = lambda f: [F.coalesce(F.col(c).cast("double"), F.lit(float(middle.get((c, f), 0.0)))) for c in gaps]
        n = len(design.HISTORY_COLUMNS)
        by_fold = by_fold.withColumn("history", F.concat(*[x for f in range(_FOLDS) for x in (F.slice("history", f * n + 1, n), F.array(*fill(f)))])).drop(*gaps)
    width = len(design.HISTORY_COLUMNS) + len(gaps)
    anchor = F.array(*[F.col("history")[f * width] for f in range(_FOLDS)])
    out = by_fold.select("record_id", "fold", (F.col("exactness") == "exact").cast("int").alias("part"), F.col("label").alias("y"), anchor.alias("anchor"), "indices", "values", "history")
    return cut(out), static, width


def _fitted(spark, d, fits):
    """Predictions by record of a function of (static names, width) that gives named fits; several of one name and record are averaged."""
    rows, static, width = _design(spark, d)
    made = fits(static, frozenset(range(width)), frozenset(range(len(design.HISTORY_COLUMNS), width)))
    got = boosting.fit_predict(rows, made, len(static), width, _FOLDS, _SHAPE)
    names = F.array(*[F.lit(f.name) for f in made])
    got = got.groupBy(F.get(names, F.col("fit")).alias("arm"), "record_id").agg(F.avg("y_pred").alias("y_pred"))
    return got.join(rows.select("record_id", "fold"), "record_id")


@query
def oof_gbt(spark, d):
    return _fitted(spark, d, lambda static, every, filled: [boosting.Fit(f, history=every) for f in range(_FOLDS)]).select("record_id", "fold", "y_pred")


@query
def residual_boost(spark, d):
    """Five seeds on what the guide's history leaves, averaged."""
    return _fitted(spark, d, lambda static, every, filled: [boosting.Fit(f, s, history=every, center="anchor") for f in range(_FOLDS) for s in _SEEDS]).select("record_id", "fold", "y_pred")


@query
def centered_baseline(spark, d):
    """Sequence and mapping alone, no label history."""
    return _fitted(spark, d, lambda static, every, filled: [boosting.Fit(f, history=filled) for f in range(_FOLDS)]).select("record_id", "fold", "y_pred")


@query
def ridge_oof(spark, d):
    rows, static, _ = _design(spark, d)
    return design.ridge_by_fold(rows, len(static), _FOLDS)


@query
def block_arms(spark, d):
    """Sequence, mapping, history and all, with the same capacity; all arms and folds grow together."""

    def fits(static, every, filled):
        sequence = frozenset(i for i, x in enumerate(static) if x.startswith(("numeric:", "pair:")))
        arms = {"sequence": (sequence, filled), "sequence_mapping": (None, filled), "sequence_history": (sequence, every), "all": (None, every)}
        return [boosting.Fit(f, columns=c, history=h, name=n) for n, (c, h) in arms.items() for f in range(_FOLDS)]

    return _fitted(spark, d, fits).select("arm", "record_id", "y_pred")


@query
def two_expert(spark, d):
    """One fit for exact pairs, one for the rest, in each fold."""
    return _fitted(spark, d, lambda static, every, filled: [boosting.Fit(f, history=every, part=p) for f in range(_FOLDS) for p in (0, 1)]).select("record_id", "fold", "y_pred")


@query
def rank_target(spark, d):
    rows = _fx(spark, d, "predictions").where("model_id = 'M_MID'").select("record_id", F.col("y_true").alias("label"))
    fitted = cut(models.rank_target(rows))
    return models.inverse_rank_target(fitted.select("record_id", F.round(F.col("z") * 0.9, 9).alias("z")), fitted).select("record_id", "z", "y_pred")


@query
def affine_calibration(spark, d):
    return models.affine_calibration(_fx(spark, d, "predictions"), ["model_id"])
