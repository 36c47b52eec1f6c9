"""Label history: sums and counts by guide and by mapping key, and the encodings made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import coerce_numeric, difference_class, gap_class, normalize_key
from .metrics import quantiles

GUIDE_K, MAPPING_K, CROSSFIT_K = 0.5, 20.0, 20.0
MAPPING_FIELDS = ["mapping_status", "mapping_confidence", "mapping_candidate_template_nos", "mapping_candidate_group_ids", "mapping_match_modes", "mapping_candidate_orientations"]
MAPPING_COUNTS = ["mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_orientation_count"]


def classes(df: DataFrame, differences: str = "aligned_difference_count", gaps: str = "gap_count") -> DataFrame:
    return df.withColumns({"exactness": F.when(F.col(differences) == 0, "exact").otherwise("nonexact"), "diffcat": difference_class(differences), "gapcat": gap_class(gaps)})


def guide_history(train: DataFrame, label: str = "label") -> DataFrame:
    """(reference_type, guide, category, sum, count) in one pass over grouping sets."""
    got = train.groupingSets([["guide"], ["guide", "exactness"], ["guide", "diffcat"], ["guide", "gapcat"]], "guide", "exactness", "diffcat", "gapcat").agg(F.sum(label).alias("sum"), F.count(label).alias("count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, F.col("exactness")).when(F.col("g") == 5, "diffcat").otherwise("gapcat")
    category = F.when(F.col("g") == 5, F.col("diffcat")).when(F.col("g") == 6, F.col("gapcat")).otherwise("")
    return got.select(kind.alias("reference_type"), "guide", category.alias("category"), "sum", "count")


def guide_totals(train: DataFrame, label: str = "label") -> DataFrame:
    """The rows of guide_history whose reference_type is all, without the classes that the others need."""
    got = train.groupBy("guide").agg(F.sum(label).alias("sum"), F.count(label).alias("count"))
    return got.select(F.lit("all").alias("reference_type"), "guide", F.lit("").alias("category"), "sum", "count")


def mapping_history(train: DataFrame, label: str = "label", fields: list[str] = MAPPING_FIELDS) -> DataFrame:
    long = train.select(label, *[normalize_key(f).alias(f) for f in fields]).unpivot([label], fields, "field", "key")
    return long.groupBy("field", "key").agg(F.sum(label).alias("sum"), F.count(label).alias("count"))


def smoothed(total: Column, n: Column, prior: Column, k: float) -> Column:
    return (total + k * prior) / (n + k)


def smoothed_lookup(query: DataFrame, history: DataFrame, key: list[str], prior: float | Column, k: float, name: str) -> DataFrame:
    """query with name, name_log_count and name_seen; unseen keys get the prior."""
    h = history.select(*key, F.col("sum").alias("__sum"), F.col("count").alias("__n"))
    joined = query.join(h, key, "left")
    total, n = F.coalesce("__sum", F.lit(0.0)), F.coalesce("__n", F.lit(0))
    prior = F.lit(prior) if isinstance(prior, float) else prior
    return joined.withColumns({name: smoothed(total, n, prior, k), f"{name}_log_count": F.log1p(n), f"{name}_seen": n > 0}).drop("__sum", "__n")


def guide_encoding(query: DataFrame, history: DataFrame, mean: DataFrame, k: float = GUIDE_K) -> DataFrame:
    """The eleven guide columns; conditional ones shrink to the guide's estimate, that one to the global mean (mean: one row, column mean)."""
    wide = history.groupBy("guide").agg(
        F.max_by("sum", F.col("reference_type") == "all").alias("s_all"), F.max_by("count", F.col("reference_type") == "all").alias("n_all"),
        *[F.sum(F.when(F.col("reference_type") == t, F.col(c))).alias(f"{c[0]}_{t}") for t in ("exact", "nonexact") for c in ("sum", "count")],
        *[F.sum(F.when((F.col("reference_type") == t) & (F.col("category") == v), F.col(c))).alias(f"{c[0]}_{t}_{v}") for t, vs in (("diffcat", ("exact", "one", "two_plus")), ("gapcat", ("gap", "no_gap"))) for v in vs for c in ("sum", "count")],
    )
    j = query.join(wide, "guide", "left").crossJoin(F.broadcast(mean.select(F.col("mean").alias("__mean"))))
    get = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pick = lambda c, t, vs: reduce(lambda a, v: F.when(F.col(t) == v, get(f"{c}_{t}_{v}")).otherwise(a), vs, F.lit(0.0))
    j = j.withColumn("te_guide_all", smoothed(get("s_all"), get("n_all"), F.col("__mean"), k))
    out = {"te_guide_all_log_count": F.log1p(get("n_all")), "te_guide_seen": (get("n_all") > 0).cast("double")}
    for t in ("exact", "nonexact"):
        out |= {f"te_guide_{t}_ref": smoothed(get(f"s_{t}"), get(f"c_{t}"), F.col("te_guide_all"), k), f"te_guide_{t}_log_count": F.log1p(get(f"c_{t}"))}
    for t, vs in (("diffcat", ("exact", "one", "two_plus")), ("gapcat", ("gap", "no_gap"))):
        out |= {f"te_guide_{t}": smoothed(pick("s", t, vs), pick("c", t, vs), F.col("te_guide_all"), k), f"te_guide_{t}_log_count": F.log1p(pick("c", t, vs))}
    return j.withColumns(out).select(*query.columns, "te_guide_all", *out)


def leave_one_out(fit: DataFrame, label: str = "label", k: float = GUIDE_K) -> DataFrame:
    """The eleven guide columns of the fit rows themselves, without their own label.

    fit is read twice, for sums by guide and for its rows: give a written or checkpointed table. All sums of a guide are one row, made by one
    aggregation and joined back, so a frequent guide is no group of its own.
    """
    y, groups = F.col(label), {"exactness": ("exact", "nonexact"), "diffcat": ("exact", "one", "two_plus"), "gapcat": ("gap", "no_gap")}
    sums = {f"{t}_{v}": F.col(t) == v for t, vs in groups.items() for v in vs}
    wide = fit.groupBy("guide").agg(
        F.sum(label).alias("s_all"), F.count(label).alias("n_all"), *[F.coalesce(F.sum(F.when(c, y)), F.lit(0.0)).alias(f"s_{n}") for n, c in sums.items()], *[F.count_if(c & y.isNotNull()).alias(f"n_{n}") for n, c in sums.items()]
    )
    total = wide.agg(F.sum("s_all").alias("__sum"), F.sum("n_all").alias("__n"))
    j = fit.join(wide, "guide").crossJoin(F.broadcast(total))
    own = lambda c, t: reduce(lambda a, v: F.when(F.col(t) == v, F.col(f"{c}_{t}_{v}")).otherwise(a), groups[t], F.lit(0))
    prior = (F.col("__sum") - y) / (F.col("__n") - 1)
    j = j.withColumn("te_guide_all", smoothed(F.col("s_all") - y, F.col("n_all") - 1, prior, k))
    out = {"te_guide_all_log_count": F.log1p(F.col("n_all") - 1), "te_guide_seen": (F.col("n_all") > 1).cast("double")}
    for t in ("exact", "nonexact"):
        member = (F.col("exactness") == t).cast("int")
        n = F.col(f"n_exactness_{t}") - member
        out |= {f"te_guide_{t}_ref": smoothed(F.col(f"s_exactness_{t}") - member * y, n, F.col("te_guide_all"), k), f"te_guide_{t}_log_count": F.log1p(n)}
    for t in ("diffcat", "gapcat"):
        out |= {f"te_guide_{t}": smoothed(own("s", t) - y, own("n", t) - 1, F.col("te_guide_all"), k), f"te_guide_{t}_log_count": F.log1p(own("n", t) - 1)}
    return j.withColumns(out).select(*fit.columns, "te_guide_all", *out)


def crossfit(fit: DataFrame, key: str, fold: str = "fold", label: str = "label", k: float = CROSSFIT_K) -> DataFrame:
    """key's encoding for each row from all other folds: complements of sums by key and fold, in one pass for all folds."""
    by = fit.groupBy(key, fold).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    keyed = by.groupBy(key).agg(F.sum("s").alias("ks"), F.sum("n").alias("kn"))
    folds = by.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = folds.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    prior = folds.crossJoin(F.broadcast(total)).select(fold, ((F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))).alias("prior"))
    coded = by.join(keyed, key).join(F.broadcast(prior), fold)
    n = F.col("kn") - F.col("n")
    coded = coded.select(key, fold, smoothed(F.col("ks") - F.col("s"), n, F.col("prior"), k).alias(f"{key}_te"), F.log1p(n).alias(f"{key}_log_count"))
    return fit.join(coded, [key, fold])


def interaction_key(a: str, b: str) -> Column:
    return F.concat_ws("||", normalize_key(a), normalize_key(b))


def fit_onehot(fit: DataFrame, fields: list[str]) -> DataFrame:
    """Vocabulary (field, key)."""
    return fit.select(*[normalize_key(f).alias(f) for f in fields]).unpivot([], fields, "field", "key").distinct()


def apply_onehot(query: DataFrame, vocabulary: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Active flags only: (record, field, key); keys that the fit rows lack have none."""
    return query.select(key, *[normalize_key(f).alias(f) for f in fields]).unpivot([key], fields, "field", "key").join(vocabulary, ["field", "key"], "left_semi").select(key, "field", "key")


def numeric_mapping(df: DataFrame, columns: list[str] = MAPPING_COUNTS) -> DataFrame:
    return df.withColumns({c: F.coalesce(coerce_numeric(c), F.lit(0.0)) for c in columns})


def medians(fit: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians; null for a column without numbers."""
    long = fit.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    got = quantiles(long, ["column"], "v", [0.5])
    return got.agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in columns])


def median_impute(query: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    m = F.broadcast(state.select(*[F.col(c).alias(f"__m_{c}") for c in columns]))
    return query.crossJoin(m).withColumns({c: F.coalesce(coerce_numeric(c), F.col(f"__m_{c}"), F.lit(0.0)) for c in columns}).select(*query.columns)


def active_columns(fit: DataFrame, columns: list[str]) -> DataFrame:
    """(column, active): whether a column has more than one value after filling with its median."""
    filled = median_impute(fit.select(*columns), medians(fit, columns), columns)
    one = filled.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "active")


def guide_support(query: DataFrame, fit: DataFrame) -> DataFrame:
    """guide_support_n: how many fit rows have a row's guide."""
    g = fit.groupBy("guide").agg(F.count("*").alias("__g"))
    return query.join(g, "guide", "left").select(*query.columns, F.coalesce("__g", F.lit(0)).alias("guide_support_n"))


def support_counts(query: DataFrame, fit: DataFrame, template_key: str = "mapping_candidate_template_nos") -> DataFrame:
    """guide_support_n and template_support_n (only of mapped rows with a real key)."""
    t = fit.where((F.col("mapping_hit_count") > 0) & (normalize_key(template_key) != "missing")).groupBy(template_key).agg(F.count("*").alias("__t"))
    out = guide_support(query, fit).join(t, template_key, "left")
    mapped = (F.col("mapping_hit_count") > 0) & (normalize_key(template_key) != "missing")
    return out.select(*query.columns, "guide_support_n", F.when(mapped, F.coalesce("__t", F.lit(0))).otherwise(0).alias("template_support_n"))


def anchors(df: DataFrame, guide: str = "te_guide_all", template: str = "te_template") -> DataFrame:
    return df.withColumns({"guide_anchor": F.col(guide), "template_anchor": F.col(template), "mixed_anchor": 0.5 * F.col(guide) + 0.5 * F.col(template)})


def reference_diagnostics(query: DataFrame, guides: DataFrame, mapping: DataFrame) -> DataFrame:
    """Whether and how often the reference has a row's guide and template key."""
    g = guides.where("reference_type = 'all'").select("guide", F.col("count").alias("__g"))
    m = mapping.where("field = 'mapping_candidate_template_nos'").select(F.col("key").alias("__key"), F.col("count").alias("__m"))
    j = query.withColumn("__key", normalize_key("mapping_candidate_template_nos")).join(g, "guide", "left").join(m, "__key", "left")
    g, m = F.coalesce("__g", F.lit(0)), F.coalesce("__m", F.lit(0))
    return j.select(*query.columns, (g > 0).alias("guide_seen"), g.alias("guide_reference_count"), (m > 0).alias("template_key_seen"), m.alias("template_reference_count"))


def save_state(path: str, fit: DataFrame, columns: list[str], label: str = "label") -> None:
    """What label-free rows need from the fit rows, as Parquet tables: histories, vocabulary, medians and the mean."""
    guide_history(fit, label).write.parquet(f"{path}/guide_history")
    mapping_history(fit, label).write.parquet(f"{path}/mapping_history")
    fit_onehot(fit, MAPPING_FIELDS).write.parquet(f"{path}/vocabulary")
    medians(fit, columns).write.parquet(f"{path}/medians")
    fit.agg(F.avg(label).alias("mean")).write.parquet(f"{path}/mean")


def apply_state(path: str, query: DataFrame, columns: list[str]) -> DataFrame:
    """query (guide, classes, mapping fields, numeric columns; no labels) filled and encoded by a saved state."""
    read = query.sparkSession.read.parquet
    mean = read(f"{path}/mean")
    out = guide_encoding(median_impute(query, read(f"{path}/medians"), columns), read(f"{path}/guide_history"), mean)
    histories = read(f"{path}/mapping_history")
    out = out.crossJoin(F.broadcast(mean.select(F.col("mean").alias("__prior"))))
    for f in MAPPING_FIELDS:
        h = histories.where(F.col("field") == f).select(F.col("key").alias("__k"), "sum", "count")
        out = smoothed_lookup(out.withColumn("__k", normalize_key(f)), h, ["__k"], F.col("__prior"), MAPPING_K, f"mapping_te_{f}").drop("__k")
    return out.drop("__prior")
