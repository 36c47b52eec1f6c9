"""Five metrics with average ranks, and descriptive evaluation tables.

SCC is the Pearson correlation of average ranks. Keys of at most CELL_ROWS rows are ranked by a plain window. Where a key has
more, its values are counted first: ranks are taken over different values with their weights, in cells between approximate quantiles that
continue from each other's totals, and joined back, so many tasks rank a single key, and a value that all rows share is one row; results are the
same. Row numbers of such keys come from ranges of the whole order, which continue from each other too. Quantiles of tables are read off them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, stored
from ..functions.sequences import r6

METRICS = ("SCC", "PCC", "RMSE", "MAE", "R2")
CELL_ROWS, CELLS = 1 << 18, 256
#: Edges of cells that are looked through together.
RUN = 16


def cells_for(df: DataFrame, keys: list[str], most: int = CELL_ROWS) -> int:
    """1 where no key has more rows than a task should sort; df is read for it: give a written or checkpointed table."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return 1 if largest <= most else CELLS


def _cells(df: DataFrame, keys: list[str], value: str, weight: Column, cells: int) -> DataFrame:
    """df with __cell, which stretch of its key's values a value is in, and __start, the weight of all lower ones."""
    if cells == 1:
        return df.withColumns({"__cell": F.lit(0), "__start": F.lit(0)})
    # written: approximate quantiles depend on the order in which tasks' parts arrive, and rows and totals must be cut at the same ones
    edges = stored(df.groupBy(*keys).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 20 * cells).alias("__e")))
    # edges ascend, so those below a value are whole runs, then some of the next run: 32 comparisons a row, not 255
    runs = F.transform(F.sequence(F.lit(0), F.lit(cells - 2), F.lit(RUN)), lambda i: F.slice("__e", i + 1, F.lit(RUN)))
    placed = df.join(edges.select(*keys, runs.alias("__edges")), keys).withColumn("__whole", F.size(F.filter("__edges", lambda r: F.element_at(r, -1) < F.col(value))))
    inside = F.size(F.filter(F.get("__edges", F.col("__whole")), lambda e: e < F.col(value)))
    placed = placed.withColumn("__cell", F.when(F.col("__whole") == -(-(cells - 1) // RUN), cells - 1).otherwise(RUN * F.col("__whole") + inside)).drop("__edges", "__whole")
    totals = placed.groupBy(*keys, "__cell").agg(F.sum(weight).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__cell", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, [*keys, "__cell"])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None, cells: int = 1) -> DataFrame:
    """df with the average rank of value within keys; with a weight, each row stands for so many.

    With several cells, df is read twice, for its values and for its rows: give a written or checkpointed table.
    """
    w = F.col(weight) if weight else F.lit(1)
    if cells == 1:
        order = Window.partitionBy(*keys).orderBy(value)
        upto, ties = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, 0)
        return df.withColumn(out, F.sum(w).over(upto) - (F.sum(w).over(ties) - 1) / 2.0)
    counted = cut(df.groupBy(*keys, value).agg(F.sum(w).alias("__c")))
    upto = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = _cells(counted, keys, value, F.col("__c"), cells)
    ranks = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), (F.col("__start") + F.sum("__c").over(upto) - (F.col("__c") - 1) / 2.0).alias(out))
    same = F.col(value).eqNullSafe(F.col("__v"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, same).drop(*[f"__k{i}" for i in range(len(keys))], "__v")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, cells: int | None = None) -> DataFrame:
    """df with row numbers from 0 within keys; df is read more than once: give a written or checkpointed table.

    Beyond one cell, rows are dealt out by ranges of keys and the whole order, however many are equal in its first column.
    """
    cells = cells or cells_for(df, keys)
    if cells == 1:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    by = [*keys, *order]
    # ids rise by one within a sorted partition, whose number is above bit 33
    own = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    here = own.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p")).agg(F.min("__id").alias("__lo"), F.count("*").alias("__n"))
    names = [f"__k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select(*names, "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo")).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return own.join(here, same).select(*df.columns, (F.col("__id") + F.col("__shift")).alias(out))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "q", cells: int | None = None) -> DataFrame:
    """keys and an array of exact quantiles, interpolated between neighbours; nulls don't count. No task holds a key's values."""
    rows = cut(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")))
    total = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("__n") - 1)).alias("at")) for i, s in enumerate(shares)])).alias("w")
    wanted = total.select(*keys, at).select(*keys, "w.i", F.floor("w.at").alias("lo"), (F.col("w.at") - F.floor("w.at")).alias("part"))
    wanted = wanted.select(*keys, "i", "part", F.explode(F.array(F.col("lo"), F.when(F.col("part") > 0, F.col("lo") + 1).otherwise(F.col("lo")))).alias("__at"), "lo").distinct()
    met = numbered(rows, keys, ["__v"], "__at", cells).join(F.broadcast(wanted), [*keys, "__at"])
    low, high = F.max(F.when(F.col("__at") == F.col("lo"), F.col("__v"))), F.max(F.when(F.col("__at") > F.col("lo"), F.col("__v")))
    each = met.groupBy(*keys, "i", "part").agg((low + F.coalesce((high - low) * F.col("part"), F.lit(0.0))).alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(out))


def correlation(a: str, b: str) -> Column:
    """Null where either column is constant or there is one row."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def error_metrics(y: str, p: str) -> dict[str, Column]:
    e = F.col(p) - F.col(y)
    return {"PCC": correlation(y, p), "RMSE": F.sqrt(F.avg(e * e)), "MAE": F.avg(F.abs(e)), "R2": F.when(F.min(y) != F.max(y), 1 - F.try_divide(F.avg(e * e), F.var_pop(y)))}


def finite(name: str) -> Column:
    x = F.col(name)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} is missing or not finite")).cast("double")).otherwise(x.cast("double"))


def five_metrics(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred", more: tuple[Column, ...] = (), cells: int | None = None) -> DataFrame:
    """Per key. cells: how many tasks rank a key; by its rows unless given. Labels or predictions that are missing or not finite are an error."""
    df = cut(df.withColumns({c: finite(c) for c in (y, p)}))
    cells = cells or cells_for(df, keys)
    ranked = average_rank(average_rank(df, keys, y, "__ry", cells=cells), keys, p, "__rp", cells=cells)
    cols = {"SCC": correlation("__ry", "__rp")} | error_metrics(y, p)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), *more, *[c.alias(n) for n, c in cols.items()])


def with_levels(df: DataFrame, fold: str = "outer_fold") -> DataFrame:
    """Every row twice: at level pooled and at its fold's, so that ranks are taken in each."""
    return df.withColumn("level", F.explode(F.array(F.lit("pooled"), F.concat(F.lit("fold_"), F.col(fold).cast("string")))))


def metrics_by_fold(predictions: DataFrame) -> DataFrame:
    rows = with_levels(predictions.select("model_id", "outer_fold", "group_id", "y_true", "y_pred"))
    return five_metrics(rows, ["model_id", "level"], more=(F.count_distinct("group_id").alias("n_groups"),))


def metric_delta(metrics: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    x, y = metrics.where(F.col("model_id") == a).alias("x"), metrics.where(F.col("model_id") == b).alias("y")
    return x.join(y, keys).select(*keys, *[(F.col(f"x.{m}") - F.col(f"y.{m}")).alias(f"delta_{m}") for m in METRICS])


def tail_bias(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean error in the top and bottom tenth of labels, and the range of predictions."""
    predictions = cut(predictions.select(*keys, "y_true", "y_pred"))
    q = quantiles(predictions, keys, "y_true", [0.1, 0.9]).join(predictions.groupBy(*keys).agg((F.max("y_pred") - F.min("y_pred")).alias("prediction_range")), keys)
    e = F.col("y_pred") - F.col("y_true")
    j = predictions.join(F.broadcast(q), keys)
    return j.groupBy(*keys).agg(F.avg(F.when(F.col("y_true") <= F.col("q")[0], e)).alias("bottom_bias"), F.avg(F.when(F.col("y_true") >= F.col("q")[1], e)).alias("top_bias"), F.first("prediction_range").alias("prediction_range"))


def constant_folds(predictions: DataFrame) -> DataFrame:
    """Share of folds in which a model predicts one value only."""
    per = predictions.groupBy("model_id", "outer_fold").agg((F.max("y_pred") == F.min("y_pred")).cast("double").alias("c"))
    return per.groupBy("model_id").agg(F.avg("c").alias("constant_fraction"))


def component_correlation(wide: DataFrame, pairs: list[tuple[str, str]], y: str = "y_true") -> DataFrame:
    """For pairs of components, correlations of predictions and of residuals, pooled and by fold."""
    made = [F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(k).alias("kind"), (F.col(a) - s).alias("a"), (F.col(b) - s).alias("b")) for a, b in pairs for k, s in (("prediction", F.lit(0.0)), ("residual", F.col(y)))]
    long = with_levels(wide.select("outer_fold", F.explode(F.array(*made)).alias("x")).select("outer_fold", "x.*"))
    keys = ["pair", "kind", "level"]
    return five_metrics(long.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)}), keys, "a", "b").select(*keys, "n", "SCC", "PCC")


def within_group_rank(predictions: DataFrame, least: int = 5) -> DataFrame:
    """Per model: quartiles of the SCC within groups of at least `least` records, and undefined groups."""
    sized = predictions.join(predictions.groupBy("model_id", "group_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("model_id", "group_id"), ["model_id", "group_id"])
    per = five_metrics(sized, ["model_id", "group_id"])
    per = cut(per.select("model_id", "SCC"))
    q = quantiles(per, ["model_id"], "SCC", [0.25, 0.5, 0.75])
    counts = per.groupBy("model_id").agg(F.count("*").alias("groups"), F.count_if(F.col("SCC").isNull()).alias("undefined"))
    return counts.join(q, "model_id", "left").select("model_id", "groups", "undefined", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def exact_bin(df: DataFrame, keys: list[str], order: list[str], bins: int, out: str) -> DataFrame:
    """Bins of sizes at most one apart, as ntile; rows are numbered by value within cells that continue from each other."""
    df = cut(df)
    j = numbered(df, keys, order, "__i").join(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    size, extra = F.floor(F.col("__n") / bins), F.col("__n") % bins
    wide = extra * (size + 1)
    tile = F.when(F.col("__i") < wide, F.floor(F.col("__i") / (size + 1))).otherwise(extra + F.floor((F.col("__i") - wide) / F.greatest(size, F.lit(1)))) + 1
    return j.withColumn(out, tile.cast("int")).select(*df.columns, out)


def bin_table(binned: DataFrame, keys: list[str], by: str) -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    return binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"), F.avg(e).alias("signed_error"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    return bin_table(exact_bin(predictions, ["model_id"], ["y_pred", "record_id"], bins, "bin"), ["model_id"], "y_pred")


def observed_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of records by label, the same for all models."""
    one = predictions.groupBy("record_id").agg(F.min("y_true").alias("y"))
    of = exact_bin(one.withColumn("__k", F.lit(0)), ["__k"], ["y", "record_id"], bins, "bin").select("record_id", "bin")
    return bin_table(predictions.join(of, "record_id"), ["model_id"], "y_true")


def quantile_bins(predictions: DataFrame, bins: int = 5) -> DataFrame:
    """Bins between quantiles of the predictions, closed on the right; the lowest value is in the first."""
    predictions = cut(predictions)
    q = quantiles(predictions, ["model_id"], "y_pred", [i / bins for i in range(1, bins)], "edges")
    j = predictions.join(F.broadcast(q), "model_id").withColumn("bin", (F.size(F.filter("edges", lambda x: x < F.col("y_pred"))) + 1).cast("int"))
    return bin_table(j, ["model_id"], "y_pred")


def history_strata(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per guide-seen and template-seen: rows, their share, both models' metrics and the difference of SCC."""
    keys = ["guide_seen", "template_key_seen"]
    long = df.select(*keys, "y_true", F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.col(m).alias("y_pred")) for n, m in (("a", a), ("b", b))])).alias("x")).select(*keys, "y_true", "x.*")
    m = five_metrics(long, [*keys, "which"])
    x, y = m.where("which = 'a'").alias("x"), m.where("which = 'b'").alias("y")
    total = df.agg(F.count("*").alias("total"))
    return x.join(y, keys).crossJoin(F.broadcast(total)).select(*keys, F.col("x.n").alias("n"), (F.col("x.n") / F.col("total")).alias("fraction"), F.col("x.SCC").alias("SCC_a"), F.col("y.SCC").alias("SCC_b"), F.col("x.MAE").alias("MAE_a"), F.col("y.MAE").alias("MAE_b"), (F.col("x.SCC") - F.col("y.SCC")).alias("delta_SCC"))


def candidate_strata(df: DataFrame, least: int = 10) -> DataFrame:
    """Metrics by the number of candidate templates; not estimable below `least` rows."""
    c = F.col("mapping_template_count")
    s = F.when(c == 0, "0").when(c == 1, "1").when(c <= 3, "2-3").when(c <= 8, "4-8").otherwise("9+")
    m = five_metrics(df.withColumn("stratum", s), ["stratum"])
    return m.select("stratum", "n", *[F.when(F.col("n") >= least, F.col(x)).alias(x) for x in METRICS], (F.col("n") >= least).alias("estimable"))


def support_summary(df: DataFrame, keys: list[str], support: str) -> DataFrame:
    df = cut(df.select(*keys, support))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(support) == 0).alias("zero"), F.avg((F.col(support) == 0).cast("double")).alias("zero_fraction"), F.max(support).alias("max"))
    q = quantiles(df, keys, support, [0.25, 0.5, 0.75])
    return counts.join(q, keys, "left").select(*keys, "n", "zero", "zero_fraction", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max")


def support_distribution(df: DataFrame, support: str) -> DataFrame:
    """By value of a support count and whether a target is mapped: rows, groups and metrics."""
    return five_metrics(df, [support, "mapped"], more=(F.count_distinct("group_id").alias("n_groups"),))


def route_counts(predictions: DataFrame) -> DataFrame:
    n = predictions.groupBy("model_id", "prediction_route").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("model_id")))


def win_rate(wide: DataFrame, a: str, b: str, y: str = "y_true") -> DataFrame:
    """Share of rows on which a is nearer to the label than b."""
    return wide.agg(F.avg((F.abs(F.col(a) - F.col(y)) < F.abs(F.col(b) - F.col(y))).cast("double")).alias("win_rate"))


def metric_rank_profile(metrics: DataFrame) -> DataFrame:
    """Rank of the models per metric, 1 the best; undefined values are last."""
    long = metrics.select("model_id", *METRICS).unpivot(["model_id"], list(METRICS), "metric", "value")
    good = F.when(F.col("metric").isin("RMSE", "MAE"), -F.col("value")).otherwise(F.col("value"))
    return long.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(good.desc_nulls_last())))


def density_2d(predictions: DataFrame, width: float) -> DataFrame:
    return predictions.groupBy("model_id", F.floor(F.col("y_true") / width).alias("bx"), F.floor(F.col("y_pred") / width).alias("by")).agg(F.count("*").alias("n"))


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to 6 places."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
