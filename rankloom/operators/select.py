"""Weight grids, candidate scores and nested selection.

A candidate's prediction is linear in its components, so PCC, RMSE and MAE of candidates are cheap; SCC needs ranks of
each candidate's predictions and is the work: a fold's rows go to tasks as arrays, each task takes a share of the candidates.
The grid is a parameter of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, ship
from .arrays import _CHUNK, ARRAY_ROWS, counted, packed, places, unpacked, value_ranks
from .metrics import average_rank, cells_for, correlation, error_metrics, finite
from .quality import max_abs_diff

TOLERANCE = 1e-12


def simplex_grid(spark: SparkSession, n: int, step: float, extras: tuple[tuple[float, ...], ...] = ()) -> DataFrame:
    """Closed grid (w1 ... wn) of weights that add up to 1, with extras, each once at 12 digits, numbered in order."""
    units = round(1 / step)
    if n not in (2, 3) or abs(units * step - 1) > TOLERANCE:
        raise ValueError("2 or 3 components, and a step that divides 1")
    i, j = spark.range(units + 1).toDF("i"), spark.range(units + 1).toDF("j")
    if n == 2:
        grid = i.select((F.col("i") / units).alias("w1"), ((units - F.col("i")) / units).alias("w2"))
    else:
        grid = i.crossJoin(F.broadcast(j)).where(F.col("i") + F.col("j") <= units).select((F.col("i") / units).alias("w1"), (F.col("j") / units).alias("w2"), ((units - F.col("i") - F.col("j")) / units).alias("w3"))
    names = [f"w{k + 1}" for k in range(n)]
    if extras:
        grid = grid.unionByName(spark.createDataFrame([tuple(map(float, e)) for e in extras], ", ".join(f"{x} double" for x in names)))
    return grid.groupBy(*[F.round(x, 12).alias(f"__{x}") for x in names]).agg(*[F.min(x).alias(x) for x in names]).select(*names)


def _rank_sums(key: np.ndarray, bits: int, ry: np.ndarray) -> tuple[float, float, int]:
    """Of a sorted array of (value, label's place) pairs, the place in the lowest bits: sum of products of the values' ranks with ry, sum of their squares, and how many values there are."""
    n, lo, cross, spread, values = len(key), 0, 0.0, 0.0, 0
    while lo < n:
        hi = min(lo + _CHUNK, n)
        hi = int(np.searchsorted(key, ((key[hi - 1] >> bits) + 1) << bits))  # a value's rows stay together
        part = key[lo:hi] >> bits
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        times = np.diff(np.append(first, hi - lo)).astype(float)
        rp = lo + first + (times + 1) / 2.0 - (n + 1) / 2.0  # about their mean, whatever the ties
        cross += float(np.add.reduceat(ry[key[lo:hi] & ((1 << bits) - 1)], first) @ rp)
        spread += float((times * rp * rp).sum())
        values, lo = values + len(first), hi
    return cross, spread, values


def _block_scores(grid: np.ndarray, blocks: int, kind: pa.DataType) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """Metrics of a block of candidates on one fold of packed columns; labels are ranked once, predictions by one sorting each, in place, of whole numbers that hold the label's place too."""

    def scored(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        y, *c = (unpacked(part[n], np.float64) for n in ("__y", *(f"__c{k}" for k in range(grid.shape[1]))))
        n, block = len(y), key[1].as_py()
        del part
        (iy,), many = places(y)
        held = counted(iy, many)
        ry = value_ranks(held) - (n + 1) / 2.0  # about their mean, whatever the ties
        spread_y, flat, my = float((held * ry * ry).sum()), many < 2, y.mean()
        values = np.empty(many)
        values[iy] = y
        yy, bits, means = float((held * (values - my) ** 2).sum()), max(many - 1, 1).bit_length(), [x.mean() for x in c]
        del y, held
        at, out = np.empty(n, np.int64), []

        def predicted(weights: np.ndarray, lo: int) -> np.ndarray:
            p = weights[0] * c[0][lo : lo + _CHUNK]
            for w, x in zip(weights[1:], c[1:], strict=True):
                p += w * x[lo : lo + _CHUNK]
            return np.round(p, 9, out=p)

        for i in range(block, len(grid), blocks):
            middle, sums, wide = float(grid[i] @ means), np.zeros(5), 0.0
            for lo in range(0, n, _CHUNK):
                p, own = predicted(grid[i], lo), values[iy[lo : lo + _CHUNK]]
                e, dp = p - own, p - middle
                sums += [dp.sum(), dp @ dp, dp @ (own - my), e @ e, np.abs(e).sum()]
                p *= 1e9
                wide = max(wide, np.abs(p).max())
                with np.errstate(invalid="ignore"):
                    at[lo : lo + _CHUNK] = np.rint(p, out=p)
            low, high = int(at.min()), int(at.max())
            if not wide < 1 << 53 or (high - low).bit_length() + bits > 63:  # whole numbers don't hold them: places do
                (ip,), _ = places(np.concatenate([predicted(grid[i], lo) for lo in range(0, n, _CHUNK)]))
                at[:], low = ip, 0
                del ip
            at -= low
            at <<= bits
            at |= iy
            at.sort()
            cross, spread, different = _rank_sums(at, bits, ry)
            none = flat or different < 2
            s, ss, sy, ee, ae = map(float, sums)
            scc = None if none else cross / float(np.sqrt(spread_y * spread))
            pcc = None if none else sy / float(np.sqrt((ss - s * s / n) * yy))
            out.append((i, n, scc, pcc, (ee / n) ** 0.5, ae / n, None if flat else 1 - ee / yy))
        names = ["__w", "n", "SCC", "PCC", "RMSE", "MAE", "R2"]
        columns = {n: pa.array([r[k] for r in out], pa.int64() if k < 2 else pa.float64()) for k, n in enumerate(names)}
        return pa.table({"__fold": pa.array([key[0].as_py()] * len(out), kind)} | columns)

    return scored


def score_grid(rows: DataFrame, grid: DataFrame, components: list[str], fold: str = "inner_fold", y: str = "y_true", most: int = ARRAY_ROWS) -> DataFrame:
    """Metrics of every candidate on every fold; labels and components must be numbers.

    A fold of at most `most` rows goes to tasks as arrays, each with its own share of the candidates, so rows are shuffled once a task, as packed columns, and not once a candidate. A larger
    fold is ranked by windows over rows and candidates, in cells. The grid is a parameter: its candidates are sent with the tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [f"w{k + 1}" for k in range(len(components))]
    base = cut(rows.select(fold, y, *components))
    sizes = base.groupBy(fold).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("folds")).first()
    if (sizes["most"] or 0) > most:
        return _scores_by_windows(base, grid, components, fold, y)
    candidates = np.array(sorted(tuple(r) for r in grid.select(*names).collect()), float).reshape(-1, len(components))
    blocks = max(1, min(-(-len(candidates) // 8), -(-2 * spark.sparkContext.defaultParallelism // max(sizes["folds"], 1))))
    kind = base.schema[fold].dataType
    made = base.select(F.col(fold).alias("__fold"), F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__c{k}") for k, c in enumerate(components)])
    made = made.mapInArrow(packed, ", ".join([f"__fold {kind.simpleString()}", *(f"{c} binary" for c in made.columns[1:])]))
    made = made.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")).repartition(4 * blocks * max(sizes["folds"], 1), "__fold", "__block")
    arrow = base.select(fold).limit(0).toArrow().schema.field(0).type
    got = made.groupBy("__fold", "__block").applyInArrow(_block_scores(candidates, blocks, arrow), f"__fold {kind.simpleString()}, __w long, n long, SCC double, PCC double, RMSE double, MAE double, R2 double")
    known = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(candidates)], ", ".join(["__w long", *(f"{x} double" for x in names)]))
    return got.join(F.broadcast(known), "__w").select(*names, F.col("__fold").alias(fold), "n", "SCC", "PCC", "RMSE", "MAE", "R2")


def _scores_by_windows(base: DataFrame, grid: DataFrame, components: list[str], fold: str, y: str) -> DataFrame:
    names = [f"w{k + 1}" for k in range(len(components))]
    cells = cells_for(base, [fold])
    ranked = average_rank(base, [fold], y, "__ry", cells=cells)
    numbered_grid = cut(grid.select(*names, F.monotonically_increasing_id().alias("__w")))
    value = reduce(lambda a, b: a + b, (F.col(w) * F.col(c) for w, c in zip(names, components, strict=True)))
    made = ranked.crossJoin(F.broadcast(numbered_grid)).select("__w", fold, y, "__ry", F.round(value, 9).alias("y_pred"))
    made = average_rank(cut(made) if cells > 1 else made, ["__w", fold], "y_pred", "__rp", cells=cells)
    scores = made.groupBy("__w", fold).agg(F.count("*").alias("n"), correlation("__ry", "__rp").alias("SCC"), *[c.alias(n) for n, c in error_metrics(y, "y_pred").items()])
    return scores.join(F.broadcast(numbered_grid), "__w").select(*names, fold, "n", "SCC", "PCC", "RMSE", "MAE", "R2")


def summarize(scores: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """Means over folds; the mean SCC only where all folds define it."""
    return scores.groupBy(*keys).agg(F.when(F.count("SCC") == folds, F.avg("SCC")).alias("mean_SCC"), F.avg("MAE").alias("mean_MAE"))


def _keep(df: DataFrame, value: str, best: Column, sign: int, tolerance: float) -> DataFrame:
    b = df.agg(best.alias("__best"))
    return df.crossJoin(F.broadcast(b)).where((F.col(value) - F.col("__best")) * sign <= tolerance).drop("__best")


def _best(summary: DataFrame, tolerance: float) -> DataFrame:
    """Staged: highest mean SCC within tolerance (lowest MAE where none is defined), then lowest MAE."""
    state = summary.agg((F.count("mean_SCC") > 0).alias("__use"))
    s = summary.crossJoin(F.broadcast(state)).where(~F.col("__use") | F.col("mean_SCC").isNotNull()).withColumn("__goal", F.when(F.col("__use"), -F.col("mean_SCC")).otherwise(F.col("mean_MAE")))
    return _keep(_keep(s, "__goal", F.min("__goal"), 1, tolerance), "mean_MAE", F.min("mean_MAE"), 1, tolerance).drop("__use", "__goal")


def choose_weights(summary: DataFrame, original: tuple[float, ...], tolerance: float = TOLERANCE) -> DataFrame:
    """One row: the winner, ties to the least distance from the original weights, then the first in order."""
    names = [f"w{k + 1}" for k in range(len(original))]
    far = reduce(lambda a, b: a + b, (F.abs(F.col(n) - w) for n, w in zip(names, original, strict=True)))
    return _keep(_best(summary, tolerance).withColumn("l1", far), "l1", F.min("l1"), 1, tolerance).orderBy(*names).limit(1)


def choose_family(summary: DataFrame, order: list[tuple[str, int]], tolerance: float = TOLERANCE) -> DataFrame:
    """One row: ties to fewer learners, then the declared order."""
    named = summary.sparkSession.createDataFrame([(f, n, i) for i, (f, n) in enumerate(order)], "family string, n_learners int, family_index int")
    return _best(summary.join(F.broadcast(named), "family"), tolerance).orderBy("n_learners", "family_index").limit(1)


#: grids' frozen weights, learners of each family.
D_ORIGINAL, DB_ORIGINAL, TRI_ORIGINAL = (0.35, 0.59, 0.06), (0.30, 0.70), (0.20, 0.47, 0.33)
FAMILIES = [("D", 3), ("SEQ_MAPPING_XGB", 1), ("D_B", 8), ("D_B_C", 9)]


def with_d(rows: DataFrame, weights: DataFrame, name: str = "D") -> DataFrame:
    w = weights.select(*[F.col(f"w{k}").alias(f"__w{k}") for k in (1, 2, 3)])
    return rows.crossJoin(F.broadcast(w)).withColumn(name, F.col("__w1") * F.col("D_xgb") + F.col("__w2") * F.col("D_lightgbm") + F.col("__w3") * F.col("D_mlp")).drop("__w1", "__w2", "__w3")


def _chosen(df: DataFrame) -> DataFrame:
    """A one-row table as literals, so that what follows doesn't run its search again."""
    r = df.first()
    return df.sparkSession.createDataFrame([tuple(r)], df.schema)


def select_policy(rows: DataFrame, step: float, folds: int = 4) -> DataFrame:
    """One row: D weights; D/B and D/B/C weights given D; the family that wins. rows: components of the inner folds."""
    return policy_and_family(rows, step, folds)[0]


def policy_and_family(rows: DataFrame, step: float, folds: int = 4) -> tuple[DataFrame, DataFrame]:
    """The policy, and the row of the family that wins with its means."""
    spark = rows.sparkSession
    ids = rows.groupBy("record_id").agg(F.min("inner_fold").alias("lo"), F.max("inner_fold").alias("hi")).agg(F.count("lo").alias("known"), F.count_if(F.col("lo") != F.col("hi")).alias("many")).first()
    if not ids["known"] or ids["many"] or rows.select("inner_fold").distinct().count() != folds:
        raise ValueError(f"{folds} disjoint inner folds are needed")
    d = _chosen(choose_weights(summarize(score_grid(rows, simplex_grid(spark, 3, step, (D_ORIGINAL,)), ["D_xgb", "D_lightgbm", "D_mlp"]), ["w1", "w2", "w3"], folds), D_ORIGINAL))
    made = with_d(rows, d)
    db = _chosen(choose_weights(summarize(score_grid(made, simplex_grid(spark, 2, step, (DB_ORIGINAL,)), ["D", "B"]), ["w1", "w2"], folds), DB_ORIGINAL))
    tri = _chosen(choose_weights(summarize(score_grid(made, simplex_grid(spark, 3, step, (TRI_ORIGINAL,)), ["D", "B", "C"]), ["w1", "w2", "w3"], folds), TRI_ORIGINAL))
    b, t = db.first(), tri.first()
    scored = family_scores(made, (b["w1"], b["w2"]), (t["w1"], t["w2"], t["w3"]))
    fam = cut(choose_family(summarize(scored, ["family"], folds), FAMILIES))
    pick = lambda x, p, n: x.select(*[F.col(f"w{k}").alias(f"{p}{k}") for k in range(1, n + 1)])
    return pick(d, "d_w", 3).crossJoin(pick(db, "db_w", 2)).crossJoin(pick(tri, "tri_w", 3)).crossJoin(fam.select("family")), fam


def replay_selection(rows: DataFrame, stored: DataFrame, step: float, folds: int = 4, tolerance: float = 1e-10) -> DataFrame:
    """A stored policy against the one that the inner folds' components give again: per weight, whether both agree; and the family."""
    again = select_policy(rows, step, folds)
    weights = [c for c in again.columns if c != "family"]
    numbers = max_abs_diff(again.withColumn("k", F.lit(0)), stored.withColumn("k", F.lit(0)), ["k"], weights, tolerance).select("column", F.col("within").alias("agrees"))
    family = again.select(F.col("family").alias("a")).crossJoin(F.broadcast(stored.select(F.col("family").alias("b")))).select(F.lit("family").alias("column"), F.col("a").eqNullSafe(F.col("b")).alias("agrees"))
    return numbers.unionByName(family)


def family_scores(made: DataFrame, db: tuple[float, float], tri: tuple[float, float, float]) -> DataFrame:
    """Metrics of each family on each inner fold: candidates of one grid, whose components are D, SEQ_MAPPING_XGB, B and C. Values that are missing or not finite are an error."""
    names = ["D", "SEQ_MAPPING_XGB", "B", "C"]
    weights = {"D": (1.0, 0.0, 0.0, 0.0), "SEQ_MAPPING_XGB": (0.0, 1.0, 0.0, 0.0), "D_B": (db[0], 0.0, db[1], 0.0), "D_B_C": (tri[0], 0.0, tri[1], tri[2])}
    columns = ", ".join(f"w{k + 1} double" for k in range(len(names)))
    named = made.sparkSession.createDataFrame([(f, *map(float, w)) for f, w in weights.items()], f"family string, {columns}")
    known = made.select("inner_fold", *[finite(c).alias(c) for c in ("y_true", *names)])
    scores = score_grid(known, named.drop("family").distinct(), names)  # families of the same weights are one candidate
    return scores.join(F.broadcast(named), [f"w{k + 1}" for k in range(len(names))]).select("family", "inner_fold", "n", "SCC", "PCC", "RMSE", "MAE", "R2")


def apply_policy(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Long predictions of chosen and frozen weights, routed: unmapped rows fall back to D."""
    p = rows.crossJoin(F.broadcast(policy))
    d = lambda w: sum(w_ * F.col(c) for w_, c in zip(w, ("D_xgb", "D_lightgbm", "D_mlp"), strict=True))
    chosen, frozen = d([F.col(f"d_w{k}") for k in (1, 2, 3)]), d([F.lit(x) for x in D_ORIGINAL])
    db = F.col("db_w1") * chosen + F.col("db_w2") * F.col("B")
    tri = F.col("tri_w1") * chosen + F.col("tri_w2") * F.col("B") + F.col("tri_w3") * F.col("C")
    mapped = F.col("mapping_found")
    routed = lambda v, back: F.when(mapped, v).otherwise(back)
    policy_value = F.when(F.col("family") == "D", chosen).when(F.col("family") == "SEQ_MAPPING_XGB", F.col("SEQ_MAPPING_XGB")).when(F.col("family") == "D_B", routed(db, chosen)).otherwise(routed(tri, chosen))
    made = {
        "D_SELECTED": (chosen, False), "D_FROZEN": (frozen, False), "DB_SELECTED": (routed(db, chosen), True), "DB_FROZEN": (routed(DB_ORIGINAL[0] * frozen + DB_ORIGINAL[1] * F.col("B"), frozen), True),
        "TRI_SELECTED": (routed(tri, chosen), True), "TRI_FROZEN": (routed(TRI_ORIGINAL[0] * frozen + TRI_ORIGINAL[1] * F.col("B") + TRI_ORIGINAL[2] * F.col("C"), frozen), True),
        "SEQ_MAPPING_XGB": (F.col("SEQ_MAPPING_XGB"), False), "POLICY": (policy_value, True),
    }
    row = lambda n, v, r: F.struct(F.lit(n).alias("model_id"), v.alias("y_pred"), (F.when(mapped, "fusion").otherwise("fallback") if r else F.lit("single")).alias("prediction_route"))
    return p.select("record_id", "y_true", F.explode(F.array(*[row(n, v, r) for n, (v, r) in made.items()])).alias("x")).select("record_id", "y_true", "x.*")


def blend_grid(wide: DataFrame, a: str, b: str, step: float = 0.01, y: str = "y_true", most: int = ARRAY_ROWS) -> DataFrame:
    """Metrics of (1 - alpha) a + alpha b over a grid of alpha."""
    units = round(1 / step)
    alphas = wide.sparkSession.createDataFrame([(1 - i / units, i / units) for i in range(units + 1)], "w1 double, w2 double")
    scores = score_grid(wide.select(F.lit(0).alias("__all"), y, a, b), alphas, [a, b], "__all", y, most)
    return scores.select(F.col("w2").alias("alpha"), "n", "SCC", "PCC", "RMSE", "MAE", "R2")


def best_blend(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("SCC"), "RMSE", "alpha").limit(1)


def crossfit_weights(scores: DataFrame, names: list[str], fold: str, folds: int) -> DataFrame:
    """For each fold, the weights with the best mean SCC on the others, and their SCC on it."""
    held = scores.select(F.col(fold).alias("held")).distinct()
    others = scores.crossJoin(F.broadcast(held)).where(F.col(fold) != F.col("held"))
    means = others.groupBy("held", *names).agg(F.when(F.count("SCC") == folds - 1, F.avg("SCC")).alias("m"))
    best = means.groupBy("held").agg(F.max(F.struct(F.round("m", 9).alias("m"), *[(-F.col(n)).alias(n) for n in names])).alias("b")).select("held", F.col("b.m").alias("others_SCC"), *[(-F.col(f"b.{n}")).alias(n) for n in names])
    own = scores.select(F.col(fold).alias("held"), *names, F.col("SCC").alias("held_SCC"))
    return best.join(own, ["held", *names])


def near_optimal(summary: DataFrame, names: list[str], eps: float) -> DataFrame:
    """How many candidates are within eps of the best mean SCC, and the ranges of their weights."""
    best = summary.agg(F.max("mean_SCC").alias("best"))
    near = summary.crossJoin(F.broadcast(best)).where(F.col("best") - F.col("mean_SCC") <= eps)
    return near.agg(F.count("*").alias("n"), F.max("best").alias("best"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])


def selection_frequency(policies: DataFrame) -> DataFrame:
    return policies.groupBy("family").agg(F.count("*").alias("n"))


def promotion_gate(metrics: DataFrame, baseline: str, gain: float, rmse_slack: float, folds: int) -> DataFrame:
    """Per model: pooled gain over the baseline, RMSE guard, number of folds with a gain, and whether it passes."""
    base = metrics.where(F.col("model_id") == baseline).select("level", F.col("SCC").alias("b_SCC"), F.col("RMSE").alias("b_RMSE"))
    j = metrics.where(F.col("model_id") != baseline).join(base, "level")
    pooled = F.col("level") == "pooled"
    out = j.groupBy("model_id").agg(F.max(F.when(pooled, F.col("SCC") - F.col("b_SCC"))).alias("delta_SCC"), F.max(F.when(pooled, F.col("RMSE") - F.col("b_RMSE"))).alias("delta_RMSE"), F.count_if(~pooled & (F.col("SCC") > F.col("b_SCC"))).alias("better_folds"))
    return out.withColumn("passes", F.coalesce((F.col("delta_SCC") >= gain) & (F.col("delta_RMSE") <= rmse_slack) & (F.col("better_folds") >= folds), F.lit(False)))


