"""Blending, routing, warnings and ranks of component predictions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, stored
from .metrics import _cells, cells_for

#: Weights of the released blends.
D_WEIGHTS = {"d_xgb": 0.35, "d_lgbm": 0.59, "d_mlp": 0.06}
FULL_WEIGHTS = {"d": 0.20, "b": 0.47, "c": 0.33}
ROUTES = ("mapping_dbc_v2", "sequence_d_fallback_v2")


def blend(weights: dict[str, float]) -> Column:
    """Weights are decimals: a decimal component's share is exact, as in SQL; a double's is a product of doubles."""
    return sum((F.lit(Decimal(str(w))) * F.col(c) for c, w in weights.items()), F.lit(0.0))


def routed_fusion(df: DataFrame, weights: dict[str, float] = FULL_WEIGHTS, hits: str = "mapping_hit_count") -> DataFrame:
    """The full blend where a target is mapped, d alone elsewhere, with route and status."""
    mapped = F.col(hits) > 0
    return df.withColumns({
        "prediction_full": F.when(mapped, blend(weights)), "activity_score": F.when(mapped, blend(weights)).otherwise(F.col("d")),
        "model_route": F.when(mapped, ROUTES[0]).otherwise(ROUTES[1]), "prediction_status": F.when(mapped, "success").otherwise("fallback_success"),
    })


def profiles() -> dict[str, tuple[Column, str | None]]:
    """The sixteen fusion variants, by name: value, and the route of all rows, or None where unmapped rows fall back to d."""
    part = lambda *names: blend({k: FULL_WEIGHTS[k] for k in names}) / round(sum(FULL_WEIGHTS[k] for k in names), 2)
    db, dc, bc = part("d", "b"), part("d", "c"), part("b", "c")
    single = {"D": (F.col("d"), "sequence"), "B": (F.col("b"), "context"), "C": (F.col("c"), "context"), "HISTORY_PRIOR": (F.col("history_prior"), "history_prior"), "SEQ_MAPPING_XGB": (F.col("seq_mapping"), "context")}
    fixed = {"FULL": blend(FULL_WEIGHTS), "D_B_FIXED": db, "D_C_FIXED": dc, "B_C_FIXED": bc}
    removed = {"WITHOUT_D": bc, "WITHOUT_B": dc, "WITHOUT_C": db}
    return single | {k: (v, None) for k, v in (fixed | removed).items()} | {f"{k}_UNROUTED": (v, "context") for k, v in fixed.items()}


def fusion_profiles(df: DataFrame, hits: str = "mapping_hit_count") -> DataFrame:
    """Long: record_id, profile, route, y_pred; df has d, b, c, history_prior and seq_mapping."""
    mapped = F.col(hits) > 0
    rows = []
    for name, (value, route) in profiles().items():
        routed = value if route else F.when(mapped, value).otherwise(F.col("d"))
        rows.append(F.struct(F.lit(name).alias("profile"), (F.lit(route) if route else F.when(mapped, "context").otherwise("sequence_fallback")).alias("route"), routed.alias("y_pred")))
    return df.select("record_id", F.explode(F.array(*rows)).alias("x")).select("record_id", "x.*")


#: Route and version of the models that may be primary instead of the full blend.
COMPARISON_ROUTES = {"d": ("sequence_d_v1_5", "1.5.0"), "legacy": ("sequence_xgboost_v1_0_legacy", "1.0.0")}


def primary_score(df: DataFrame, primary: str = "full", version: str = "2.0.0", legacy: str = "d_xgb") -> DataFrame:
    """activity_score, model_route, prediction_status and model_version under a primary model: full (routed), d or legacy."""
    if primary == "full":
        return routed_fusion(df).withColumn("model_version", F.lit(version))
    route, own = COMPARISON_ROUTES[primary]
    return df.withColumns({"activity_score": F.col("d" if primary == "d" else legacy), "model_route": F.lit(route), "prediction_status": F.lit("success"), "model_version": F.lit(own)})


def warning_codes(mixed: Column | None = None) -> Column:
    """Ordered `;` list; needs hits, counts, confidence and diagnostics in the row."""
    mapped = F.col("mapping_hit_count") > 0
    codes = [  # fixed values: the codes, in order
        (~mapped, "W_MAPPING_NOT_FOUND"), (~mapped, "W_SEQUENCE_D_FALLBACK"), (mapped & ~F.col("guide_seen"), "W_GUIDE_NOT_IN_TRAIN_REFERENCE"), (mapped & ~F.col("template_key_seen"), "W_TEMPLATE_KEY_NOT_IN_TRAIN_REFERENCE"),
        (mapped & (F.col("mapping_template_count") > 1), "W_MAPPING_MULTIPLE_CANDIDATES"), (mapped & (F.col("mapping_group_count") > 1), "W_MAPPING_MULTIPLE_GROUPS"), (mapped & (F.col("mapping_confidence") == "review"), "W_MAPPING_REVIEW"),
        (mixed if mixed is not None else F.lit(False), "W_GLOBAL_RANK_WITHHELD_MIXED_ROUTES"),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes])), ";")


def rank_desc(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Smallest rank, descending, within keys, taken in cells of the range, so that one route is many tasks. df is read more than once: give a written or checkpointed table."""
    minus = df.withColumns({"__minus": -F.col(value), "__all": F.lit(0)})
    placed = _cells(minus, keys or ["__all"], "__minus", F.lit(1), cells_for(minus, keys or ["__all"]))
    inside = Window.partitionBy(*(keys or ["__all"]), "__cell").orderBy("__minus")
    return placed.withColumn(out, (F.col("__start") + F.rank().over(inside)).cast("long")).drop("__minus", "__all", "__cell", "__start")


def ranked(df: DataFrame, score: str = "activity_score", route: str = "model_route", allow_mixed: bool = False) -> DataFrame:
    """rank_within_route, and activity_rank, which is null where routes are mixed unless allowed."""
    df = cut(df)
    routes = df.agg((F.min(route) != F.max(route)).alias("mixed"))
    out = rank_desc(stored(rank_desc(df, [route], score, "rank_within_route")), [], score, "__rank").crossJoin(F.broadcast(routes))
    held = F.col("mixed") & F.lit(not allow_mixed)
    return out.withColumns({"rank_withheld": held, "activity_rank": F.when(~held, F.col("__rank"))}).drop("__rank", "mixed")


def top_k(df: DataFrame, k: int, score: str = "activity_score") -> DataFrame:
    return df.orderBy(F.desc(score), "record_id").limit(k)


def unmapped_ids(df: DataFrame, most: int = 10) -> list[str]:
    """The first ids that policy `error` names."""
    return [r[0] for r in df.where("mapping_hit_count = 0").select("record_id").orderBy("record_id").limit(most).collect()]


def require_mapped(df: DataFrame) -> DataFrame:
    if ids := unmapped_ids(df):
        raise ValueError("mapping failed for record_id values: " + ", ".join(ids))
    return df


def mean_over_seeds(members: DataFrame) -> DataFrame:
    return members.groupBy("record_id").agg(F.avg("y_pred").alias("y_pred"), F.count("*").alias("members"))


def score_table(df: DataFrame, inputs: list[str], results: list[str], row: str = "source_row") -> DataFrame:
    """Input columns first, in input order."""
    return df.orderBy(row).select(*inputs, *[c for c in results if c not in inputs])


MODELS = ("D_xgb", "D_lightgbm", "D_mlp", "B", "C", "SEQ_MAPPING_XGB", "HISTORY_PRIOR")


def melt_predictions(wide: DataFrame, keys: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    return wide.unpivot(keys, list(models), "model_id", "y_pred")


def pivot_predictions(long: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("model_id", models).agg(F.first("y_pred"))
