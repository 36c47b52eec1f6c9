"""Tables that Spark (and, for oracles, DuckDB) derives from the driver's tables, whole: one SQL text for both.

Every `part` row is a template; every `events` row is a pair drawn from the first tenth of them. The only difference between the
engines is how hex text becomes a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.checkpoints import spread

SPARK_HEX = lambda s: f"cast(conv({s}, 16, 10) as bigint)"
DUCK_HEX = lambda s: f"cast(('0x' || {s}) as bigint)"


def _nuc(s: str) -> str:
    return f"translate({s}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _bases(key: str) -> str:
    return _nuc("concat(" + ", ".join(f"md5(concat(cast({key} as string), '|{x}'))" for x in "abc") + ")")


TEMPLATES = f"""
select cast(p_partkey as int) template_no, concat('grp_', lpad(cast(cast(floor(p_partkey / 9.0) as int) + 1 as string), 5, '0')) template_group_id,
  case when p_partkey % 5 = 0 and p_partkey > 0 then concat(substr(b1, 1, 48), substr(b0, 49, 48))
       when p_partkey % 7 = 3 then concat(substr(b0, 1, 12), 'R', substr(b0, 14, 49), 'N', substr(b0, 64, 33))
       when p_partkey % 11 = 4 then concat(substr(b0, 1, 48), substr(b0, 1, 25), substr(b0, 74, 23)) else b0 end template_sequence_clean
from (select p_partkey, {_bases('p_partkey')} b0, {_bases('(p_partkey - 1)')} b1 from part)"""


def pairs_sql(hexed) -> str:
    h = lambda s: hexed(s)
    return f"""
with p0 as (select event_id, value, md5(cast(event_id as string)) m from events),
 size as (select greatest(cast(floor(count(*) / 10.0) as bigint), 1) sources from part),
 h as (select event_id, value, m, {h('substr(m, 1, 6)')} h1, {h('substr(m, 7, 6)')} h2, {h('substr(m, 13, 6)')} h3, {h('substr(m, 19, 6)')} h4, sources from p0 cross join size),
 p1 as (select h.*, 1 + 24 * (h2 % 3) off, h3 % 10 kind, template_no, translate(template_sequence_clean, 'RN', 'AC') sc from h join templates on template_no = h1 % sources),
 p2 as (select cast(event_id as string) record_id,
   case when template_no % 2 = 0 then concat(substr(sc, cast(off as int), 9), translate(substr(sc, cast(off as int) + 9, 1), 'ACGT', 'CGTA'), substr(sc, cast(off as int) + 10, 15)) else substr(sc, cast(off as int), 25) end crRNA_sequence,
   case when kind < 6 then substr(sc, cast(off as int), 25) when kind = 6 then concat(substr(sc, cast(off as int), 12), '-', substr(sc, cast(off as int) + 12, 12))
        when kind = 7 then reverse(translate(substr(sc, cast(off as int), 25), 'ACGT', 'TGCA'))
        when kind = 8 then concat(substr(sc, cast(off as int), 20), translate(substr(sc, cast(off as int) + 20, 1), 'ACGT', 'GTAC'), substr(sc, cast(off as int) + 21, 4)) else {_nuc('substr(m, 1, 25)')} end target_aligned_25,
   case when h4 % 10 < 8 then 'baseline_train' else 'baseline_validation' end baseline_split, value, kind from p1)
select record_id, crRNA_sequence, target_aligned_25, baseline_split,
   round(-3.5 + 1.2 * ({h('substr(md5(crRNA_sequence), 1, 6)')} % 1000) / 1000.0 + 0.8 * least(value, 50.0) / 50.0 - case when kind = 8 then 0.25 else 0.0 end, 6) label_normalized
from p2"""


MODELS = {"M_STRONG": (0.75, 0.25, 0.30), "M_MID": (0.55, 0.45, 0.60), "M_WEAK": (0.25, 0.75, 1.00)}


def _noisy(hexed, model: str, w: float, v: float, a: float, key: str = "record_id") -> str:
    number = hexed(f"substr(md5(concat({key}, '|', '{model}')), 1, 6)")
    return f"round({w} * label_normalized + {v} * (-2.7) + {a} * (({number} % 2001) - 1000) / 1000.0, 6)"


def _fold(hexed, suffix: str = "f", k: int = 5) -> str:
    number = hexed(f"substr(md5(concat(crRNA_sequence, '|{suffix}')), 1, 6)")
    return f"cast({number} % {k} as int)"


def predictions_sql(hexed) -> str:
    made = ", ".join(f"{_noisy(hexed, m, *p)} {m}" for m, p in MODELS.items())
    base = f"select record_id, crRNA_sequence group_id, {_fold(hexed)} outer_fold, label_normalized y_true, {made} from pairs where baseline_split = 'baseline_train'"
    value = " ".join(f"when '{m}' then {m}" for m in MODELS)
    names = ", ".join(f"('{m}')" for m in (*MODELS, "M_CONST"))
    return f"select record_id, group_id, outer_fold, model_id, y_true, case model_id {value} else cast(-2.7 as double) end y_pred from ({base}) rows_ cross join (values {names}) models_(model_id)"


COMPONENTS = {"D_xgb": (0.60, 0.40, 0.50), "D_lightgbm": (0.62, 0.38, 0.52), "D_mlp": (0.40, 0.60, 0.80), "B": (0.75, 0.25, 0.40), "C": (0.72, 0.28, 0.42), "SEQ_MAPPING_XGB": (0.70, 0.30, 0.45), "HISTORY_PRIOR": (0.30, 0.70, 0.90)}


def components_sql(hexed) -> str:
    """Training rows with seven components, four inner folds and whether a target counts as mapped."""
    cols = ", ".join(f"{_noisy(hexed, m, *p)} {m}" for m, p in COMPONENTS.items())
    found = hexed("substr(md5(concat(record_id, '|found')), 1, 6)") + " % 10 < 8"
    return f"select record_id, crRNA_sequence group_id, {_fold(hexed, 'i', 4)} inner_fold, {_fold(hexed)} outer_fold, label_normalized y_true, {cols}, {found} mapping_found from pairs where baseline_split = 'baseline_train'"


def damaged_sql(hexed) -> str:
    """Pairs with repeated ids, short targets and letters that aren't bases."""
    return """select cast(record_id as bigint) + 2 source_row,
  case when cast(record_id as bigint) % 97 = 96 then cast(cast(record_id as bigint) - 1 as string) when cast(record_id as bigint) % 89 = 88 then ' ' else record_id end record_id,
  case when cast(record_id as bigint) % 103 = 102 then concat(substr(crRNA_sequence, 1, 7), 'N', substr(crRNA_sequence, 9, 17)) else crRNA_sequence end crRNA_sequence,
  case when cast(record_id as bigint) % 101 = 100 then substr(target_aligned_25, 1, 24) else target_aligned_25 end target_aligned_25, label_normalized from pairs"""


def contexts_sql(hexed) -> str:
    """45-letter contexts of training targets, with some ambiguity codes and statuses."""
    return f"""select record_id, crRNA_sequence guide, label_normalized y_true,
  concat(substr({_nuc("md5(concat(record_id, '|c'))")}, 1, 10), replace(target_aligned_25, '-', 'N'), substr({_nuc("md5(concat(record_id, '|d'))")}, 1, 10)) target_context_45,
  case when cast(record_id as bigint) % 7 = 6 then 'missing_context' else 'ok' end context_status from pairs where baseline_split = 'baseline_train'"""


TEXTS = {"pairs": pairs_sql, "predictions": predictions_sql, "components": components_sql, "damaged": damaged_sql, "contexts": contexts_sql}


def duck_ctes(*names: str) -> str:
    """WITH list of fixtures for an oracle; pairs and templates come first."""
    wanted = [n for n in TEXTS if n in names or n == "pairs"]
    return f"templates as ({TEMPLATES.replace('as string', 'as varchar')}), " + ", ".join(f"{n} as ({TEXTS[n](DUCK_HEX).replace('as string', 'as varchar')})" for n in wanted)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; column pruning and filters reach the scans below."""
    spread(spark.read.parquet(f"{sf_dir}/part.parquet")).createOrReplaceTempView("part")
    spread(spark.read.parquet(f"{sf_dir}/events.parquet")).createOrReplaceTempView("events")
    spark.sql(TEMPLATES).createOrReplaceTempView("templates")
    if name == "templates":
        return spark.table("templates")
    spark.sql(pairs_sql(SPARK_HEX)).createOrReplaceTempView("pairs")
    return spark.table("pairs") if name == "pairs" else spark.sql(TEXTS[name](SPARK_HEX))
