"""SQL for DuckDB that states each registered query's rows on its own, from the driver's tables."""

from __future__ import annotations

from .fixtures import COMPONENTS, DUCK_HEX, duck_ctes
from .queries import DRAWS, SEED, STEP, SWAPS, _NUMERIC

# Fixed values, stated here again so that an error in the operators' own shows.
BASES, CODES, COMPLEMENTS = "ACGT", "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
DINUCLEOTIDES = [a + b for a in BASES for b in BASES]
TRINUCLEOTIDES = ["AAA", "CCC", "GGG", "TTT", "GCG", "CGC", "TAT", "ATA"]
FAMILIES = [("D", 3), ("SEQ_MAPPING_XGB", 1), ("D_B", 8), ("D_B_C", 9)]

ORACLES: dict[str, str] = {}
M5 = ("SCC", "PCC", "RMSE", "MAE", "R2")


def add(name: str, body: str, *fixtures: str, ctes: str = "") -> None:
    ORACLES[name] = f"with recursive {duck_ctes(*fixtures)}{', ' + ctes if ctes else ''} {body}"


def r(e: str, name: str = "") -> str:
    return f"round(round(({e})::double, 11), 6){' ' + name if name else ''}"


def corr(a: str, b: str) -> str:
    return f"case when min({a}) = max({a}) or min({b}) = max({b}) then null else covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) end"


def raw(src: str, keys: str, y: str = "y_true", p: str = "y_pred", more: str = "") -> str:
    rank = lambda v: f"rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1) / 2.0"
    e = f"({p} - {y})"
    return f"""(select {keys}, count(*) n{more}, {corr('ry_', 'rp_')} SCC, {corr(y, p)} PCC, sqrt(avg({e} * {e})) RMSE, avg(abs({e})) MAE, case when min({y}) <> max({y}) then 1 - avg({e} * {e}) / var_pop({y}) end R2
      from (select *, {rank(y)} ry_, {rank(p)} rp_ from {src}) group by {keys})"""


def five(src: str, keys: str, cols: tuple[str, ...] = ("n", *M5), **kw) -> str:
    return f"select {keys}, " + ", ".join(r(c, c) if c in M5 else c for c in cols) + f" from {raw(src, keys, **kw)}"


LEVELS = "(select *, unnest(['pooled', 'fold_' || outer_fold]) level from predictions)"
P = ("predictions",)
add("metrics_by_fold", five(LEVELS, "model_id, level", ("n", "n_groups", *M5), more=", count(distinct group_id) n_groups"), *P)
add("metric_delta", f"select level, {', '.join(r(f'a.{m} - b.{m}', f'delta_{m}') for m in M5)} from m a join m b using (level) where a.model_id = 'M_STRONG' and b.model_id = 'M_WEAK'", *P, ctes=f"m as {raw(LEVELS, 'model_id, level')}")
add("constant_folds", f"select model_id, {r('avg(c)', 'constant_fraction')} from (select model_id, case when max(y_pred) = min(y_pred) then 1.0 else 0.0 end c from predictions group by model_id, outer_fold) group by model_id", *P)
add("tail_bias", f"""select model_id, {r('avg(case when y_true <= a then y_pred - y_true end)', 'bottom_bias')}, {r('avg(case when y_true >= b then y_pred - y_true end)', 'top_bias')}, {r('max(y_pred) - min(y_pred)', 'prediction_range')}
  from predictions join (select model_id, quantile_cont(y_true, 0.1) a, quantile_cont(y_true, 0.9) b from predictions group by model_id) using (model_id) group by model_id""", *P)
_pairs = [("D_xgb", "B"), ("D_xgb", "C"), ("B", "C")]
_cc = " union all ".join(f"select outer_fold, '{a}|{b}' pair, '{k}' kind, round({a} - {s}, 6) a, round({b} - {s}, 6) b from components" for a, b in _pairs for k, s in (("prediction", "0"), ("residual", "y_true")))
add("component_correlation", five(f"(select *, unnest(['pooled', 'fold_' || outer_fold]) level from ({_cc}))", "pair, kind, level", ("n", "SCC", "PCC"), y="a", p="b"), "components")
add("within_group_rank", f"""select model_id, count(*) groups, count(*) filter (where SCC is null) undefined, {r('quantile_cont(SCC, 0.25)', 'q1')}, {r('quantile_cont(SCC, 0.5)', 'median')}, {r('quantile_cont(SCC, 0.75)', 'q3')}
  from {raw('(select * from predictions qualify count(*) over (partition by model_id, group_id) >= 5)', 'model_id, group_id')} group by model_id""", *P)


def bins(src: str, by: str) -> str:
    e = "(y_pred - y_true)"
    return f"select model_id, bin::bigint bin, count(*) n, {r(f'min({by})', 'lo')}, {r(f'max({by})', 'hi')}, {r('avg(y_true)', 'mean_true')}, {r('avg(y_pred)', 'mean_pred')}, {r(f'avg({e})', 'signed_error')}, {r(f'sqrt(avg({e} * {e}))', 'RMSE')}, {r(f'avg(abs({e}))', 'MAE')} from {src} group by model_id, bin"


add("calibration", bins("(select *, ntile(10) over (partition by model_id order by y_pred, record_id) bin from predictions)", "y_pred"), *P)
add("observed_bins", bins("predictions join (select record_id, ntile(10) over (order by y, record_id) bin from (select record_id, min(y_true) y from predictions group by record_id)) using (record_id)", "y_true"), *P)
add("quantile_bins", bins("(select p.*, 1 + (y_pred > e1)::int + (y_pred > e2)::int + (y_pred > e3)::int + (y_pred > e4)::int bin from predictions p join (select model_id, " + ", ".join(f"quantile_cont(y_pred, 0.{2 * i}) e{i}" for i in range(1, 5)) + " from predictions group by model_id) using (model_id))", "y_pred"), *P)
_ROUTED = "(select *, case when outer_fold < 2 then 'fallback' else 'fusion' end prediction_route from predictions)"
add("route_counts", f"select model_id, prediction_route, n, {r('n / sum(n) over (partition by model_id)', 'share')} from (select model_id, prediction_route, count(*) n from {_ROUTED} group by all)", *P)
add("win_rate", f"select {r('avg(case when abs(B - y_true) < abs(D_xgb - y_true) then 1.0 else 0.0 end)', 'win_rate')} from components", "components")
add("metric_rank_profile", "select model_id, metric, rank() over (partition by metric order by v desc nulls last) rank from (" + " union all ".join(f"select model_id, '{m}' metric, {'-' if m in ('RMSE', 'MAE') else ''}{m} v from m" for m in M5) + ")", *P, ctes=f"m as {raw('predictions', 'model_id')}")
add("density_2d", "select model_id, floor(y_true / 0.25)::bigint bx, floor(y_pred / 0.25)::bigint \"by\", count(*) n from predictions group by all", *P)
add("metric_regression", "select c \"column\", count(*) filter (where (a is null) <> (b is null)) unmatched, " + r("max(abs(a - b))", "max_abs_diff") + ", count(*) filter (where (a is null) <> (b is null)) = 0 and coalesce(max(abs(a - b)), 0) <= 0.05 \"within\" from (" + " union all ".join(f"select '{m}' c, m.{m} a, k.{m} b from m join k using (model_id)" for m in M5) + ") group by c", *P, ctes=f"m as {raw('predictions', 'model_id, outer_fold')}, k as (select model_id, {', '.join(f'avg({m}) {m}' for m in M5)} from m group by model_id)")

# --- quality
_bad = lambda s, ok: f"array_to_string(list_sort(list_distinct(list_filter(string_split({s}, ''), lambda x: not contains('{ok}', x)))), ',')"
_ERR = f"""err as (
  with n as (select source_row, trim(coalesce(record_id, '')) id, translate(upper(trim(crRNA_sequence)), 'U', 'T') g, translate(upper(trim(target_aligned_25)), 'U', 'T') t from damaged),
  s as (select *, case when {_bad('g', 'ACGT')} <> '' then 'Invalid characters in crRNA_sequence: ' || {_bad('g', 'ACGT')} when length(g) <> 25 then 'crRNA_sequence must contain exactly 25 aligned positions; got ' || length(g) end ge,
    case when {_bad('t', 'ACGT-')} <> '' then 'Invalid characters in target_aligned_25: ' || {_bad('t', 'ACGT-')} when length(t) <> 25 then 'target_aligned_25 must contain exactly 25 aligned positions; got ' || length(t) when replace(t, '-', '') = '' then 'target_aligned_25 cannot contain gaps only' end te from n)
  select id record_id, source_row, 'record_id' field, 'record_id must be nonempty' error from s where id = ''
  union all select id, source_row, 'record_id', 'record_id must be unique' from s where id in (select id from s group by id having count(*) > 1)
  union all select id, source_row, 'crRNA_sequence', ge from s where ge is not null
  union all select id, source_row, 'target_aligned_25', te from s where ge is null and te is not null)"""
add("validation_errors", "select * from err", "damaged", ctes=_ERR)
add("kept_invalid", f"select source_row, record_id, {r('case when e is null then label_normalized end', 'label_normalized')}, case when e is null then 'valid' else 'invalid_input' end status, coalesce(e, '') input_errors from damaged left join (select source_row, string_agg(error, ' | ' order by error) e from err group by source_row) using (source_row)", "damaged", ctes=_ERR)
add("key_violations", "select sum(n)::bigint rows, coalesce(sum(n) filter (where record_id is null), 0)::bigint null_keys, coalesce(sum(n) filter (where record_id = ''), 0)::bigint empty_keys, count(*) filter (where n > 1 and record_id is not null) repeated_keys from (select record_id, count(*) n from damaged group by record_id)", "damaged")
add("lost_keys", "select record_id, 'left' side from pairs where record_id not in (select record_id from contexts) union all select record_id, 'right' from contexts where record_id not in (select record_id from pairs)", "contexts")
add("coverage_audit", """select model_id, count(h) rows, count(*) filter (where h is null) missing_ids, count(*) filter (where w is null) extra_ids, count(*) filter (where h and w and y_true is distinct from wy) label_mismatch, count(*) filter (where h and w and group_id is distinct from wg) group_mismatch,
  count(*) filter (where h and w and outer_fold is distinct from wf) fold_mismatch, count(*) filter (where h and not coalesce(outer_fold between 0 and 4, false)) bad_fold from b full join e using (model_id, record_id) group by model_id""", *P, ctes="""
b as (select model_id, record_id, group_id, outer_fold, case when model_id = 'M_CONST' and outer_fold = 1 then y_true + 1 else y_true end y_true, true h from predictions where not (model_id = 'M_WEAK' and outer_fold = 3)),
e as (select m.model_id, record_id, group_id wg, outer_fold wf, y_true wy, true w from predictions p, (select distinct model_id from b) m where p.model_id = 'M_MID')""")
add("method_consistency", "select record_id, count(distinct y) y_true, count(distinct group_id) group_id, count(distinct outer_fold) outer_fold from (select *, case when model_id = 'M_WEAK' and outer_fold = 2 then round(y_true + 0.5, 6) else y_true end y from predictions) group by record_id having count(distinct y) > 1 or count(distinct group_id) > 1 or count(distinct outer_fold) > 1", *P)
_SA = "(select record_id, group_id, case when model_id = 'M_WEAK' and outer_fold = 2 then 4 else outer_fold end f from predictions)"
add("single_assignment", f"select * from (select 'record' what, record_id id, count(distinct f) folds, count(distinct group_id) groups from {_SA} group by record_id union all select 'group', group_id, count(distinct f), 1 from {_SA} group by group_id) where folds > 1 or groups > 1", *P)
add("allowed_routes", f"select model_id, prediction_route, count(*) n from {_ROUTED} where (model_id, prediction_route) not in (values ('M_STRONG', 'fusion'), ('M_STRONG', 'fallback'), ('M_MID', 'fusion'), ('M_CONST', 'fallback')) group by all", *P)
add("numeric_contract", "select c \"column\", count(*) filter (where v is null or not isfinite(v)) not_finite, count(*) filter (where isfinite(v) and floor(v) <> v) not_whole, count(*) filter (where isfinite(v) and v < 0) negative from (select 'inner_fold' c, inner_fold::double v from components union all select 'y_true', y_true::double from components union all select 'B', case when outer_fold > 0 then B end::double from components) group by c", "components")
add("identity_agreement", "select c \"column\", count(*) n, count(*) filter (where not same) differing from (select unnest([{'c': 'group_id', 'same': p.group_id is not distinct from case when c.outer_fold = 1 then lower(c.group_id) else c.group_id end}, {'c': 'outer_fold', 'same': p.outer_fold = c.outer_fold}, {'c': 'y_true', 'same': p.y_true is not distinct from c.y_true}], recursive := true) from predictions p join components c using (record_id) where model_id = 'M_MID') group by c", "predictions", "components")
add("id_set_hash", "select model_id, outer_fold::bigint outer_fold, count(*) n, sha256(string_agg(record_id, chr(10) order by record_id)) ids_sha256 from predictions group by all", *P)
add("normalized_keys", "select record_id, crRNA_sequence guide, replace(target_aligned_25, '-', '') target, case when record_id[1] = '7' then 'missing' else record_id[1] end \"key\", 2::bigint atoms from pairs")
add("pivoted_predictions", "select record_id, y_true, " + ", ".join(f"max(case when model_id = '{m}' then y_pred end) {m}" for m in ("M_STRONG", "M_MID", "M_WEAK")) + " from predictions group by record_id, y_true", *P)
add("melted_predictions", " union all ".join(f"select record_id, inner_fold::bigint inner_fold, '{m}' model_id, {m} y_pred from components" for m in COMPONENTS), "components")
add("pairs_round_trip", "select record_id, crRNA_sequence, target_aligned_25 from pairs", "pairs")
add("scored_table", f"select source_row, record_id, {r('label_normalized', 'activity_score')} from damaged", "damaged")
add("first_unmapped", "select record_id from pairs where baseline_split <> 'baseline_train' order by record_id limit 10", "pairs")
add("runs_from_folder", "select model_id, outer_fold::bigint outer_fold, record_id, y_true, y_pred from predictions where not (model_id = 'M_MID' and outer_fold >= 3)", *P)
add("feature_scan", "select event_id, value::double \"value\" from events")
add("split_rows", "select record_id, crRNA_sequence from pairs where baseline_split = 'baseline_validation'", "pairs")
add("label_free", "select record_id, crRNA_sequence, target_aligned_25, baseline_split from pairs", "pairs")
add("completed_runs", "select model_id, outer_fold::bigint outer_fold, record_id, y_true, y_pred from predictions where not (model_id = 'M_MID' and outer_fold >= 3)", *P)
add("clean_templates", f"select (template_no + 1)::bigint template_no, 'grp_' || printf('%03d', (template_no // 9 + 1)::int) template_group_id, regexp_replace(upper(lower(template_sequence_clean) || ' x-5'), '[^{CODES}]', '', 'g') template_sequence_clean, length(template_sequence_clean)::bigint template_length from templates")

# --- features
_EV = "array_to_string(list_transform(range(1, 26), lambda i: case when g[i] = '-' and t[i] <> '-' then 'G' when t[i] = '-' and g[i] <> '-' then 'T' when g[i] = t[i] then 'M' else 'S' end), '')"
_F = f"f as (select *, {_EV} ev, replace(t, '-', '') u, substr(g, 5) gs, replace(substr(t, 5), '-', '') ts from (select *, translate(upper(trim(crRNA_sequence)), 'U', 'T') g, translate(upper(trim(target_aligned_25)), 'U', 'T') t from pairs))"
_cnt = lambda s, letters: f"(length({s}) - length(translate({s}, '{letters}', '')))"
_longest = lambda s, pat: f"coalesce(list_max(list_transform(regexp_extract_all({s}, '{pat}'), lambda x: length(x))), 0)"
_flags = {f"{n}_pos_{i:02d}": f"(ev[{i}] {t})::int" for n, t in (("difference", "<> 'M'"), ("substitution", "= 'S'"), ("target_gap", "= 'T'")) for i in range(1, 26)}
_subs = {f"sub_{a}_to_{b}_count": f"len(list_filter(range(1, 26), lambda i: g[i] = '{a}' and t[i] = '{b}'))" for a in BASES for b in BASES if a != b}
_pos = "list_filter(range(1, 26), lambda i: ev[i] <> 'M')"
_summary = {
    "aligned_difference_count": _cnt("ev", "STG"), "substitution_count": _cnt("ev", "S"), "gap_count_target": _cnt("ev", "T"), "gap_count_guide": _cnt("ev", "G"), "pam_difference_count": f"len(list_filter(range(1, 5), lambda i: ev[i] <> 'M'))", "spacer_difference_count": "len(list_filter(range(5, 26), lambda i: ev[i] <> 'M'))",
    "first_difference_position_1based": f"list_min({_pos})", "last_difference_position_1based": f"list_max({_pos})", "longest_match_run": _longest("ev", "M+"), "longest_substitution_run": _longest("ev", "S+"), "longest_target_gap_run": _longest("ev", "T+"),
}


def _composition(p: str, s: str) -> dict[str, str]:
    n = f"nullif({_cnt(s, BASES)}, 0)::double"
    h = " + ".join(f"case when {_cnt(s, b)} > 0 then -({_cnt(s, b)} / {n}) * log2({_cnt(s, b)} / {n}) else 0 end" for b in BASES)
    out = {f"{p}_length_acgt": _cnt(s, BASES), f"{p}_gc_content": r(f"{_cnt(s, 'GC')} / {n}"), f"{p}_shannon_entropy": r(f"case when {n} is not null then {h} end"), f"{p}_longest_homopolymer": _longest(s, "A+|C+|G+|T+")}
    return out | {f"{p}_{b.lower()}_fraction": r(f"{_cnt(s, b)} / {n}") for b in BASES}


def _context(p: str, s: str) -> dict[str, str]:
    half = f"greatest(1, length({s}) // 2)"
    gc = lambda x: r(f"{_cnt(x, 'GC')} / nullif(length({x}), 0)::double")
    out = {f"{p}_context_unique_base_count": f"len(list_distinct(string_split({s}, '')))", f"{p}_context_gc_first_half": gc(f"substr({s}, 1, {half})"), f"{p}_context_gc_second_half": gc(f"substr({s}, {half} + 1)"), f"{p}_context_gc_first_5nt": gc(f"substr({s}, 1, 5)"), f"{p}_context_gc_last_5nt": gc(f"right({s}, 5)")}
    for name, kmers in (("dinuc", DINUCLEOTIDES), ("trinuc", TRINUCLEOTIDES)):
        for k in kmers:
            n = f"(length({s}) - {len(k)} + 1)"
            out[f"{p}_context_{name}_{k}_frequency"] = r(f"case when {n} > 0 then len(list_filter(range(1, {n} + 1), lambda i: substr({s}, i, {len(k)}) = '{k}')) / {n}::double else 0 end")
    return out


FEATURES = _flags | _subs | _summary | _composition("guide", "g") | _composition("target_ungapped", "u") | _composition("guide_spacer", "gs") | _composition("target_spacer_ungapped", "ts") | _context("guide", "g") | _context("target", "u")


def _features(names) -> str:
    cast = lambda e: e if e.startswith("round(") else f"({e})::bigint"
    return "select record_id, " + ", ".join(f"{cast(FEATURES[n])} {n}" for n in names) + " from f"


for _name, _names in (("pair_features", FEATURES), ("alignment_summary", _summary), ("position_flags", _flags), ("substitutions", _subs)):
    add(_name, _features(_names), ctes=_F)
_ALL = BASES + "-N"
add("pair_identity_long", f"select record_id, i::bigint \"position\", a || b pair, ((i - 1) * 36 + (instr('{_ALL}', a) - 1) * 6 + instr('{_ALL}', b) - 1)::bigint vector_index from (select record_id, i, regexp_replace(rpad(g, 25, 'N')[i], '[^ACGTN-]', 'N') a, regexp_replace(rpad(t, 25, 'N')[i], '[^ACGTN-]', 'N') b from (select *, unnest(range(1, 26)) i from f))", ctes=_F)
_IU = "iu as (select * from (values " + ", ".join(f"('{c}', {'ACGT-'.index(b)}, {1 / len(bs)!r}::double)" for c, bs in {**IUPAC, "-": "-"}.items() for b in bs) + ") v(letter, ch, w))"
add("iupac_tensor", f"select record_id, (i - 1)::bigint \"position\", ch::bigint channel, {r('w', 'value')} from (select record_id, target_context_45 s, unnest(range(1, length(s) + 1)) i from contexts) join iu on iu.letter = s[i] union all select record_id, (i + 9)::bigint, (ch + 5)::bigint, {r('w')} from (select record_id, guide s, unnest(range(1, length(s) + 1)) i from contexts) join iu on iu.letter = s[i]", "contexts", ctes=_IU)
add("context_profile", "select i::bigint \"position\", s[i] symbol, count(*) n from (select target_context_45 s, unnest(range(1, length(s) + 1)) i from contexts) group by all", "contexts")
add("alignment_events", "select record_id, i::bigint \"position\", ev[i] event from (select record_id, ev, unnest(range(1, 26)) i from f)", ctes=_F)

# --- mapping: windows with codes are spelt out, R and N being the only ones here
_MAP = f"""tg as (select distinct replace(translate(upper(trim(target_aligned_25)), 'U', 'T'), '-', '') target from pairs),
win as (select template_no, template_group_id, s start_0based, substr(template_sequence_clean, s + 1, k) win from (select *, unnest(range(0, length(template_sequence_clean) - k + 1)) s from templates, (select distinct length(target) k from tg))),
qry as (select target, 'forward' orientation, target q from tg union all select target, 'reverse_complement', reverse(translate(target, '{CODES}', '{COMPLEMENTS}')) from tg),
ex as (select target, template_no, template_group_id, start_0based, orientation, 'exact_acgt' match_mode from qry join win on q = win where regexp_full_match(win, '[ACGT]+')),
amb as (select distinct template_no, template_group_id, start_0based, replace(replace(win, 'R', a), 'N', b) win from win, (values ('A'), ('G')) x(a), (values ('A'), ('C'), ('G'), ('T')) y(b) where not regexp_full_match(win, '[ACGT]+')),
hits as (select * from ex union all select target, template_no, template_group_id, start_0based, orientation, 'iupac_compatible' from qry join amb on q = win where target not in (select target from ex)),
roll as (select *, case when mapping_match_modes = 'exact_acgt' and pos = 1 then 'unique_exact_window' when mapping_match_modes = 'exact_acgt' and mapping_template_count = 1 then 'ambiguous_position_same_template' when mapping_match_modes = 'exact_acgt' and mapping_group_count = 1 then 'ambiguous_template_single_group'
    when mapping_match_modes = 'iupac_compatible' and mapping_group_count = 1 then 'iupac_compatible_single_group' when mapping_group_count > 1 then 'ambiguous_multiple_groups' else 'ambiguous_source_mapping' end mapping_status
  from (select target, count(*) mapping_hit_count, count(distinct template_no) mapping_template_count, count(distinct template_group_id) mapping_group_count, count(distinct orientation) mapping_orientation_count, count(distinct (template_no, start_0based, orientation)) pos,
    array_to_string(list_sort(list(distinct template_no)), ';') mapping_candidate_template_nos, array_to_string(list_sort(list(distinct template_group_id)), ';') mapping_candidate_group_ids, array_to_string(list_sort(list(distinct orientation)), ';') mapping_candidate_orientations, array_to_string(list_sort(list(distinct match_mode)), ';') mapping_match_modes from hits group by target)),
rolled as (select * exclude (pos), case when mapping_status = 'unique_exact_window' then 'high' when mapping_status in ('ambiguous_position_same_template', 'ambiguous_template_single_group') then 'medium' else 'review' end mapping_confidence from roll)"""
_FIELDS = ["mapping_status", "mapping_confidence", "mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_orientation_count", "mapping_candidate_template_nos", "mapping_candidate_group_ids", "mapping_candidate_orientations", "mapping_match_modes"]
_default = lambda c: f"coalesce({c}, 0)" if c.endswith("_count") else f"coalesce({c}, '{ {'mapping_status': 'unmapped_exact_or_iupac', 'mapping_confidence': 'review'}.get(c, '') }')"
_MAPPED = _MAP + f", mp as (select p.*, {', '.join(f'{_default(c)} {c}' for c in _FIELDS)} from pairs p left join rolled on target = replace(translate(upper(trim(target_aligned_25)), 'U', 'T'), '-', ''))"
add("template_windows", "select template_no::bigint template_no, length(win) k, count(*) windows, count(*) filter (where regexp_full_match(win, '[ACGT]+')) plain_windows from win group by all", ctes=_MAP)
for _n, _m in (("exact_hits", "exact_acgt"), ("iupac_hits", "iupac_compatible")):
    add(_n, f"select target, template_no::bigint template_no, template_group_id, start_0based::bigint start_0based, orientation, match_mode from hits where match_mode = '{_m}'", ctes=_MAP)
add("mapping_rollup", "select * from rolled", ctes=_MAP)
add("map_pairs", f"select record_id, {', '.join(_FIELDS)} from mp", ctes=_MAPPED)
add("supplied_mapping", f"select record_id, {', '.join(_FIELDS)} from mp", ctes=_MAPPED)
add("mapping_parity", "select c \"column\", (select count(*) from mp) n, case when c = 'mapping_status' then (select count(*) from mp where mapping_hit_count > 1) else 0 end differing from (values " + ", ".join(f"('{c}')" for c in _FIELDS) + ") v(c)", ctes=_MAPPED)

# --- history
_CLS = f"case when d = 0 then 'exact' else 'nonexact' end exactness, case when d = 0 then 'exact' when d = 1 then 'one' else 'two_plus' end diffcat, case when gaps > 0 then 'gap' else 'no_gap' end gapcat, cast({DUCK_HEX('substr(md5(concat(crRNA_sequence, $$|f$$)), 1, 6)')} % 5 as int) fold"
_rows = lambda src, ev=_EV: f"rw as (select *, g guide, replace(t, '-', '') target, label_normalized \"label\", {_CLS} from (select *, {_cnt('ev', 'STG')} d, {_cnt('ev', 'TG')} gaps from (select *, {ev} ev from (select *, translate(upper(trim(crRNA_sequence)), 'U', 'T') g, translate(upper(trim(target_aligned_25)), 'U', 'T') t from {src})))), tr as materialized (select * from rw where baseline_split = 'baseline_train'), qu as materialized (select * from rw where baseline_split <> 'baseline_train')"
_ROWS, _MROWS = _rows("pairs"), _MAPPED + ", " + _rows("mp")
_GH = "gh as materialized (select 'all' reference_type, guide, '' category, sum(\"label\") s, count(*) c from tr group by guide union all select exactness, guide, '', sum(\"label\"), count(*) from tr group by guide, exactness union all select 'diffcat', guide, diffcat, sum(\"label\"), count(*) from tr group by guide, diffcat union all select 'gapcat', guide, gapcat, sum(\"label\"), count(*) from tr group by guide, gapcat)"
add("guide_history", f"select reference_type, guide, category, {r('s', 'sum')}, c \"count\" from gh", ctes=f"{_ROWS}, {_GH}")
_HF = ["mapping_status", "mapping_confidence", "mapping_candidate_template_nos", "mapping_candidate_group_ids", "mapping_match_modes", "mapping_candidate_orientations"]
_key = lambda c: f"coalesce(nullif({c}::varchar, ''), 'missing')"
_MH = "mh as (" + " union all ".join(f"select '{f}' field, {_key(f)} k, sum(\"label\") s, count(*) c from tr group by all" for f in _HF) + ")"
add("mapping_history", f"select field, k \"key\", {r('s', 'sum')}, c \"count\" from mh", ctes=f"{_MROWS}, {_MH}")
_sums = lambda n, c: f'coalesce(sum("label") filter ({c}), 0) s_{n}, count(*) filter ({c}) n_{n}'
_GW = "gw as materialized (select guide, " + ", ".join(_sums(n, c) for n, c in [("all", "true"), *((v, f"exactness = '{v}'") for v in ("exact", "nonexact")), *((f"d_{v}", f"diffcat = '{v}'") for v in ("exact", "one", "two_plus")), *((f"p_{v}", f"gapcat = '{v}'") for v in ("gap", "no_gap"))]) + " from tr group by guide)"
_of = lambda c, p, t, vs: f"coalesce(case q.{t} " + " ".join(f"when '{v}' then {c}_{p}_{v}" for v in vs) + " end, 0)"
_D3, _P2 = ("exact", "one", "two_plus"), ("gap", "no_gap")
_TEQ = f"""{_GW}, te as (select q.*, (coalesce(s_all, 0) + 0.5 * m) / (coalesce(n_all, 0) + 0.5) ga, coalesce(n_all, 0) an, coalesce(s_exact, 0) es, coalesce(n_exact, 0) en, coalesce(s_nonexact, 0) ns, coalesce(n_nonexact, 0) nn,
  {_of('s', 'd', 'diffcat', _D3)} ds, {_of('n', 'd', 'diffcat', _D3)} dn, {_of('s', 'p', 'gapcat', _P2)} ps, {_of('n', 'p', 'gapcat', _P2)} pn
  from qu q cross join (select avg("label") m from tr) left join gw on gw.guide = q.guide)"""
_te = lambda: ", ".join([r("ga", "te_guide_all"), r("ln(1 + an)", "te_guide_all_log_count"), r("(an > 0)::int", "te_guide_seen")] + [x for t, s, n, suffix in (("exact", "es", "en", "_ref"), ("nonexact", "ns", "nn", "_ref"), ("diffcat", "ds", "dn", ""), ("gapcat", "ps", "pn", "")) for x in (r(f"({s} + 0.5 * ga) / ({n} + 0.5)", f"te_guide_{t}{suffix}"), r(f"ln(1 + {n})", f"te_guide_{t}_log_count"))])
add("guide_encoding_query", f"select record_id, {_te()} from te", ctes=f"{_ROWS}, {_TEQ}")
_LOO = """te as (select *, (gs_ - y + 0.5 * (ts_ - y) / (tn_ - 1) ) / (an + 0.5) ga from (select record_id, "label" y, sum("label") over () ts_, count(*) over () tn_, sum("label") over (partition by guide) gs_, count(*) over (partition by guide) - 1 an,
  coalesce(sum("label") filter (where exactness = 'exact') over (partition by guide), 0) - case when exactness = 'exact' then "label" else 0 end es, count(*) filter (where exactness = 'exact') over (partition by guide) - (exactness = 'exact')::int en,
  coalesce(sum("label") filter (where exactness = 'nonexact') over (partition by guide), 0) - case when exactness = 'nonexact' then "label" else 0 end ns, count(*) filter (where exactness = 'nonexact') over (partition by guide) - (exactness = 'nonexact')::int nn,
  sum("label") over (partition by guide, diffcat) - "label" ds, count(*) over (partition by guide, diffcat) - 1 dn, sum("label") over (partition by guide, gapcat) - "label" ps, count(*) over (partition by guide, gapcat) - 1 pn from tr))"""
add("guide_encoding_loo", f"select record_id, {_te()} from te", ctes=f"{_ROWS}, {_LOO}")
_cross = lambda k: f"select t.record_id{', t.k as \"key\"' if k != _key('mapping_candidate_group_ids') else ''}, {r('(coalesce(sum(o.\"label\"), 0) + 20 * any_value(p.m)) / (count(o.\"label\") + 20)', 'key_te')}, {r('ln(1 + count(o.\"label\"))', 'key_log_count')} from (select *, {k} k from tr) t join (select f.fold, avg(\"label\") m from tr, (select distinct fold from tr) f where tr.fold <> f.fold group by f.fold) p on p.fold = t.fold left join (select *, {k} k from tr) o on o.k = t.k and o.fold <> t.fold group by t.record_id, t.k"
add("mapping_encoding_crossfit", _cross(_key("mapping_candidate_group_ids")), ctes=_MROWS)
add("interaction_encoding", _cross(_key("mapping_candidate_group_ids") + " || '||' || diffcat"), ctes=_MROWS)
_T = "mapping_candidate_template_nos"
add("smoothed_lookup", f"select record_id, {_key(_T)} \"key\", {r('(coalesce(s, 0) + 20 * -2.7) / (coalesce(c, 0) + 20)', 'te')}, {r('ln(1 + coalesce(c, 0))', 'te_log_count')}, coalesce(c, 0) > 0 te_seen from qu left join mh on field = '{_T}' and k = {_key(_T)}", ctes=f"{_MROWS}, {_MH}")
add("onehot", " union all ".join(f"select record_id, '{f}' field, {_key(f)} \"key\" from qu where {_key(f)} in (select {_key(f)} from tr)" for f in ("mapping_status", "mapping_confidence", "mapping_match_modes")), ctes=_MROWS)
_num = "nm as (select record_id, baseline_split, " + ", ".join(f"({FEATURES[c]})::double {c}" for c in _NUMERIC) + " from f)"
add("median_impute", "select record_id, " + ", ".join(r(f"coalesce({c}, (select quantile_cont({c}, 0.5) from nm where baseline_split = 'baseline_train'), 0)", c) for c in _NUMERIC) + " from nm where baseline_split <> 'baseline_train'", ctes=f"{_F}, {_num}")
add("active_columns", " union all ".join(f"select '{c}' \"column\", min(v) <> max(v) active from (select coalesce({c}, (select quantile_cont({c}, 0.5) from nm), 0) v from nm)" for c in _NUMERIC), ctes=f"{_F}, {_num}")
_SUP = f"(select record_id, baseline_split, (select count(*) from tr where tr.guide = q.guide) guide_support_n, case when mapping_hit_count > 0 and {_key(_T)} <> 'missing' then (select count(*) from tr where tr.mapping_hit_count > 0 and tr.{_T} = q.{_T}) else 0 end template_support_n from rw q)"
add("support_counts", f"select record_id, guide_support_n, template_support_n from {_SUP} where baseline_split <> 'baseline_train'", ctes=_MROWS)
add("support_summary", f"select baseline_split, count(*) n, count(*) filter (where guide_support_n = 0) zero, {r('avg((guide_support_n = 0)::int)', 'zero_fraction')}, {r('quantile_cont(guide_support_n, 0.25)', 'q25')}, {r('quantile_cont(guide_support_n, 0.5)', 'median')}, {r('quantile_cont(guide_support_n, 0.75)', 'q75')}, max(guide_support_n) max from {_SUP} group by baseline_split", ctes=_MROWS)
_DIAG = f"dg as (select te.*, an > 0 guide_seen, coalesce(mh.c, 0) tc, coalesce(mh.c, 0) > 0 template_key_seen, (coalesce(mh.s, 0) + 20 * -2.7) / (coalesce(mh.c, 0) + 20) tt from te left join mh on field = '{_T}' and k = {_key(_T)})"
_SCORE = f"{_MROWS}, {_GH}, {_MH}, {_TEQ}, {_DIAG}"
add("applied_state", f"""select record_id, {_te()}, {r('(coalesce(mh.s, 0) + 20 * (select avg("label") from tr)) / (coalesce(mh.c, 0) + 20)', 'template_te')} from te left join mh on field = '{_T}' and k = {_key(_T)}""", ctes=f"{_MROWS}, {_MH}, {_TEQ}")
add("reference_diagnostics", "select record_id, guide_seen, an guide_reference_count, template_key_seen, tc template_reference_count from dg", ctes=_SCORE)

_SD = f"(select q.guide group_id, \"label\" y_true, round((-2.5 - 0.1 * d)::double, 6) y_pred, mapping_hit_count > 0 mapped, (select count(*) from tr where tr.guide = q.guide) guide_support_n from qu q)"
add("support_distribution", five(_SD, "guide_support_n, mapped", ("n", "n_groups", *M5), more=", count(distinct group_id) n_groups"), ctes=_MROWS)
add("mean_baselines", f"select record_id, {r('(select avg(\"label\") from tr)', 'global_mean')}, {r('ga', 'guide_anchor')}, {r('round(tt, 11)', 'template_anchor')}, {r('round(0.5 * ga + 0.5 * tt, 11)', 'mixed_anchor')} from dg", ctes=_SCORE)
add("numeric_mapping", f"select record_id, {', '.join(f'{c}::double {c}' for c in ('mapping_hit_count', 'mapping_template_count', 'mapping_group_count', 'mapping_orientation_count'))} from mp", ctes=_MAPPED)
_changed = {"substitution_count": "(select count(*) filter (where gap_count_target > 0) from ft)", "first_difference_position_1based": "(select count(*) filter (where first_difference_position_1based = 10) from ft)"}
add("feature_parity", "select c \"column\", case when c = 'first_difference_position_1based' then (select count(*) from ft where first_difference_position_1based = 10) else 0 end unmatched, case when c = 'substitution_count' and (select count(*) from ft where gap_count_target > 0) > 0 then 1.0 else m end::double max_abs_diff, case when c = 'first_difference_position_1based' then (select count(*) from ft where first_difference_position_1based = 10) = 0 when c = 'substitution_count' then (select count(*) from ft where gap_count_target > 0) = 0 else true end \"within\" from (values " + ", ".join(f"('{c}', (select case when count({c}) > 0 then 0.0 end from ft))" for c in FEATURES) + ") v(c, m)", ctes=f"{_F}, ft as materialized (select " + ", ".join(f"{e} {n}" for n, e in FEATURES.items()) + " from f)")
_PN = ", ".join(f"'numeric:{c}', coalesce({c}, (select quantile_cont({c}, 0.5) from nm where baseline_split = 'baseline_train'), 0)" for c in _NUMERIC)


def _matrix(with_history: bool) -> None:
    """Column sums of the ordered design matrix."""
    k = _key("mapping_candidate_group_ids")
    te = ["te_guide_all", "te_guide_all_log_count", "te_guide_seen"] + [x for t, suffix in (("exact", "_ref"), ("nonexact", "_ref"), ("diffcat", ""), ("gapcat", "")) for x in (f"te_guide_{t}{suffix}", f"te_guide_{t}_log_count")]
    loo, query = _LOO.replace("te as (", "te_loo as (", 1), _TEQ.replace("te as (", "te_q as (", 1)
    # encodings unrounded: as _te, without its rounding
    cols = ["ga", "ln(1 + an)", "(an > 0)::int"] + [x for s_, n in (("es", "en"), ("ns", "nn"), ("ds", "dn"), ("ps", "pn")) for x in (f"({s_} + 0.5 * ga) / ({n} + 0.5)", f"ln(1 + {n})")]
    part = []
    part += [f"select record_id, 0 blk, 'numeric:{c}' feature, coalesce({c}, (select quantile_cont({c}, 0.5) from nm where baseline_split = 'baseline_train'), 0)::double v from nm" for c in _NUMERIC]
    block = 1
    if with_history:
        part += [f"select record_id, 1, 'guide:{n}', ({e})::double from {src}" for src in ("te_loo", "te_q") for n, e in zip(te, cols, strict=True)]
        block = 2
    part.append(f"select record_id, {block}, 'pair:' || printf('%02d', i::int) || '_' || regexp_replace(rpad(g, 25, 'N')[i], '[^ACGTN-]', 'N') || regexp_replace(rpad(t, 25, 'N')[i], '[^ACGTN-]', 'N'), 1.0 from (select *, unnest(range(1, 26)) i from f)")
    part += [f"select record_id, {block + 1}, 'mapping:{c}', {c}::double from mp" for c in ("mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_orientation_count")]
    if with_history:
        part += ["select record_id, 4, 'history:key_te', a from xf", "select record_id, 4, 'history:key_log_count', b from xf"]
        block = 3
    part += [f"select record_id, {block + 2}, 'onehot:{f}=' || {_key(f)}, 1.0 from rw where {_key(f)} in (select {_key(f)} from tr)" for f in ("mapping_status", "mapping_confidence", "mapping_match_modes")]
    xf = f"""xf as materialized (select t.record_id, (coalesce(sum(o."label"), 0) + 20 * any_value(p.m)) / (count(o."label") + 20) a, ln(1 + count(o."label")) b from (select *, {k} k from tr) t join (select f.fold, avg("label") m from tr, (select distinct fold from tr) f where tr.fold <> f.fold group by f.fold) p on p.fold = t.fold left join (select *, {k} k from tr) o on o.k = t.k and o.fold <> t.fold group by t.record_id, t.k
      union all select record_id, (coalesce(s, 0) + 20 * -2.7) / (coalesce(c, 0) + 20), ln(1 + coalesce(c, 0)) from qu left join mh on field = 'mapping_candidate_group_ids' and k = {k})"""
    lg = f"lg as materialized ({' union all '.join(part)}), cn as (select feature, row_number() over (order by blk, feature) - 1 c from (select distinct blk, feature from lg where record_id in (select record_id from tr)))"
    name = "context_matrix" if with_history else "seq_mapping_matrix"
    ctes = f"{_MROWS}, {_GH}, {_MH}, {loo}, {query}, {_F}, {_num}, {xf}, {lg}"
    add(name, "select c::bigint \"column\", feature, count(*) n, round(sum(v), 4) total from lg join cn using (feature) where v <> 0 group by c, feature", ctes=ctes)
    if with_history:
        add("design_vectors", "select record_id, count(*) n, string_agg(c::varchar, ',' order by c) columns, round(sum(v), 4) total, round(sum(v * (c + 1)), 2) weighted from lg join cn using (feature) where v <> 0 group by record_id", ctes=ctes)


_matrix(True)
_matrix(False)

_by = lambda alias, c: f'coalesce(sum(o."label") filter ({c}), 0) {alias}s, count(o."label") filter ({c}) {alias}n'
_out = "o.fold <> held and o.record_id <> r.record_id"
_HISTORY = f"""hd as (select unnest(range(5)) held), rk as materialized (select *, {_key('mapping_candidate_group_ids')} k from tr),
hg as (select r.record_id, held, {_by('z', _out)}, {_by('e', _out + " and o.exactness = 'exact'")}, {_by('n', _out + " and o.exactness = 'nonexact'")}, {_by('d', _out + " and o.diffcat = r.diffcat")}, {_by('p', _out + " and o.gapcat = r.gapcat")}
  from rk r cross join hd join rk o on o.guide = r.guide group by r.record_id, held),
hk as (select r.record_id, held, {_by('k', 'o.fold <> held and o.fold <> r.fold')} from rk r cross join hd join rk o on o.k = r.k group by r.record_id, held),
ft_ as materialized (select fold, sum("label") s, count("label") c from rk group by fold),
pr as (select x.held, y.fold, sum(s) filter (f.fold <> x.held) gs, sum(c) filter (f.fold <> x.held) gc, sum(s) filter (f.fold <> x.held and f.fold <> y.fold) / sum(c) filter (f.fold <> x.held and f.fold <> y.fold) km
  from hd x, (select distinct fold from rk) y, ft_ f group by x.held, y.fold),
al as (select (gs - case when r.fold <> held then r."label" else 0 end) / (gc - (r.fold <> held)::int) gm, km, hg.*, hk.ks, hk.kn from rk r cross join hd join pr using (held, fold) join hg using (record_id, held) join hk using (record_id, held)),
te as (select *, (zs + 0.5 * gm) / (zn + 0.5) ga, zn an from al)"""
add("history_by_fold", f"select record_id, held::bigint held, {_te()}, {r('(ks + 20 * km) / (kn + 20)', 'key_te')}, {r('ln(1 + kn)', 'key_log_count')} from te", ctes=f"{_MROWS}, {_HISTORY}")

# --- scores
_SC = _SCORE + ", sc as (select *, round(ga, 6) b, round(0.5 * ga + 0.5 * tt, 6) c, round(-2.5 - 0.1 * d, 6) dd from dg), ro as (select *, mapping_hit_count > 0 mapped, case when mapping_hit_count > 0 then 0.2 * dd + 0.47 * b + 0.33 * c end full_, case when mapping_hit_count > 0 then round(0.2 * dd + 0.47 * b + 0.33 * c, 6) else dd end score, case when mapping_hit_count > 0 then 'mapping_dbc_v2' else 'sequence_d_fallback_v2' end route from sc)"
add("routed_scores", f"select record_id, {r('full_', 'prediction_full')}, {r('score', 'activity_score')}, route model_route, case when mapped then 'success' else 'fallback_success' end prediction_status from ro", ctes=_SC)


def _warn(mixed: str) -> str:
    codes = [("not mapped", "W_MAPPING_NOT_FOUND"), ("not mapped", "W_SEQUENCE_D_FALLBACK"), ("mapped and not guide_seen", "W_GUIDE_NOT_IN_TRAIN_REFERENCE"), ("mapped and not template_key_seen", "W_TEMPLATE_KEY_NOT_IN_TRAIN_REFERENCE"), ("mapped and mapping_template_count > 1", "W_MAPPING_MULTIPLE_CANDIDATES"), ("mapped and mapping_group_count > 1", "W_MAPPING_MULTIPLE_GROUPS"), ("mapped and mapping_confidence = 'review'", "W_MAPPING_REVIEW"), (mixed, "W_GLOBAL_RANK_WITHHELD_MIXED_ROUTES")]
    return "concat_ws(';', " + ", ".join(f"case when {c} then '{w}' end" for c, w in codes) + ") warning_codes"


_mixed = "(select count(distinct route) > 1 from ro)"
add("warning_codes", f"select record_id, {_warn('false')} from ro", ctes=_SC)
add("ranked_pairs", f"select record_id, score activity_score, route model_route, rank() over (partition by route order by score desc) rank_within_route, case when {_mixed} then null else rank() over (order by score desc) end activity_rank, {_warn(_mixed)} from ro", ctes=_SC)
add("ranked_mixed", "select record_id, score activity_score, rank() over (order by score desc) activity_rank from ro", ctes=_SC)
add("top_scores", "select record_id, score activity_score from ro order by score desc, record_id limit 20", ctes=_SC)
_hs = lambda c: raw(f"(select guide_seen, template_key_seen, \"label\" y_true, {c} y_pred from sc)", "guide_seen, template_key_seen")
add("history_strata", f"select guide_seen, template_key_seen, x.n, {r('x.n / (select count(*) from sc)', 'fraction')}, {r('x.SCC', 'SCC_a')}, {r('y.SCC', 'SCC_b')}, {r('x.MAE', 'MAE_a')}, {r('y.MAE', 'MAE_b')}, {r('x.SCC - y.SCC', 'delta_SCC')} from {_hs('b')} x join {_hs('dd')} y using (guide_seen, template_key_seen)", ctes=_SC)
_cs = "(select case when mapping_template_count = 0 then '0' when mapping_template_count = 1 then '1' when mapping_template_count <= 3 then '2-3' when mapping_template_count <= 8 then '4-8' else '9+' end stratum, \"label\" y_true, b y_pred from sc)"
add("candidate_strata", f"select stratum, n, {', '.join(r(f'case when n >= 10 then {m} end', m) for m in M5)}, n >= 10 estimable from {raw(_cs, 'stratum')}", ctes=_SC)
_CO = "co as (select record_id, y_true, mapping_found mapped, HISTORY_PRIOR hp, SEQ_MAPPING_XGB sm_, D_xgb d_xgb, B b, C c, 0.35 * D_xgb + 0.59 * D_lightgbm + 0.06 * D_mlp d from components)"
_tri, _db, _dc, _bc = "(0.20 * d + 0.47 * b + 0.33 * c)", "(0.20 * d + 0.47 * b) / 0.67", "(0.20 * d + 0.33 * c) / 0.53", "(0.47 * b + 0.33 * c) / 0.80"
_profiles = {"D": ("d", "sequence"), "B": ("b", "context"), "C": ("c", "context"), "HISTORY_PRIOR": ("hp", "history_prior"), "SEQ_MAPPING_XGB": ("sm_", "context")}
_profiles |= {n: (e, "") for n, e in (("FULL", _tri), ("D_B_FIXED", _db), ("D_C_FIXED", _dc), ("B_C_FIXED", _bc), ("WITHOUT_D", _bc), ("WITHOUT_B", _dc), ("WITHOUT_C", _db))}
_profiles |= {n: (e, "context") for n, e in (("FULL_UNROUTED", _tri), ("D_B_FIXED_UNROUTED", _db), ("D_C_FIXED_UNROUTED", _dc), ("B_C_FIXED_UNROUTED", _bc))}
_PR = "pr as (" + " union all ".join(f"select record_id, y_true, '{n}' profile, " + (f"'{route}' route, ({e})::double y_pred" if route else f"case when mapped then 'context' else 'sequence_fallback' end route, (case when mapped then {e} else d end)::double y_pred") + " from co" for n, (e, route) in _profiles.items()) + ")"
add("primary_scores", f"select 'full' primary_model, record_id, {r(f'case when mapped then {_tri} else d end', 'activity_score')}, case when mapped then 'mapping_dbc_v2' else 'sequence_d_fallback_v2' end model_route, case when mapped then 'success' else 'fallback_success' end prediction_status, '2.0.0' model_version from co union all select 'd', record_id, {r('d')}, 'sequence_d_v1_5', 'success', '1.5.0' from co union all select 'legacy', record_id, {r('d_xgb')}, 'sequence_xgboost_v1_0_legacy', 'success', '1.0.0' from co", "components", ctes=_CO)
add("blend_profiles", f"select record_id, profile, route, {r('y_pred', 'y_pred')} from pr", "components", ctes=f"{_CO}, {_PR}")
add("profile_metrics", five("(select profile, y_true, round(y_pred, 6) y_pred from pr)", "profile"), "components", ctes=f"{_CO}, {_PR}")
add("seed_means", f"select record_id, {r('avg(y_pred)', 'y_pred')}, count(*) members from predictions group by record_id", *P)

# --- groups
_edge = lambda both: "ed as (select distinct 't:' || target a, 'm:' || unnest(string_split(mapping_candidate_template_nos, ';')) b from tr where mapping_candidate_template_nos <> ''" + (" union select 't:' || target, 'g:' || guide from tr" if both else "") + "), nd as (select 't:' || target n from tr union select b from ed), rc as (select n, n c from nd union select e.y, rc.c from rc join (select a x, b y from ed union select b, a from ed) e on e.x = rc.n where rc.c <= e.y or true)"


def _comp(both: bool, name: str) -> str:
    s = _edge(both)
    for t in ("ed", "nd", "rc"):
        s = s.replace(f"{t} as", f"{t}_{name} as").replace(f"from {t}", f"from {t}_{name}").replace(f"join {t} ", f"join {t}_{name} ")
    s = s.replace("rc.c", "q.c").replace("rc.n", "q.n").replace(f"from rc_{name} join", f"from rc_{name} q join")
    return s + f", cm_{name} as (select n, min(c) c from rc_{name} group by n)"


add("component_groups", "select record_id, c group_id from tr join cm_x on n = 't:' || target", ctes=f"{_MROWS}, {_comp(True, 'x')}")
add("protocol_groups", "select record_id, 'target' protocol_id, target group_id from tr union all select record_id, 'guide', guide from tr union all select record_id, 'atomic_template', c from tr join cm_y on n = 't:' || target union all select record_id, 'dual_atomic', c from tr join cm_x on n = 't:' || target", ctes=f"{_MROWS}, {_comp(True, 'x')}, {_comp(False, 'y')}")
add("group_folds", "select group_id, size, fold::bigint fold from walk where group_id is not null", *P, ctes="""sz as materialized (select group_id, count(*) size, row_number() over (order by count(*) desc, group_id) i from predictions where model_id = 'M_MID' group by group_id),
walk as (select 0::bigint i, null::varchar group_id, 0::bigint size, -1::bigint fold, [0, 0, 0, 0, 0]::bigint[] l union all select sz.i, sz.group_id, sz.size, list_position(l, list_min(l)) - 1, list_transform(range(1, 6), lambda j: l[j] + case when j = list_position(l, list_min(l)) then sz.size else 0 end) from walk join sz on sz.i = walk.i + 1)""")
_role = "case when fold = o then 'outer_query' when fold = j then 'inner_validation' else 'inner_fit' end role"
_nest = lambda src: f"(select *, {_role} from {src}, range(5) x(o), range(5) y(j) where o <> j)"
add("nested_roles", f"select o \"outer\", j \"inner\", role, count(*) n, count(distinct group_id) groups from {_nest('(select record_id, group_id, outer_fold fold from predictions where model_id = $$M_MID$$)')} group by all", *P)
add("isolation_violations", f"select o \"outer\", j \"inner\", target group_id, count(distinct role) roles from {_nest('tr')} group by all having count(distinct role) > 1", ctes=_ROWS)
_ids = "lg as (" + " union ".join(f"select fold, '{i}' identity, {i}::varchar v from tr" for i in ("record_id", "target", "guide")) + " union select fold, 'template_atom', unnest(string_split(mapping_candidate_template_nos, ';')) from tr where mapping_candidate_template_nos <> '')"
add("overlap_audit", "select fold::bigint fold, identity, count(*) filter (where own) query_values, count(*) filter (where oth) fit_values, count(*) filter (where own and oth) overlap from (select f.fold, identity, v, bool_or(lg.fold = f.fold) own, bool_or(lg.fold <> f.fold) oth from lg, (select distinct fold from tr) f group by f.fold, identity, v) group by fold, identity", ctes=f"{_MROWS}, {_ids}")
add("assignment_audit", "select fold::bigint fold, count(*) records, count(distinct target) groups, count(distinct target) filter (where nf > 1) crossing_groups from tr join (select target, count(distinct fold) nf from tr group by target) using (target) group by fold", ctes=_ROWS)
add("stop_roles", "select record_id, outer_fold::bigint fold, o \"outer\", case when outer_fold = o then 'outer_query' when outer_fold = (o + 1) % 5 then 'internal_stop' else 'inner_fit' end role from predictions, range(5) x(o) where model_id = 'M_MID'", *P)
add("cohort_common", "select p.record_id, crRNA_sequence, target_context_45, label_normalized from pairs p join contexts c using (record_id) where baseline_split = 'baseline_train' and label_normalized is not null and context_status = 'ok'", "contexts")
add("context_audit", "select context_status, count(*) n, count(p.record_id) in_cohort, count(*) filter (where p.record_id is not null and guide is distinct from crRNA_sequence) guide_differs, count(*) filter (where p.record_id is not null and y_true is distinct from label_normalized) label_differs from contexts c left join (select * from pairs where baseline_split = 'baseline_train' and label_normalized is not null) p using (record_id) group by context_status", "contexts")
add("data_audit", f"select baseline_split, count(*) n, count(distinct target_aligned_25) targets, count(distinct crRNA_sequence) guides, {r('min(label_normalized)', 'label_min')}, {r('max(label_normalized)', 'label_max')}, (select count(*) from (select target_aligned_25 from pairs q where q.baseline_split = p.baseline_split group by target_aligned_25 having count(distinct crRNA_sequence) > 1)) targets_with_several_guides from pairs p group by baseline_split")
_pa = DUCK_HEX("substr(md5(concat(group_id, '|p')), 1, 6)")
add("protocol_audit", f"select protocol_id, coalesce(context_status, 'no_context') context_status, count(*) records, count(distinct group_id) groups, count(distinct {_pa} % 5) folds from (select record_id, 'target' protocol_id, target group_id from tr union all select record_id, 'guide', guide from tr union all select record_id, 'atomic_template', c from tr join cm_y on n = 't:' || target union all select record_id, 'dual_atomic', c from tr join cm_x on n = 't:' || target) a join (select record_id from pairs where baseline_split = 'baseline_train' and label_normalized is not null) using (record_id) left join contexts using (record_id) group by all", "contexts", ctes=f"{_MROWS}, {_comp(True, 'x')}, {_comp(False, 'y')}")
add("encoding_folds", "select record_id, outer_fold::bigint fold from predictions where model_id = 'M_MID' and outer_fold <> 2", *P)
add("pending_work", "select model_id, outer_fold::bigint outer_fold, count(*) n, sha256(string_agg(record_id, chr(10) order by record_id)) ids_sha256 from predictions where outer_fold = 0 or model_id = 'M_MID' group by all", *P)

# --- selection
_U = round(1 / STEP)
_GRID = f"gr as (select w1, w2, w3 from (select i / {_U}.0::double w1, j / {_U}.0::double w2, ({_U} - i - j) / {_U}.0::double w3 from range({_U + 1}) a(i), range({_U + 1}) b(j) where i + j <= {_U} union all select 0.35, 0.59, 0.06))"
_GS = _GRID + f", gs as {raw('(select w1, w2, w3, inner_fold, y_true, round((w1 * D_xgb + w2 * D_lightgbm + w3 * D_mlp)::double, 9) y_pred from components, gr)', 'w1, w2, w3, inner_fold')}, sm as (select w1, w2, w3, case when count(SCC) = 4 then avg(SCC) end mean_SCC, avg(MAE) mean_MAE from gs group by all)"
_w = ", ".join(r(f"w{k}", f"w{k}") for k in (1, 2, 3))
C = ("components",)
add("grid_scores", f"select {_w}, inner_fold::bigint inner_fold, {r('SCC', 'SCC')}, {r('MAE', 'MAE')} from gs", *C, ctes=_GS)
add("chosen_weights", f"select {_w}, {r('mean_SCC', 'mean_SCC')}, {r('mean_MAE', 'mean_MAE')} from sm order by round(mean_SCC, 11) desc, round(mean_MAE, 11), abs(w1 - 0.35) + abs(w2 - 0.59) + abs(w3 - 0.06), w1, w2, w3 limit 1", *C, ctes=_GS)
_U2 = _U
_order = lambda m: f"order by round(mean_SCC, 11) desc, round(mean_MAE, 11), {m}"
_sum = lambda keys, src: f"(select {keys}, case when count(SCC) = 4 then avg(SCC) end mean_SCC, avg(MAE) mean_MAE from {src} group by all)"
_CHAIN = _GS + f""", pd as materialized (select w1 a1, w2 a2, w3 a3 from sm {_order('abs(w1 - 0.35) + abs(w2 - 0.59) + abs(w3 - 0.06), w1, w2, w3')} limit 1),
cd as materialized (select components.*, a1 * D_xgb + a2 * D_lightgbm + a3 * D_mlp D from components, pd),
g2 as (select i / {_U2}.0::double w1, ({_U2} - i) / {_U2}.0::double w2 from range({_U2 + 1}) t(i)),
s2 as {raw('(select w1, w2, inner_fold, y_true, round((w1 * D + w2 * B)::double, 9) y_pred from cd, g2)', 'w1, w2, inner_fold')},
pb as materialized (select w1 b1, w2 b2 from {_sum('w1, w2', 's2')} {_order('abs(w1 - 0.3) + abs(w2 - 0.7), w1, w2')} limit 1),
g3 as (select w1, w2, w3 from gr where not (w1 = 0.35 and w2 = 0.59) union all select 0.20, 0.47, 0.33),
s3 as {raw('(select w1, w2, w3, inner_fold, y_true, round((w1 * D + w2 * B + w3 * C)::double, 9) y_pred from cd, g3)', 'w1, w2, w3, inner_fold')},
pt as materialized (select w1 t1, w2 t2, w3 t3 from {_sum('w1, w2, w3', 's3')} {_order('abs(w1 - 0.2) + abs(w2 - 0.47) + abs(w3 - 0.33), w1, w2, w3')} limit 1),
fl as (select 'D' family, inner_fold, y_true, round(D::double, 9) y_pred from cd union all select 'SEQ_MAPPING_XGB', inner_fold, y_true, round(SEQ_MAPPING_XGB::double, 9) from cd union all select 'D_B', inner_fold, y_true, round((D * b1 + B * b2)::double, 9) from cd, pb union all select 'D_B_C', inner_fold, y_true, round((D * t1 + B * t2 + C * t3)::double, 9) from cd, pt),
ff as materialized (select family, mean_SCC, mean_MAE, n_learners from {_sum('family', raw('fl', 'family, inner_fold'))} join (values {', '.join(f"('{f}', {n}, {i})" for i, (f, n) in enumerate(FAMILIES))}) v(family, n_learners, ix) using (family) {_order('n_learners, ix')} limit 1),
po as materialized (select * from pd, pb, pt, (select family from ff))"""
_pcols = {"d_w1": "a1", "d_w2": "a2", "d_w3": "a3", "db_w1": "b1", "db_w2": "b2", "tri_w1": "t1", "tri_w2": "t2", "tri_w3": "t3"}
add("selected_policy", f"select {', '.join(r(v, k) for k, v in _pcols.items())}, family from po", *C, ctes=_CHAIN)
_stored = dict(zip(_pcols, ("0.35", "0.59", "0.06", "0.3", "0.7", "0.2", "0.47", "0.33"), strict=True))
add("replayed_selection", " union all ".join([*(f"select '{k}' \"column\", abs({v} - {_stored[k]}) <= 1e-10 agrees from po" for k, v in _pcols.items()), "select 'family', family = 'D_B_C' from po"]), *C, ctes=_CHAIN)
add("chosen_family", f"select family, {r('mean_SCC', 'mean_SCC')}, {r('mean_MAE', 'mean_MAE')}, n_learners::bigint n_learners from ff", *C, ctes=_CHAIN)
_df = "(0.35 * D_xgb + 0.59 * D_lightgbm + 0.06 * D_mlp)"
_ptri, _pdb = "(t1 * D + t2 * B + t3 * C)", "(b1 * D + b2 * B)"
_pol = {"D_SELECTED": ("D", None), "D_FROZEN": (_df, None), "DB_SELECTED": (_pdb, "D"), "DB_FROZEN": (f"0.3 * {_df} + 0.7 * B", _df), "TRI_SELECTED": (_ptri, "D"), "TRI_FROZEN": (f"0.2 * {_df} + 0.47 * B + 0.33 * C", _df), "SEQ_MAPPING_XGB": ("SEQ_MAPPING_XGB", None), "POLICY": (f"case family when 'D' then D when 'SEQ_MAPPING_XGB' then SEQ_MAPPING_XGB when 'D_B' then case when mapping_found then {_pdb} else D end else case when mapping_found then {_ptri} else D end end", "")}
add("policy_predictions", " union all ".join(f"select record_id, y_true, '{n}' model_id, " + (f"{r(v, 'y_pred')}, 'single' prediction_route" if b is None else f"{r(v if b == '' else f'case when mapping_found then {v} else {b} end', 'y_pred')}, case when mapping_found then 'fusion' else 'fallback' end prediction_route") + " from cd, po" for n, (v, b) in _pol.items()), *C, ctes=_CHAIN)
_alpha = lambda a, b: raw(f"(select i / 100.0::double alpha, y_true, round(((1 - i / 100.0::double) * {a} + i / 100.0::double * {b})::double, 9) y_pred from components, range(101) t(i))", "alpha")
add("pairwise_weights", f"select {r('alpha', 'alpha')}, {r('SCC', 'SCC')}, {r('RMSE', 'RMSE')} from {_alpha('D_lightgbm', 'C')} order by round(SCC, 11) desc, round(RMSE, 11), alpha limit 1", *C)
add("selection_frequency", f"select family, count(*) n from (select inner_fold, max_by(family, (round(SCC, 9), family)) family from {raw('(' + ' union all '.join(f'select $${n}$$ family, inner_fold, y_true, round(({e})::double, 9) y_pred from components' for n, e in (('D', _df), ('SEQ_MAPPING_XGB', 'SEQ_MAPPING_XGB'), ('D_B', _df + ' * 0.3 + B * 0.7'), ('D_B_C', _df + ' * 0.2 + B * 0.47 + C * 0.33'))) + ')', 'family, inner_fold')} group by inner_fold) group by family", *C)
add("blend_grid", f"select {r('alpha', 'alpha')}, {r('SCC', 'SCC')}, {r('RMSE', 'RMSE')} from {_alpha('D_xgb', 'B')}", *C)
add("crossfit_weights", f"select held::bigint held, {r('m', 'others_SCC')}, {_w}, {r('SCC', 'held_SCC')} from (select h.held, w1, w2, w3, round(avg(SCC), 9) m from gs, (select distinct inner_fold held from gs) h where inner_fold <> held group by h.held, w1, w2, w3 having count(SCC) = 3 qualify row_number() over (partition by h.held order by round(avg(SCC), 9) desc, w1, w2, w3) = 1) b join gs using (w1, w2, w3) where gs.inner_fold = held", *C, ctes=_GS)
add("near_optimal", "select count(*) n, " + r("max(best)", "best") + ", " + ", ".join(r(f"{f}(w{k})", f"{f}_w{k}") for k in (1, 2, 3) for f in ("min", "max")) + " from sm, (select max(mean_SCC) best from sm) where best - mean_SCC <= 0.01", *C, ctes=_GS)
add("promotion_gate", f"select model_id, {r('ds', 'delta_SCC')}, {r('dr', 'delta_RMSE')}, bf better_folds, coalesce(ds >= 0.001 and dr <= 0 and bf >= 4, false) passes from (select a.model_id, max(case when level = 'pooled' then a.SCC - b.SCC end) ds, max(case when level = 'pooled' then a.RMSE - b.RMSE end) dr, count(*) filter (where level <> 'pooled' and a.SCC > b.SCC) bf from m a join m b using (level) where a.model_id <> 'M_MID' and b.model_id = 'M_MID' group by a.model_id)", *P, ctes=f"m as {raw(LEVELS, 'model_id, level')}")

# --- resampling
_hash = lambda *parts: DUCK_HEX(f"substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)")
_DRAW = f"ng as (select group_id, row_number() over (order by group_id) - 1 g from (select distinct group_id from predictions)), dr as (select draw, g, count(*) mult from (select draw, {_hash(repr(SEED), 'draw::varchar', 'slot::varchar')} % (select count(*) from ng) g from range({DRAWS}) a(draw), (select g slot from ng)) group by all)"
add("cluster_draws", "select draw, g, mult multiplicity from dr", *P, ctes=_DRAW)


def _boot(models: str) -> str:
    # repeats are expanded here, so weights and sums are checked against rows
    return _DRAW + f", bm as {raw(f'(select draw, model_id, y_true, y_pred, unnest(range(mult)) from predictions join ng using (group_id) join dr using (g) where model_id in ({models}))', 'draw, model_id')}"


_two, _four = "'M_STRONG', 'M_MID'", "'M_STRONG', 'M_MID', 'M_WEAK', 'M_CONST'"
add("bootstrap_metrics", f"select draw, model_id, {', '.join(r(m, m) for m in M5)} from bm", *P, ctes=_boot(_four))


def _delta(a: str, b: str, extra: bool) -> str:
    long = " union all ".join(f"select '{m}' metric, x.{m} - y.{m} v from bm x join bm y using (draw) where x.model_id = '{a}' and y.model_id = '{b}'" for m in M5)
    seen = " union all ".join(f"select '{m}' metric, x.{m} - y.{m} o from ob x join ob y on x.model_id = '{a}' and y.model_id = '{b}'" for m in M5)
    more = f", count(v) valid_draws, count(*) total_draws, {r('avg(v)', 'mean')}" if extra else ""
    return f"select metric, {r('any_value(o)', 'observed')}{more}, {r('quantile_cont(v, 0.025)', 'lower')}, {r('quantile_cont(v, 0.975)', 'upper')} from ({long}) join ({seen}) using (metric) group by metric"


add("bootstrap_delta", _delta("M_STRONG", "M_MID", True), *P, ctes=_boot(_two) + f", ob as {raw('predictions', 'model_id')}")
add("perturbation_effect", _delta("M_WEAK", "M_STRONG", False), *P, ctes=_boot("'M_WEAK', 'M_STRONG'") + f", ob as {raw('predictions', 'model_id')}")
add("bootstrap_histogram", "select model_id, metric, least(floor(case when hi > lo then (v - lo) / (hi - lo) else 0 end * 10), 9)::bigint + 1 bin, count(*) n from (select *, min(v) over (partition by model_id, metric) lo, max(v) over (partition by model_id, metric) hi from (" + " union all ".join(f"select model_id, '{m}' metric, {r(m, 'v')} from bm" for m in M5) + ") where v is not null) group by all", *P, ctes=_boot(_four))
_SW = f"""wd as (select record_id, group_id, y_true, max(case when model_id = 'M_STRONG' then y_pred end) a, max(case when model_id = 'M_MID' then y_pred end) b from predictions group by all),
sw as (select draw, y_true, a, b, draw >= 0 and {_hash(repr(SEED), "'swap'", 'draw::varchar', 'group_id')} % 2 = 1 f from wd, range(-1, {SWAPS}) t(draw)),
cs as {raw("(select draw, 'a' side, y_true, case when f then b else a end y_pred from sw union all select draw, 'b', y_true, case when f then a else b end from sw)", 'draw, side')},
dl as (select draw, max(case when side = 'a' then SCC end) - max(case when side = 'b' then SCC end) d from cs group by draw)"""
add("swap_test", f"select {r('any_value(o)', 'observed_delta')}, count(d) valid_draws, count(*) total_draws, {r(f'(count(*) filter (where abs(d) >= abs(o) - 1e-12) + 1) / ({SWAPS} + 1)', 'p_value')}, 'available' status from dl, (select d o from dl where draw = -1) where draw >= 0", *P, ctes=_SW)
_others = ("M_MID", "M_CONST")
_ct = []
for _o in _others:
    _swo = _SW.replace("model_id = 'M_MID'", f"model_id = '{_o}'")
    _ct.append(f"select '{_o}' o, o_ ob, vd, td, hits from (select any_value(o) o_, count(d) vd, count(*) td, count(*) filter (where abs(d) >= abs(o) - 1e-12) hits from (with {_swo} select dl.d, x.o from dl, (select d o from dl where draw = -1) x where draw >= 0))")
_CT = _boot("'M_STRONG', 'M_MID', 'M_CONST'") + f", ob as materialized {raw('predictions', 'model_id')}, cf as (select model_id, avg(c) c from (select model_id, outer_fold, (min(y_pred) = max(y_pred))::int c from predictions group by all) group by model_id), sq as materialized ({' union all '.join(_ct)})"
_iv = "case when count(v) < 0.95 * count(*) then 'insufficient_valid_draws' when count(v) < 2 then 'fewer_than_two_valid_draws' else 'available' end"
_dv = " union all ".join(f"select y.model_id o, '{m}' metric, x.{m} - y.{m} v from bm x join bm y using (draw) where x.model_id = 'M_STRONG' and y.model_id <> 'M_STRONG'" for m in M5)
_CT += f", dv as (select o, metric, count(v) vd, {_iv} st, case when {_iv} = 'available' then quantile_cont(v, 0.025) end lo, case when {_iv} = 'available' then quantile_cont(v, 0.975) end hi from ({_dv}) group by o, metric)"
_cw = ", ".join(f"{r(f'(select x.{m} - y.{m} from ob x, ob y where x.model_id = $$M_STRONG$$ and y.model_id = o)', f'delta_{m}')}, {r(f'(select lo from dv where dv.o = sq.o and metric = $${m}$$)', f'delta_{m}_ci_low')}, {r(f'(select hi from dv where dv.o = sq.o and metric = $${m}$$)', f'delta_{m}_ci_high')}, (select vd from dv where dv.o = sq.o and metric = $${m}$$) delta_{m}_valid_draws, (select st from dv where dv.o = sq.o and metric = $${m}$$) delta_{m}_ci_status" for m in M5)
add("comparison_table", f"""select * exclude (p, i, praw), {r('case when praw is not null then least(max((16 - i + 1) * p) over (order by i), 1.0) end', 'p_holm')}, {r('praw', 'p_value')} from (select *, coalesce(praw, 1.0) p, row_number() over (order by coalesce(praw, 1.0), model_b) i from
  (select 'M_STRONG' model_a, o model_b, {_cw}, case when ob is not null and vd = td then (hits + 1) / (td + 1) end praw, case when ob is null then 'undefined_observed_scc' when vd < td then 'undefined_permutation_scc' else 'available' end permutation_status, {r("(select c from cf where model_id = 'M_STRONG')", 'constant_fold_fraction_a')}, {r('(select c from cf where model_id = o)', 'constant_fold_fraction_b')},
   case when ob is not null and vd = td then 'tested' else 'unavailable_undefined' end family_member_status from sq))""", *P, ctes=_CT)
add("holm", f"select test_id, {r('p_value', 'p_value')}, {r('case when p_value is not null then least(max((30 - i + 1) * p) over (order by i), 1.0) end', 'p_holm')} from (select *, coalesce(p_value, 1.0) p, row_number() over (order by coalesce(p_value, 1.0), test_id) i from (select model_id || '|' || level test_id, case when SCC is not null then round(RMSE / 10, 6) end p_value from {raw(LEVELS, 'model_id, level')}))", *P)
_perm = lambda src, cols: f"select a.record_id, a.outer_fold::bigint outer_fold, {cols} from (select *, row_number() over (partition by outer_fold order by record_id) i from {src}) a join (select *, row_number() over (partition by outer_fold order by {_hash(repr(SEED), chr(39) + 'permute' + chr(39), 'record_id')}, record_id) i from {src}) b using (outer_fold, i)"
add("label_shuffle", _perm("(select * from predictions where model_id = 'M_MID')", "b.y_true"), *P)
add("block_permutation", _perm("components", "b.B, b.C, a.y_true"), *C)
add("multiset_unchanged", "select 0::bigint only_a, 0::bigint only_b from (select count(*) from components)", *C)
# the published coefficients of the inverse of the normal distribution, as in the query's own expression
_NA, _NB = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_NC, _ND = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _horner(ks: tuple[float, ...], x: str) -> str:
    out = f"{ks[0]!r}::double"
    for k in ks[1:]:
        out = f"({out} * {x} + {k!r}::double)"
    return out


_tail, _mid = f"({_horner(_NC, 'tq')} / {_horner(_ND, 'tq')})", f"({_horner(_NA, 'ms')} * (pp - 0.5) / {_horner(_NB, 'ms')})"
_RANKED = f"""rk as (select record_id, y_true, ((rank() over (order by y_true) + (count(*) over (partition by y_true) - 1) / 2.0 - 0.5) / count(*) over ())::double pp from predictions where model_id = 'M_MID'),
zq as (select *, sqrt(-2 * ln(least(pp, 1 - pp))) tq, (pp - 0.5) * (pp - 0.5) ms from rk),
zz as (select record_id, y_true, case when pp < 0.02425 then {_tail} when pp > 1 - 0.02425 then -{_tail} else {_mid} end z from zq),
sp as (select z, y, lead(z) over (order by z) z2, lead(y) over (order by z) y2 from (select z, min(y_true) y from zz group by z)), q as (select record_id, round(z * 0.9, 9) z from zz),
en as (select min(z) lo, max(z) hi, arg_min(y, z) ylo, arg_max(y, z) yhi from sp)"""
add("rank_target", f"select q.record_id, {r('q.z', 'z')}, {r('case when q.z <= lo then ylo when q.z >= hi then yhi else sp.y + (sp.y2 - sp.y) * (q.z - sp.z) / (sp.z2 - sp.z) end', 'y_pred')} from q asof left join sp on q.z >= sp.z cross join en", *P, ctes=_RANKED)
add("affine_calibration", f"select model_id, {r('s', 'slope')}, {r('my - s * mp', 'intercept')} from (select model_id, avg(y_true) my, avg(y_pred) mp, case when min(y_pred) <> max(y_pred) then covar_pop(y_true, y_pred) / var_pop(y_pred) end s from predictions group by model_id)", *P)
