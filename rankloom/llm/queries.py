"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, licenses, merkle, nearjoin, packing, periodic, pii, quality, repeats, sharding, warc, wavelet
from .common import LOWER, UPPER, WORD, new_path, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by five-word Jaccard similarity of 0.8 or more: class, links and copies of each document; without words or without an id of its class, see nearjoin."""
    return nearjoin.classes(table(spark, sf_dir, "documents"))


def op2_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in whole texts; null and empty texts have no words and no labels."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by fixed patterns and by bootstrapped contexts; null and empty texts have no spans."""
    return pii.report(table(spark, sf_dir, "documents"))


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by law `rows`; a null text has no bytes, a null id is a value like any other, repeated rows are rows of their own."""
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token alone, repeated rows are packed each for itself."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine links of 0.98 and more within a label; vectors that are null, zero or not finite, and those without a label, link with nothing."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; null and empty texts are scored too, a document without an id is not held out."""
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents.select("doc_id", "text"), model, column="score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in whole texts; null texts have no words, items without an id have windows but are not listed."""
    judged = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "overlap.*")


def op9_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records written and read back; a null html is empty, repeated rows are records of their own."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that strings of 50 bytes of earlier documents cover; a null text is empty, a document without an id keeps everything."""
    return repeats.removed_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op11_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of at least 24 words and three periods; null and empty texts have none, a document without an id gets no periodic tail."""
    documents = table(spark, sf_dir, "documents")
    text = periodic.with_periodic_tail(F.col("text"), F.col("doc_id"))
    found = periodic.find(documents.select("doc_id", text.alias("text"))).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back; a null or empty text is its end id alone, null ids come first, rows of one id are documents of their own."""
    wavelet.write(table(spark, sf_dir, "documents"), path := new_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"))
    return wavelet.read(spark, path)


def op13_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, proofs and their check after texts of some documents were lower-cased; null fields, texts and languages are leaves and groups like others."""

    def tampered(documents: DataFrame):
        text = F.translate("text", UPPER, LOWER)
        return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest(*(F.col(x) for x in ("doc_id", "source", "lang", "n_chars")), text))

    documents = table(spark, sf_dir, "documents")
    return merkle.manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], changed=tampered)


WORDS_SQL = f"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), lambda x: x <> '')"""

_NOTICES = [(label, licenses.tokens_of(t), math.ceil(len(licenses.spelt(t)) / licenses.THRESHOLD - 1e-9)) for label, texts in licenses.TEMPLATES.items() for t in texts]
_NOTICE_ROWS = ", ".join(f"({k}, '{label}', {ts!r}, {math.ceil(licenses.THRESHOLD * len(ts) - 1e-9)}, {width})" for k, (label, ts, width) in enumerate(_NOTICES))
_STARTS = {p: " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())) for p in licenses.PHRASES}
OP2_SQL = f"""
with t(k, label, ts, need, width) as (values {_NOTICE_ROWS}),
d as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from documents),
w as (select r, doc_id, regexp_extract_all(low, '{WORD}') w from d),
p as (select r, i - 1 i, case {" ".join(f"when {c} then '{licenses.PHRASES[x]}'" for x, c in _STARTS.items())} end label
      from (select r, w, unnest(range(1, len(w) + 1)) i from w) where {" or ".join(f"({c})" for c in _STARTS.values())}),
b as (select r, count(*) n, min(i) a, max(i) z, list(distinct label) labels from p group by r),
l as (select distinct r, list_distinct(regexp_extract_all(line, '{WORD}')) ts from (select r, unnest(string_split(low, chr(10))) line from d)),
h as (select r, w, k, label, ts, need, width from w, t where len(list_intersect(w, ts)) >= need),
v as (select r, label, ts, need, list_intersect(list_distinct(w[i:i + width - 1]), ts) met from (select *, unnest(range(1, greatest(len(w) - width + 1, 1) + 1)) i from h)),
m as (select r, label, max(part) best from (select r, label, len(list_intersect(l.ts, t.ts)) / len(t.ts) part from l, t where len(l.ts) >= need and len(list_intersect(l.ts, t.ts)) >= need
      union all select r, label, len(met) / len(ts) from v where len(met) >= need) group by r, label),
g as (select r, list(label) labels, max(best) best from m group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_base, cast(a as bigint) first_word, cast(z as bigint) last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') labels,
       case when n > 0 then 1.0 else coalesce(best, 0.0) end::double score
from w left join b using (r) left join g using (r)"""

OP8_SQL = f"""
with d as (select row_number() over () r, doc_id, {WORDS_SQL} w from documents),
b as (select item_id, {WORDS_SQL} w from benchmark),
win as (select distinct least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g, item_id
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from win),
occ as (select r, i, n, item_id from (
          select r, i, sizes.n, array_to_string(w[i:i + sizes.n - 1], ' ') g
          from (select r, w, unnest(range(1, len(w) + 1)) i from d where len(w) > 0), sizes where i + sizes.n - 1 <= len(w)) join win using (n, g)),
hit as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from (select distinct r, i, n from occ)) group by r),
it as (select r, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct r, cast(item_id as varchar) s from occ where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit using (r) left join it using (r)"""

OP9_SQL = """
with b as (select page_id, encode(coalesce(html, '')) p from pages),
h as (select page_id, cast(octet_length(p) as bigint) n, sha1(p) s from b),
c as (select page_id, n, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(s, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31 as int), 1), '' order by k) from range(32) t(k)) d from h),
f as (select *, min(page_id) over (partition by d, n) first from c)
select page_id, n payload_bytes, d payload_digest, case when first < page_id then 'revisit' else 'response' end record_type, case when first < page_id then first end refers_to from f"""


OP10_SQL = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select r, doc_id, i, substr(h, 2 * i - 1, 100) g from (select r, doc_id, h, unnest(range(1, length(h) // 2 - 48)) i from d where length(h) >= 100)),
f as (select g, min(doc_id) m from p group by g),
x as (select r, i, lag(i) over (partition by r order by i) b from p join f using (g) where m < doc_id),
k as (select r, i, sum(case when b is null or i > b + 50 then 1 else 0 end) over (partition by r order by i) k from x),
s as (select r, min(i) a, max(i) + 49 z from k group by r, k),
o as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) b from s),
q as (select r, count(*) n, sum(z - a + 1) c, max(z) z, string_agg(substr(h, 2 * b + 1, 2 * (a - b - 1)), '' order by a) t from o join d using (r) group by r)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(c, 0) as bigint) n_removed, cast(coalesce(n, 0) as bigint) n_spans,
       sha256(unhex(case when n is null then h else t || substr(h, 2 * z + 1) end)) kept_sha256
from d left join q using (r)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII string, bit by bit."""
    byte = f"case when k % 8 = 0 then xor(c, ascii({text}[k // 8 + 1])) else c end"
    return f"xor(list_reduce(list_prepend(4294967295, range(8 * length({text}))), lambda c, k: xor(({byte}) >> 1, 3988292384 * (({byte}) & 1))), 4294967295)"


OP11_SQL = "".join(("""
with h as (select row_number() over () r, doc_id, coalesce(text, '') t, """, crc32_sql("cast(doc_id as varchar)"), """ h from documents),
v as (select r, doc_id, h, list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') v from h),
a as (select r, doc_id, v, len(v) n, case when h % 10 = 0 and len(v) > 0 then (h // 10) % len(v) end a, h // 10 g from v),
p as (select *, 1 + (n - a) // (3 + g % 8) p from a),
w as (select r, doc_id, case when a is null then v else list_concat(v[1:a], list_transform(range(n - a), lambda i: v[a + i % p + 1])) end w from p),
grams as (select r, i, hash(w[i:i + 15]) x from (select r, w, unnest(range(1, len(w) - 14)) i from w where len(w) >= 24)),
lists as materialized (select r, x, list(i order by i) l from grams group by r, x having count(*) > 1),
firsts as (select r, l, unnest(range(1, len(l))) k from lists),
pairs as (select r, l[k] i, unnest(l[k + 1:]) - l[k] q from firsts),
cut as (select r, q, i, i - row_number() over (partition by r, q order by i) c from pairs),
runs as (select r, min(i) - 1 s, count(*) + 15 + q n, q from cut group by r, q, c having count(*) + 15 + q >= greatest(24, 3 * q)),
own as (select * from runs x where not exists (select 1 from runs y where y.r = x.r and y.q < x.q and x.q % y.q = 0 and y.s <= x.s and y.s + y.n >= x.s + x.n)),
best as (select r, s, n, q from own qualify row_number() over (partition by r order by n::double / q desc, s, q) = 1),
text as (select r, count(*) n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) t from own group by r),
gone as (select distinct r, unnest(range(s + q + 1, s + n + 1)) i from own),
kept as (select r, string_agg(w, ' ' order by i) t from (select r, unnest(w) w, unnest(range(1, len(w) + 1)) i from w) x where not exists (select 1 from gone g where g.r = x.r and g.i = x.i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, s::bigint start, n::bigint length, q::bigint period, (1000 * n // q)::bigint exponent_milli,
       sha256(coalesce(text.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from w left join best using (r) left join text using (r) left join kept using (r)"""))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({x})::varchar)) || ':' || ({x})::varchar, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _merkle_sql(levels: int = 8) -> str:
    """CTEs n0, n1, ... of (tree, i, node) by level, and p0, p1, ... of every document's proof and folded digest so far; first within languages, then above them."""
    out = [
        f"""d as (select row_number() over () r, doc_id, lang, {_leaf_sql("text")} leaf,
         case when {crc32_sql("cast(doc_id as varchar)")} % 3 = 0 then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} end other from documents)""",
        "g as (select lang, row_number() over (order by encode(lang) nulls first) - 1 t from (select distinct lang from d))",
        "a0 as (select r, t tree, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 i, leaf node from d join g on d.lang is not distinct from g.lang)",
        "p0 as (select a0.r, tree, i, '' proof, coalesce(other, leaf) node from a0 join d using (r))",
        "n0 as (select tree, i, node from a0)",
    ]
    for k in range(2 * levels):
        if k == levels:  # from languages' trees to the tree of languages
            out += [f"s as (select tree, node subroot from n{k})", f"m{k} as (select 0 tree, tree i, node from n{k})", f"q{k} as (select r, 0 tree, tree i, proof, node from p{k})"]
        n, p = (f"m{k}", f"q{k}") if k == levels else (f"n{k}", f"p{k}")
        out += [
            f"c{k} as (select tree, count(*) c from {n} group by tree)",
            f"n{k + 1} as (select tree, i // 8 i, case when max(c) > 1 then sha256(string_agg(node, '' order by i)) else any_value(node) end node from {n} join c{k} using (tree) group by tree, i // 8)",
            f"""b{k} as (select x.tree, x.i, coalesce(string_agg(y.node, '' order by y.i) filter (y.i < x.i), '') l, coalesce(string_agg(y.node, '' order by y.i) filter (y.i > x.i), '') h
                 from {n} x join {n} y on x.tree = y.tree and x.i // 8 = y.i // 8 group by x.tree, x.i)""",
            f"p{k + 1} as (select r, tree, i // 8 i, proof || l || h proof, case when c > 1 then sha256(l || node || h) else node end node from {p} join b{k} using (tree, i) join c{k} using (tree))",
        ]
    return ", ".join(out)


OP13_SQL = f"""
with {_merkle_sql()}
select doc_id, leaf, subroot, n16.node root, sha256(p16.proof) proof_sha256, p16.node folded_root, p16.node = n16.node verified
from d join g on d.lang is not distinct from g.lang join s on s.tree = g.t join p16 using (r) cross join n16"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lsh_forest, op2_set_join, op3_bootstrapped, op4_hash_ring, op5_differencing, op6_cover_tree, op7_boosted_trees, op8_wu_manber, op9_chunked_warc, op10_linear_grouping, op11_kruskal_runs, op12_wavelet_matrix, op13_butterfly)}


def oracle_sql() -> dict[str, str]:
    return {"op2_set_join": OP2_SQL, "op8_wu_manber": OP8_SQL, "op9_chunked_warc": OP9_SQL, "op10_linear_grouping": OP10_SQL, "op11_kruskal_runs": OP11_SQL, "op13_butterfly": OP13_SQL}
