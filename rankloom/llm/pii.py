"""Personal data: fixed patterns, and identifiers found by bootstrapped context patterns, in DataFrame operations alone.

Base: e-mail and IP addresses, card and phone numbers, by one regular expression each, leftmost and non-overlapping.
Positions come from the lengths of what a regular expression matches and of what lies between; running sums over
a document's matches turn them into code point offsets. The expressions are written with possessive
repetition, so that texts of any length match in linear time and constant stack.

Bootstrapping: an entity has contexts of several families: the last word and the last two words before it, the first and
the first two after it, the label or punctuation that it is glued to (email:, tel=, a bracket), and its own shape together with the word
before or after it (a shape alone would make any number of sixteen digits a card). Words are taken without the punctuation around them, and punctuation that stands
alone is none. Contexts that occur with at least `support` different
known entities of a kind are patterns; every other identifier-like token (one with a digit or an at sign) in such a
context is an instance. Spark scores the graph of patterns and instances in rounds: a pattern's confidence is the mean
score of its instances, an instance's score the noisy-or of its patterns' confidences; instances that score enough count
as known in the next round and bring in new patterns. Tokens in the context of a confident pattern that are instances
with a sufficient score become spans of the pattern's kind, unless they overlap a base span.

A null or empty text has no spans. Repeated rows have the same spans each. Very frequent contexts and instances are
counted before they are shuffled, and edges are distinct, so a context is as many rows as it has different instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match to the plain forms; look-behinds and \G only skip starts at which no match can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
#: Identifier-like tokens: between white space, with a digit or an at sign.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What may stand before a token within its word: punctuation, and a label with a colon or an equals sign.
_LEAD = r"^[\"'(\[{<:;,.]*(?:[A-Za-z][A-Za-z_-]*[:=](?!//)[\"'(\[{<]*)?"
#: Punctuation around a word of a context.
_AROUND = r"^[\"'(\[{<:;,.=]+|[\"')\]}>:;,.!?=({\[<]+$"
#: Words kept of either end of what lies between matches: two, and what may be glued to a match.
_WORDS = 4
#: Contexts of more letters are known by their digest.
_LONG = 64
SUPPORT, CONFIDENCE, SCORE, ROUNDS = 3, 0.6, 0.6, 3


def _pieces(text: Column, pattern: str) -> Column:
    """For each match: the length of what lies before it, the words at both ends of that, and the match; last, what lies behind all, without a match."""
    # punctuation that stands alone is no word; what is glued to a match stays
    spaced = lambda p: F.regexp_replace(p, r"\s+(?:[^\p{L}\p{N}\s]++\s+)*+", " ")

    def ends(p: Column) -> Column:
        words = F.transform(F.array(spaced(p)), lambda w: F.struct(F.length(p).alias("gap"), apart(w, F.substring_index(w, " ", _WORDS), False).alias("head"), apart(w, F.substring_index(w, " ", -_WORDS), True).alias("tail")))
        return words[0]

    # an end that isn't the whole piece isn't glued to the match beyond it
    apart = lambda whole, end, left: F.when(F.length(end) < F.length(whole), F.concat(F.lit(" "), end) if left else F.concat(end, F.lit(" "))).otherwise(end)
    between = F.transform(F.split(text, pattern, -1), ends)
    return F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p["gap"].alias("gap"), p["head"].alias("head"), p["tail"].alias("tail"), m.alias("match")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c: c.cast("int")),
        F.struct(F.lit(0).alias("sum"), (n % 2).alias("odd")),
        lambda a, d: F.struct((a["sum"] + F.when(a["odd"] == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)).alias("sum"), (1 - a["odd"]).alias("odd")),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_extract(p, "^0*([0-9]*)$", 1).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _key(id_column: Column, text: Column) -> Column:
    """Rows equal in id and text share a key; the length keeps ids and texts apart, and a null id is an empty one."""
    return F.md5(F.concat_ws("|", F.length(text).cast("string"), F.coalesce(id_column.cast("string"), F.lit("")), text))


def _contexts(left: Column, right: Column, match: Column) -> Column:
    """Contexts of all families that there are, lower-case, each behind the name of its family."""
    bare = lambda side: F.filter(F.transform(F.split(F.lower(side), r"\s+"), lambda w: F.regexp_replace(w, _AROUND, "")), lambda w: w != "")
    before, after = bare(left), bare(right)
    n, m = F.size(before), F.size(after)
    named = lambda family, text, ok: F.when(ok, F.concat(F.lit(f"{family}:"), F.when(F.length(text) > _LONG, F.md5(text.cast("binary"))).otherwise(text)))
    glued = F.regexp_extract(F.lower(left), r"(\S+)$", 1)
    shape = F.regexp_replace(F.regexp_replace(match, r"\p{L}+", "a"), "[0-9]", "9")
    return F.array_compact(F.array(
        named("l1", F.get(before, n - 1), n > 0), named("l2", F.concat_ws(" ", F.get(before, n - 2), F.get(before, n - 1)), n > 1),
        named("r1", F.get(after, F.lit(0)), m > 0), named("r2", F.concat_ws(" ", F.get(after, F.lit(0)), F.get(after, F.lit(1))), m > 1),
        named("glued", glued, glued != ""), named("sl", F.concat_ws(" ", F.get(before, n - 1), shape), n > 0), named("sr", F.concat_ws(" ", shape, F.get(after, F.lit(0))), m > 0),
    ))


def occurrences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each document; and of each distinct key (kind, start, end, match, contexts), base spans and identifier-like tokens (kind token)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<gap:int,head:string,tail:string,match:string>>")
    found = {k: F.when(F.contains("text", F.lit(_NEEDS[k])) if _NEEDS[k] else F.col("text").rlike("[0-9]"), _pieces(F.col("text"), p)).otherwise(none) for k, p in PATTERNS.items()}
    found["token"] = F.when(F.col("text").rlike("[0-9@]"), _pieces(F.col("text"), _TOKEN)).otherwise(none)
    slim = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    slim = cut(slim.select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("key"), *[v.alias(k) for k, v in found.items()]))
    some = slim.where(" or ".join(f"size({k}) > 1" for k in found)).drop("doc_id").dropDuplicates(["key"])
    each = some.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("all")) for k in found])).alias("x")).where("size(x.all) > 1").select("key", "x.kind", F.posexplode("x.all").alias("nth", "m"))
    so_far = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("key", "kind").orderBy("nth")
    at = lambda field, k: F.coalesce(F.lead(F.col(f"m.{field}"), k).over(near), F.lit(""))
    placed = each.select(
        "key", "kind", "m", F.sum(F.col("m.gap") + F.length("m.match")).over(so_far).alias("end"),
        F.concat(at("match", -2), at("tail", -1), at("match", -1), "m.tail").alias("left"), F.concat(at("head", 1), at("match", 1), at("head", 2), at("match", 2)).alias("right"),
    ).where("m.match is not null")
    spans = placed.select("key", "kind", (F.col("end") - F.length("m.match")).alias("start"), "end", F.col("m.match").alias("match"), "left", "right").where(_valid(F.col("kind"), F.col("match")))
    # tokens without the label before them and the punctuation around them, which is context
    lead = F.when(F.col("kind") == "token", F.length(F.regexp_extract("match", _LEAD, 0))).otherwise(0)
    trail = F.when(F.col("kind") == "token", F.length(F.regexp_extract("match", r"[\"')\]}>:;,.!?]*$", 0))).otherwise(0)
    spans = spans.withColumns({"lead": lead, "trail": trail}).where("length(match) > lead + trail")
    inner = F.substr("match", F.col("lead") + 1, F.length("match") - F.col("lead") - F.col("trail"))
    left, right = F.concat("left", F.left("match", F.col("lead"))), F.concat(F.right("match", F.col("trail")), "right")
    spans = spans.select("key", "kind", (F.col("start") + F.col("lead")).alias("start"), (F.col("end") - F.col("trail")).alias("end"), inner.alias("match"), left.alias("left"), right.alias("right"))
    spans = spans.select("key", "kind", "start", "end", "match", _contexts(F.col("left"), F.col("right"), F.col("match")).alias("contexts"))
    return slim.select("doc_id", "key"), cut(spans)


def bootstrap(spans: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, score: float = SCORE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (kind, context) and the instances (kind, instance) that they discover."""
    is_base = F.col("kind") != "token"
    # a token that overlaps a base span is no candidate
    base = spans.where(is_base)
    edges = base.select(F.explode("contexts").alias("context"), F.lower("match").alias("instance")).distinct()
    seeds = base.select(F.lower("match").alias("instance"), "kind").distinct().groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    every = candidates(spans).select(F.explode("contexts").alias("context"), F.lower("match").alias("instance")).distinct().unionByName(edges).distinct()
    size = every.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") > support)  # support known instances, and another
    graph = cut(every.join(size, "context"))
    known, patterns, found = cut(seeds), None, None
    for _ in range(rounds):
        scored = graph.join(known, "instance").groupBy("context", "kind", "n").agg(F.sum("score").alias("mass"))
        patterns = cut(scored.where((F.col("mass") >= support) & (F.col("mass") >= confidence * F.col("n"))).select("context", "kind", F.least(F.col("mass") / F.col("n"), F.lit(0.99)).alias("confidence")))
        new = graph.join(patterns, "context").join(seeds.select("instance"), "instance", "left_anti").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = new.where(F.col("score") >= score).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"))
        found = cut(best.select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")))
        known = seeds.unionByName(found)
    return patterns.select("context", "kind"), found.select("instance", "kind")


def candidates(spans: DataFrame) -> DataFrame:
    """Identifier-like tokens of at least four characters that overlap no base span of their document."""
    token = spans.where((F.col("kind") == "token") & (F.col("end") - F.col("start") >= 4))
    base = spans.where(F.col("kind") != "token").select("key", F.col("start").alias("s"), F.col("end").alias("e"))
    return token.join(base, (token["key"] == base["key"]) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")), "left_anti")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each document, and (key, kind, start, end, base) of each span."""
    docs, spans = occurrences(documents, id_col, text_col)
    patterns, instances = bootstrap(spans, **parameters)
    more = candidates(spans).select("key", "start", "end", F.lower("match").alias("instance"), F.explode("contexts").alias("context")).join(instances, "instance").join(patterns, ["context", "kind"])
    more = more.select("key", "kind", "start", "end").distinct()  # one span, however many patterns it has
    own = spans.where(F.col("kind") != "token").select("key", "kind", "start", "end", F.lit(True).alias("base"))
    return docs, own.unionByName(more.select("key", "kind", "start", "end", F.lit(False).alias("base")))


def _number(kind: str) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


def report(documents: DataFrame, **parameters) -> DataFrame:
    """One row for each document: doc_id, the number of base spans of each kind, base_sha256, and all spans."""
    docs, spans = find(documents, **parameters)
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct("start", _number("kind").alias("number"), "end", name.alias("name"), "base")
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["name"]), ",")
    grouped = spans.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("all"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS])
    sums = grouped.select("key", *[f"n_{k}" for k in KINDS], joined(F.filter("all", lambda s: s["base"])).alias("own"), joined(F.col("all")).alias("spans"))
    out = docs.join(sums, "key", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("own", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """documents with every span of the text replaced by its kind in brackets; n_chars, where there is such a column, counts anew."""
    _, spans = find(documents, id_col, text_col, **parameters)
    key, found = free(documents, "__key"), free(documents, "__spans")
    hidden = spans.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(found))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = documents.withColumn(key, _key(F.col(id_col), text)).join(hidden, key, "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        gap = F.substr(F.col(text_col), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        mark = F.concat(gap, F.when(s["end"] > a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], F.array(mark)).alias("parts"))

    hide = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(F.col(text_col), (a["at"] + 1).cast("int"))))
    new = {text_col: F.when(F.col(found).isNull(), F.col(text_col)).otherwise(hide)}
    out = keyed.withColumns(new)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
