"""Mapping of ungapped targets onto windows of reference templates: exact first, ambiguity codes where nothing is exact.

Targets are mapped once, however many pairs have them. Equal texts share their anchor, the least hash of their first runs of 16 letters; neighbouring
windows mostly share it too, so a template is some rows for each class of lengths, one an anchor, not one a window. Lengths that agree but for
what exceeds a multiple of eight are one class, whose anchors look at as many letters as its shortest has. Exact hits are an equi join on
anchors, after which the target is looked for in the text that an anchor's windows cover.
For the rest, the parts of templates whose windows have ambiguity codes are spelt out, and their spellings are met by anchors too. Parts of many spellings are
taken window by window: windows and targets with codes are spelt out to plain k-mers, so that compatible ones share
one, and joined on that. Where spelling out would take more than `most` k-mers, a stretch of such a sequence is the join key: of its
four, the one with the fewest spellings, against the same stretch of all others; codes are then compared position by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, ship, spread
from ..functions.sequences import IUPAC, iupac_compatible, normalize_sequence, reverse_complement, ungap

MOST = 1024
#: Letters of an anchor; queries of one anchor beyond which it is taken window by window; lengths of a class from ANCHOR on.
ANCHOR, SHARED, CLASS = 16, 256, 8
FIELDS = ["mapping_status", "mapping_confidence", "mapping_hit_count", "mapping_template_count", "mapping_group_count", "mapping_orientation_count", "mapping_candidate_template_nos", "mapping_candidate_group_ids", "mapping_candidate_orientations", "mapping_match_modes"]


def targets_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(ungap(normalize_sequence("target_aligned_25")).alias("target")).where("target is not null").distinct()


def template_windows(templates: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every window of each length that targets have (column k); plain: without ambiguity codes."""
    templates = templates.withColumn("__plain", F.col("template_sequence_clean").rlike("^[ACGT]+$"))  # all windows of it are; told once, and filters on plain reach the templates
    at = templates.join(F.broadcast(lengths), F.length("template_sequence_clean") >= F.col("k"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.length("template_sequence_clean") - F.col("k"))).alias("start_0based"))
    window = F.substr("template_sequence_clean", F.col("start_0based") + 1, F.col("k"))
    plain = F.col("__plain") | F.col("window").rlike("^[ACGT]+$")
    return at.select("template_no", "template_group_id", "start_0based", window.alias("window"), "__plain").withColumn("plain", plain).drop("__plain")


def orientations(targets: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("forward").alias("orientation"), F.col("target").alias("query")), F.struct(F.lit("reverse_complement").alias("orientation"), reverse_complement("target").alias("query")))
    return targets.select("target", F.explode(both).alias("o")).select("target", "o.*")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _anchors(texts: list[str], k: int) -> np.ndarray:
    """The anchor of each window of k letters of texts of one length, a row a text: the least hash of its runs of ANCHOR letters, or of all its letters, if it has fewer."""
    letters = np.array(texts).view(np.uint32).reshape(len(texts), -1).astype(np.uint64)
    m, codes = min(k, ANCHOR), np.uint64(0)
    for i in range(m):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + letters[:, i : letters.shape[1] - m + 1 + i]
    codes = (codes ^ codes >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    least = (codes ^ codes >> np.uint64(29)).view(np.int64)
    have, want = 1, k - m + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[:, :-step], least[:, step:]), have + step
    return least


def _alike(texts: list[str], k: np.ndarray) -> Iterator[np.ndarray]:
    """Places of texts of one length and one k, which is no longer, some four million letters at once."""
    n = np.array([len(t) for t in texts], np.int64)
    for length, width in sorted({x for x in zip(n.tolist(), k.tolist(), strict=True) if x[0] >= x[1] > 0}):
        at, step = np.flatnonzero((n == length) & (k == width)), max(1, (1 << 22) // length)
        yield from (at[lo : lo + step] for lo in range(0, len(at), step))


def length_class(k: Column | np.ndarray):
    """How many first letters of a text of k letters its anchor looks at."""
    rest = k % CLASS
    return F.when(k < ANCHOR, k).otherwise(k - rest).cast("int") if isinstance(k, Column) else np.where(k < ANCHOR, k, k - rest)


def by_class(lengths: DataFrame) -> DataFrame:
    """(k, upto) of lengths: each class and the longest in it."""
    return lengths.groupBy(length_class(F.col("k")).alias("k")).agg(F.max("k").alias("upto"))


def _keys(anchors: np.ndarray, k: int) -> np.ndarray:
    """Anchors that classes don't share, so that a join has one number as its key."""
    return anchors ^ np.int64(k * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF)


def anchored(df: DataFrame) -> DataFrame:
    """Rows of a text, k and start (of the text, in its template) with key, start, windows and stretch instead: neighbouring windows of one anchor are one row, with their number and the text that they cover.

    With upto, windows are as long as that, as far as the text goes, though anchors look at k letters.
    """
    ship(df.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ks, starts, upto = batch.column(4).to_pylist(), *(batch.column(c).to_numpy() for c in (2, 3, 5))
            for at in _alike(texts, ks):
                k = int(ks[at[0]])
                a = _anchors([texts[i] for i in at], k)
                row, first = np.nonzero(np.column_stack([np.ones(len(a), bool), a[:, 1:] != a[:, :-1]]))
                after = np.append(np.where(row[1:] == row[:-1], first[1:], a.shape[1]), a.shape[1])
                of = at[row]
                stretch = [texts[i][lo:hi] for i, lo, hi in zip(of.tolist(), first.tolist(), (after + upto[of] - 1).tolist(), strict=True)]
                columns = [*(batch.column(c).take(pa.array(of)) for c in (0, 1, 2)), pa.array(_keys(a[row, first], k)), pa.array((starts[of] + first).astype(np.int32)), pa.array((after - first).astype(np.int32)), pa.array(stretch, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["template_no", "template_group_id", "k", "key", "start", "windows", "stretch"])

    upto = F.col("upto") if "upto" in df.columns else F.col("k")
    slim = df.where(F.length("text") >= F.col("k")).select("template_no", "template_group_id", F.col("k").cast("int"), F.col("start").cast("int"), "text", upto.cast("int").alias("upto"))
    of = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(runs, f"template_no {of['template_no']}, template_group_id {of['template_group_id']}, k int, key long, start int, windows int, stretch string")


def _with_anchor(queries: DataFrame, classes: bool) -> DataFrame:
    """(target, orientation, query, k, key): k is the query's length, or with classes its class, and key the anchor of as many first letters."""
    ship(queries.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            k = np.array([len(t) for t in texts], np.int32)
            k = length_class(k).astype(np.int32) if classes else k
            key = np.zeros(len(k), np.int64)
            for at in _alike(texts, k):
                key[at] = _keys(_anchors([texts[i][: k[i]] for i in at], int(k[at[0]]))[:, 0], int(k[at[0]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k), pa.array(key)], names=["target", "orientation", "query", "k", "key"])

    return queries.where("query <> ''").select("target", "orientation", "query").mapInArrow(add, "target string, orientation string, query string, k int, key long")


def _met_by_anchor(queries: DataFrame, runs: DataFrame, shared: int = SHARED, classes: bool = False) -> DataFrame:
    """Where plain queries (target, orientation, query) stand in anchored texts. What more than `shared` queries have for an anchor is taken window by window, so that an anchor is no large group."""
    q = cut(_with_anchor(queries, classes))
    common = cut(q.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shared).select("key"))
    columns = ["target", "template_no", "template_group_id", "start_0based", "orientation"]

    def found(q: DataFrame, runs: DataFrame) -> DataFrame:
        # the key alone is what rows are sorted by, as a number; that classes are the same is no second key
        met = q.withColumnRenamed("k", "__k").join(runs, "key").where((F.col("k") <= F.col("__k")) & (F.col("k") >= F.col("__k")) & F.contains("stretch", "query"))
        windows = F.sequence(F.lit(0), F.least(F.col("windows") - 1, F.length("stretch") - F.length("query")))
        at = met.select("*", F.explode(F.filter(windows, lambda i: F.substr("stretch", i + 1, F.length("query")) == F.col("query"))).alias("at"))
        return at.select("*", (F.col("start") + F.col("at")).alias("start_0based")).select(*columns)

    if common.isEmpty():
        return found(q, runs)
    lengths = q.select("k", F.length("query").alias("length")).distinct()
    single = runs.join(common, "key", "left_semi").join(F.broadcast(lengths), "k").where(F.length("stretch") >= F.col("length"))
    single = single.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("windows") - 1, F.length("stretch") - F.col("length")))).alias("at"))
    single = single.select("template_no", "template_group_id", (F.col("start") + F.col("at")).alias("start_0based"), F.substr("stretch", F.col("at") + 1, F.col("length")).alias("query"))
    return found(q.join(common, "key", "left_anti"), runs).unionByName(q.join(common, "key", "left_semi").join(single, "query").select(*columns))


def exact_hits(queries: DataFrame, templates: DataFrame, lengths: DataFrame, shared: int = SHARED) -> DataFrame:
    """A window that a plain query equals is plain, so codes need no look here."""
    whole = templates.join(F.broadcast(by_class(lengths))).select("template_no", "template_group_id", "k", "upto", F.lit(0).alias("start"), F.col("template_sequence_clean").alias("text"))
    return _met_by_anchor(queries.where(F.col("query").rlike("^[ACGT]+$")), anchored(whole), shared, True).withColumn("match_mode", F.lit("exact_acgt"))


def coded_parts(templates: DataFrame, lengths: DataFrame) -> DataFrame:
    """The parts (start, text) of templates all of whose windows of k letters have a code, as long as they go, and their numbers of spellings."""
    text, k = F.col("template_sequence_clean"), F.col("k")
    at = templates.where(~text.rlike("^[ACGT]+$")).join(F.broadcast(lengths), F.length(text) >= k)
    coded = F.filter(F.sequence(F.lit(0), F.length(text) - k), lambda i: F.length(F.translate(F.substr(text, i + 1, k), "ACGT", "")) > 0)

    def parts(c: Column) -> Column:
        first = F.filter(c, lambda x, j: (j == 0) | (F.get(c, j - 1) < x - 1))
        return _let(first, lambda s: F.transform(s, lambda x, j: F.struct(x.alias("start"), F.array_max(F.filter(c, lambda y: F.coalesce(y < F.get(s, j + 1), F.lit(True)))).alias("last"))))

    made = at.select("*", F.explode(_let(coded, parts)).alias("__p"))
    made = made.select("template_no", "template_group_id", "k", "__p.start", F.substr(text, F.col("__p.start") + 1, F.col("__p.last") - F.col("__p.start") + k).alias("text"))
    return made.withColumn("ways", spellings(F.col("text")))


def _choices(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for code, bases in IUPAC.items() for x in (F.lit(code), F.array(*map(F.lit, bases)))]), c)


def spellings(c: Column) -> Column:
    """How many plain k-mers a sequence stands for; 0 with a letter that is no code."""
    other = F.filter(F.split(F.translate(c, "ACGT", ""), ""), lambda x: x != "")
    return F.when(c == "", 0.0).otherwise(F.aggregate(other, F.lit(1.0), lambda n, x: n * F.coalesce(F.size(_choices(x)), F.lit(0))))


def spell(c: Column) -> Column:
    """All plain k-mers of a sequence, which is taken by stretches without codes and single codes."""
    parts = F.regexp_extract_all(c, F.lit("[ACGT]+|[^ACGT]"), F.lit(0))
    ways = lambda x: F.when(F.length(F.translate(x, "ACGT", "")) == 0, F.array(x)).otherwise(_choices(x))
    return F.aggregate(parts, F.array(F.lit("")), lambda all_, x: F.flatten(F.transform(all_, lambda a: F.transform(ways(x), lambda b: F.concat(a, b)))))


_STRETCHES, _SPELT = 4, 64


def _stretches(text: Column, pairs: bool) -> Column:
    """Stretches of a sequence, four or (pairs) of two letters each, with their numbers and of how many spellings."""
    n = F.length(text)
    many = F.ceil(n / 2).cast("int") if pairs else F.lit(_STRETCHES)

    def one(i: Column) -> Column:
        lo, hi = F.floor(n * i / many), F.floor(n * (i + 1) / many)
        part = F.substr(text, (lo + 1).cast("int"), (hi - lo).cast("int"))
        return F.struct(spellings(part).alias("ways"), i.alias("i"), part.alias("text"))

    return F.filter(F.transform(F.sequence(F.lit(0), many - 1), one), lambda x: x["text"] != "")


def _seeds(df: DataFrame, text: str, best: bool, pairs: bool = False) -> DataFrame:
    """df with key: the spellings of its stretches (with best: of that with the fewest), by length and number. A stretch of too many spellings has the key `*`; with best, every row has that too, for them."""
    made = _stretches(F.col(text), pairs)
    chosen = df.select("*", F.array_min(made).alias("__s")) if best else df.select("*", F.explode(made).alias("__s"))
    none = F.array().cast("array<string>")
    texts = F.when(F.col("__s.ways") <= _SPELT, spell(F.col("__s.text"))).otherwise(none)
    key = F.explode(F.concat(texts, F.when(F.lit(True) if best else F.col("__s.ways") > _SPELT, F.array(F.lit("*"))).otherwise(none)))
    return chosen.select("*", key.alias("__t")).select(*df.columns, F.concat_ws("|", F.length(text), "__s.i", "__t").alias("key"))


def _met_by_stretch(wide: DataFrame, wide_text: str, others: DataFrame, text: str) -> DataFrame:
    """Pairs of compatible rows; a pair meets at the spelt stretch that the wide side chose, or at its `*` where the other side can't be spelt.

    Wide rows none of whose four stretches can be spelt meet by stretches of two letters, which always can.
    """
    fewest = F.array_min(_stretches(F.col(wide_text), False))["ways"]
    sides = [(wide.where(fewest <= _SPELT), False)]
    if (wide.agg(F.max(fewest)).first()[0] or 0) > _SPELT:
        sides.append((wide.where(fewest > _SPELT), True))
    met = [_seeds(w, wide_text, True, pairs).join(_seeds(others, text, False, pairs), "key").drop("key").where(iupac_compatible("query", "window")) for w, pairs in sides]
    return met[0] if len(met) == 1 else met[0].unionByName(met[1])


def iupac_hits(queries: DataFrame, templates: DataFrame, lengths: DataFrame, exact: DataFrame, most: int = MOST, shared: int = SHARED) -> DataFrame:
    """Compatible windows other than the query itself, of targets without any exact hit. Kinds of sequences that don't occur cost nothing."""
    left = cut(queries.join(exact.select("target").distinct(), "target", "left_anti").withColumn("ways", spellings(F.col("query"))).where("ways > 0"))
    parts = cut(coded_parts(templates, lengths))
    columns = ["target", "template_no", "template_group_id", "start_0based", "orientation"]
    of_window = ["template_no", "template_group_id", "start_0based", "window"]

    def coded_windows(of: DataFrame) -> DataFrame:
        at = of.select("*", F.explode(F.sequence(F.lit(0), F.length("text") - F.col("k"))).alias("at"))
        made = at.select("template_no", "template_group_id", (F.col("start") + F.col("at")).alias("start_0based"), F.substr("text", F.col("at") + 1, F.col("k")).alias("window"))
        return made.withColumn("w_ways", spellings(F.col("window"))).where("w_ways > 0")

    few = (F.col("ways") > 0) & (F.col("ways") <= min(_SPELT, most))
    spelt_parts = parts.where(few).select("template_no", "template_group_id", "k", "start", F.explode(spell(F.col("text"))).alias("text"))
    wide = cut(coded_windows(parts.where(~few)))
    most_q, most_w = (df.agg(F.max(c)).first()[0] or 0 for df, c in ((left, "ways"), (wide, "w_ways")))
    few_q = left.where(F.col("ways") <= most)
    # two plain texts can't be compatible and different, so one side has codes
    spell_windows = lambda w: w.where(F.col("w_ways") <= most).select(*of_window, F.explode(spell(F.col("window"))).alias("kmer"))
    plain_q = few_q.where("ways = 1")
    out = _met_by_anchor(plain_q, anchored(spelt_parts), shared)
    met = []
    if most_w > 0:
        met.append(plain_q.select("target", "orientation", "query", F.col("query").alias("kmer")).join(spell_windows(wide), "kmer"))
    if most_q > 1:
        with_codes, plain = coded_windows(parts), template_windows(templates, lengths).where("plain")
        every = spell_windows(with_codes).unionByName(plain.select(*of_window, F.col("window").alias("kmer")))
        met.append(few_q.where("ways > 1").select("target", "orientation", "query", F.explode(spell(F.col("query"))).alias("kmer")).join(every, "kmer"))
    if most_w > most:
        met.append(_met_by_stretch(wide.where(F.col("w_ways") > most).select(*of_window), "window", left.select("target", "orientation", "query"), "query"))
    if most_q > most:
        few_w = plain.select(*of_window).unionByName(with_codes.where(F.col("w_ways") <= most).select(*of_window))
        met.append(_met_by_stretch(left.where(F.col("ways") > most).select("target", "orientation", "query"), "query", few_w, "window"))
    for m in met:
        out = out.unionByName(m.where("window <> query").select(*columns))
    return out.distinct().withColumn("match_mode", F.lit("iupac_compatible"))


def rollup_hits(hits: DataFrame) -> DataFrame:
    """Counts and sorted sets of each target's hits, and the status that they decide. Counts are the sets' sizes, so a hit is one row in the shuffle."""
    text = lambda c: F.array_join(F.array_sort(c), ";")
    size = lambda c: F.size(c).cast("long")
    at = F.when(F.col("template_no").isNotNull(), F.struct("template_no", "start_0based", "orientation"))
    sets = {"nos": "template_no", "groups": "template_group_id", "orientations": "orientation", "modes": "match_mode"}
    got = hits.groupBy("target").agg(F.count("*").alias("mapping_hit_count"), (F.min(at) == F.max(at)).alias("one_position"), *[F.collect_set(c).alias(f"__{n}") for n, c in sets.items()])
    got = got.select(
        "target", "mapping_hit_count", size("__nos").alias("mapping_template_count"), size("__groups").alias("mapping_group_count"), size("__orientations").alias("mapping_orientation_count"), "one_position",
        F.array_join(F.transform(F.array_sort("__nos"), lambda x: x.cast("string")), ";").alias("mapping_candidate_template_nos"), text("__groups").alias("mapping_candidate_group_ids"), text("__orientations").alias("mapping_candidate_orientations"), text("__modes").alias("mapping_match_modes"),
    )
    return decide(got).drop("one_position")


def decide(rolled: DataFrame) -> DataFrame:
    exact, groups = F.col("mapping_match_modes") == "exact_acgt", F.col("mapping_group_count")
    status = (
        F.when(exact & F.col("one_position"), "unique_exact_window").when(exact & (F.col("mapping_template_count") == 1), "ambiguous_position_same_template").when(exact & (groups == 1), "ambiguous_template_single_group")
        .when((F.col("mapping_match_modes") == "iupac_compatible") & (groups == 1), "iupac_compatible_single_group").when(groups > 1, "ambiguous_multiple_groups").otherwise("ambiguous_source_mapping")
    )
    rolled = rolled.withColumn("mapping_status", status)
    sure = F.when(F.col("mapping_status") == "unique_exact_window", "high").when(F.col("mapping_status").isin("ambiguous_position_same_template", "ambiguous_template_single_group"), "medium").otherwise("review")
    return rolled.withColumn("mapping_confidence", sure)


def all_hits(targets: DataFrame, templates: DataFrame, most: int = MOST, shared: int = SHARED) -> DataFrame:
    """Both tables are derived once, whatever is made of them."""
    targets = cut(targets.where("target <> ''"))
    templates = cut(spread(templates.select("template_no", "template_group_id", "template_sequence_clean")))  # a template has many windows
    lengths = cut(targets.select(F.length("target").alias("k")).distinct())
    queries = orientations(targets)
    exact = cut(exact_hits(queries, templates, lengths, shared))
    return exact.unionByName(iupac_hits(queries, templates, lengths, exact, most, shared))


def map_pairs(pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """pairs with the ten mapping fields; targets without a hit are unmapped, with counts of 0 and empty sets."""
    if given := [c for c in FIELDS if c in pairs.columns]:
        if len(given) < len(FIELDS):
            raise ValueError(f"either all mapping fields are supplied or none: {given}")
        return pairs
    rolled = rollup_hits(all_hits(targets_of(pairs), templates))
    out = pairs.withColumn("__target", ungap(normalize_sequence("target_aligned_25"))).join(rolled.withColumnRenamed("target", "__target"), "__target", "left")
    defaults = {c: F.coalesce(c, F.lit(0).cast("long")) if c.endswith("_count") else F.coalesce(c, F.lit({"mapping_status": "unmapped_exact_or_iupac", "mapping_confidence": "review"}.get(c, ""))) for c in FIELDS}
    return out.select(*pairs.columns, *[defaults[c].alias(c) for c in FIELDS])
