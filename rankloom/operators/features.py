"""Features of aligned sequence pairs: 188 column expressions in one projection, no shuffle and no UDF.

An alignment is a string of one letter a position: M match, S substitution, T gap in the target, G gap in the guide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BASES, IUPAC, count_char, longest, normalize_sequence, ungap
from .quality import max_abs_diff

LENGTH, PAM = 25, 4
DINUCLEOTIDES = [a + b for a in BASES for b in BASES]
#: The trinucleotides that are counted.
TRINUCLEOTIDES = ["AAA", "CCC", "GGG", "TTT", "GCG", "CGC", "TAT", "ATA"]
PAIR_LETTERS = BASES + "-N"
_OTHER = f"[^{BASES}N-]"


def alignment(guide: Column, target: Column) -> Column:
    def event(i: Column) -> Column:
        g, t = F.substr(guide, i, F.lit(1)), F.substr(target, i, F.lit(1))
        return F.when(g == t, "M").when(g == "-", "G").when(t == "-", "T").otherwise("S")

    by_letter = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(LENGTH)), lambda i: event(i)), "")
    return F.when(guide == target, "M" * LENGTH).when(guide.isNull() | target.isNull(), "S" * LENGTH).otherwise(by_letter)  # letters are looked at only where texts differ


def position_flags() -> dict[str, Column]:
    at = [F.substr("events", F.lit(i), F.lit(1)) for i in range(1, LENGTH + 1)]
    return {f"{name}_pos_{i:02d}": test(x).cast("int") for name, test in (("difference", lambda x: x != "M"), ("substitution", lambda x: x == "S"), ("target_gap", lambda x: x == "T")) for i, x in enumerate(at, 1)}


def _pieces(sequence: Column, k: int) -> Column:
    """All overlapping runs of k letters, each before a bar: so a run is counted by what replacing it, bar included, takes away."""
    return F.regexp_replace(sequence, f"(.)(?=({'.' * (k - 1)}))", "$1$2|")


def _times(pieces: str, run: str) -> Column:
    return ((F.length(pieces) - F.length(F.replace(F.col(pieces), F.lit(f"{run}|"), F.lit("")))) / (len(run) + 1)).cast("int")


def substitution_counts() -> dict[str, Column]:
    return {f"sub_{a}_to_{b}_count": _times("pairs", a + b) for a in BASES for b in BASES if a != b}


def alignment_summary() -> dict[str, Column]:
    e = F.col("events")
    marks = F.translate(e, "STG", "DDD")
    return {
        "aligned_difference_count": count_char(e, "STG"), "substitution_count": count_char(e, "S"), "gap_count_target": count_char(e, "T"), "gap_count_guide": count_char(e, "G"),
        "pam_difference_count": count_char(F.substr(e, F.lit(1), F.lit(PAM)), "STG"), "spacer_difference_count": count_char(F.substr(e, F.lit(PAM + 1)), "STG"),
        "first_difference_position_1based": F.nullif(F.instr(marks, "D"), F.lit(0)), "last_difference_position_1based": F.when(F.instr(marks, "D") > 0, LENGTH + 1 - F.instr(F.reverse(marks), "D")),
        "longest_match_run": longest(F.regexp_extract_all(e, F.lit("M+"), F.lit(0))), "longest_substitution_run": longest(F.regexp_extract_all(e, F.lit("S+"), F.lit(0))), "longest_target_gap_run": longest(F.regexp_extract_all(e, F.lit("T+"), F.lit(0))),
    }


def composition(prefix: str, sequence: Column) -> dict[str, Column]:
    """Of the plain bases of a sequence; null fractions where there are none."""
    n = F.nullif(count_char(sequence, BASES), F.lit(0)).cast("double")
    share = {b: count_char(sequence, b) / n for b in BASES}
    entropy = sum((-(F.when(share[b] > 0, share[b] * F.log2(share[b])).otherwise(F.when(n.isNotNull(), 0.0))) for b in BASES), F.lit(0.0))
    runs = longest(F.regexp_extract_all(F.translate(sequence, "N-", ""), F.lit("A+|C+|G+|T+"), F.lit(0)))
    out = {f"{prefix}_length_acgt": count_char(sequence, BASES), f"{prefix}_gc_content": F.round(count_char(sequence, "GC") / n, 6), f"{prefix}_shannon_entropy": F.round(entropy, 6), f"{prefix}_longest_homopolymer": runs}
    return out | {f"{prefix}_{b.lower()}_fraction": F.round(share[b], 6) for b in BASES}


def context(prefix: str, sequence: Column) -> dict[str, Column]:
    """Bases near the ends and in the halves, and overlapping k-mers; null halves where a sequence has one base."""
    n = F.length(sequence)
    half = F.greatest(F.lit(1), F.floor(n / 2)).cast("int")

    def gc(part: Column) -> Column:
        return count_char(part, "GC") / F.nullif(F.length(part), F.lit(0)).cast("double")

    out = {
        f"{prefix}_context_unique_base_count": F.size(F.array_distinct(F.split(sequence, ""))), f"{prefix}_context_gc_first_half": gc(F.substr(sequence, F.lit(1), half)), f"{prefix}_context_gc_second_half": gc(F.substr(sequence, half + 1)),
        f"{prefix}_context_gc_first_5nt": gc(F.substr(sequence, F.lit(1), F.lit(5))), f"{prefix}_context_gc_last_5nt": gc(F.right(sequence, F.lit(5))),
    }
    for name, kmers in (("dinuc", DINUCLEOTIDES), ("trinuc", TRINUCLEOTIDES)):
        for k in kmers:
            places = n - len(k) + 1
            out[f"{prefix}_context_{name}_{k}_frequency"] = F.when(places > 0, _times(f"{prefix}_{name}", k) / places.cast("double")).otherwise(0.0)
    return out


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs with guide, target, ungapped target and alignment."""
    g, t = normalize_sequence("crRNA_sequence"), normalize_sequence("target_aligned_25")
    return pairs.withColumns({"guide": g, "target": t}).withColumns({"target_ungapped": ungap("target"), "events": alignment(F.col("guide"), F.col("target"))})


def in_pieces(made: DataFrame) -> DataFrame:
    """An aligned frame with its letter pairs and runs of two and three letters spelt out, once for all counts."""
    pairs = F.array_join(F.zip_with(F.split("guide", ""), F.split("target", ""), lambda g, t: F.concat(g, t, F.lit("|"))), "")
    runs = {f"{p}_{name}": _pieces(F.col(c), k) for p, c in (("guide", "guide"), ("target", "target_ungapped")) for name, k in (("dinuc", 2), ("trinuc", 3))}
    return made.withColumns({"pairs": pairs} | runs)


def features() -> dict[str, Column]:
    """All 188 features, by name, of an aligned frame."""
    spacer = F.substr("guide", F.lit(PAM + 1))
    out = position_flags() | substitution_counts() | alignment_summary()
    out |= composition("guide", F.col("guide")) | composition("target_ungapped", F.col("target_ungapped")) | composition("guide_spacer", spacer) | composition("target_spacer_ungapped", ungap(F.substr("target", F.lit(PAM + 1))))
    return out | context("guide", F.col("guide")) | context("target", F.col("target_ungapped"))


def feature_table(pairs: DataFrame, manifest: list[str] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """record_id, what `keep` makes of the aligned frame, and the features of a manifest in its order (all without one); names that it lacks are an error."""
    made = features()
    if missing := sorted(set(manifest or ()) - set(made)):
        raise ValueError(f"features that can't be built: {missing}")
    return in_pieces(aligned(pairs)).select("record_id", *[c.alias(n) for n, c in (keep or {}).items()], *[made[n].alias(n) for n in manifest or made])


def events_long(pairs: DataFrame) -> DataFrame:
    """One row for each position of each pair."""
    return aligned(pairs).select("record_id", F.posexplode(F.split("events", "")).alias("at", "event")).select("record_id", (F.col("at") + 1).alias("position"), "event")


def _letter(s: str, i: Column) -> Column:
    return F.regexp_replace(F.substr(F.rpad(s, LENGTH, "N"), i, F.lit(1)), _OTHER, "N")


def pair_array() -> Column:
    """The pairs of letters of an aligned frame, as one array; padded and named like those of pair_onehot."""
    return F.transform(F.sequence(F.lit(1), F.lit(LENGTH)), lambda i: F.concat(_letter("guide", i), _letter("target", i)))


def pair_onehot(pairs: DataFrame) -> DataFrame:
    """The active flag of each position, as (record_id, position, pair, vector index); short sequences are padded with N, other letters are N."""
    long = aligned(pairs).select("record_id", "guide", "target", F.explode(F.sequence(F.lit(1), F.lit(LENGTH))).alias("position"))
    long = long.select("record_id", "position", F.concat(_letter("guide", F.col("position")), _letter("target", F.col("position"))).alias("pair"))
    n = len(PAIR_LETTERS)
    index = (F.col("position") - 1) * n * n + (F.instr(F.lit(PAIR_LETTERS), F.substr("pair", F.lit(1), F.lit(1))) - 1) * n + F.instr(F.lit(PAIR_LETTERS), F.substr("pair", F.lit(2), F.lit(1))) - 1
    return long.select("record_id", "position", "pair", index.alias("vector_index"))


def iupac_tensor(contexts: DataFrame, offset: int = 10, length: int = 45) -> DataFrame:
    """Contexts of another length, and letters that are neither codes nor gaps, are an error. Sparse (record_id, position, channel, value): base weights of a 45-letter context in channels 0-4 and of the guide, from `offset` on, in channels 5-9; an ambiguity code's bases share its weight, a gap is a channel of its own."""
    letters = {**IUPAC, "-": "-"}
    weights = F.create_map(*[x for code, bases in letters.items() for x in (F.lit(code), F.array(*[F.struct(F.lit("ACGT-".index(b)).alias("channel"), F.lit(1.0 / len(bases)).alias("value")) for b in bases]))])
    weights_type = "array<struct<channel:int,value:double>>"
    parts = []
    for text, shift, first in (("target_context_45", 0, 0), ("guide", offset, 5)):
        whole = F.col(text) if shift else F.when(F.length(text) == length, F.col(text)).otherwise(F.raise_error(F.lit(f"{text} must have {length} letters")).cast("string"))
        long = contexts.select("record_id", F.posexplode(F.split(whole, "")).alias("at", "letter"))
        known = F.coalesce(F.try_element_at(weights, F.col("letter")), F.raise_error(F.concat(F.lit("unsupported symbol: "), F.col("letter"))).cast(weights_type))
        long = long.select("record_id", (F.col("at") + shift).alias("position"), F.explode(known).alias("w"))
        parts.append(long.select("record_id", "position", (F.col("w.channel") + first).alias("channel"), "w.value"))
    return parts[0].unionByName(parts[1])


def context_profile(contexts: DataFrame, text: str = "target_context_45") -> DataFrame:
    """How often each symbol stands at each position."""
    return contexts.select(F.posexplode(F.split(text, "")).alias("at", "symbol")).groupBy((F.col("at") + 1).alias("position"), "symbol").agg(F.count("*").alias("n"))


def feature_parity(rebuilt: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """For every feature of two tables of record_id and features: rows that only one has a value for, the largest difference, and whether it is within tolerance."""
    return max_abs_diff(rebuilt, stored, ["record_id"], [c for c in rebuilt.columns if c != "record_id"], tolerance)


def context_matrix(blocks: list[tuple[str, DataFrame]]) -> DataFrame:
    """An ordered design matrix in sparse form: (record_id, column, value) of blocks in order, columns numbered from 0 within a table of columns.

    A block is (name, long table of record_id, feature, value); what a block lacks for a record is 0. Columns are numbered by block, then by name, as the fit rows have them.
    """
    long = None
    for i, (name, part) in enumerate(blocks):
        part = part.select("record_id", F.lit(i).alias("block"), F.concat(F.lit(f"{name}:"), "feature").alias("feature"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    return long


def matrix_columns(long: DataFrame) -> DataFrame:
    """(feature, column) of a fit matrix: as many rows as it has columns, numbered in order."""
    return long.select("block", "feature").distinct().select("feature", (F.row_number().over(Window.orderBy("block", "feature")) - 1).alias("column"))


def numbered_matrix(long: DataFrame, columns: DataFrame) -> DataFrame:
    """A matrix with numbered columns; features that the fit rows lack have none."""
    return long.join(F.broadcast(columns), "feature").where("value <> 0").select("record_id", "column", "value")
