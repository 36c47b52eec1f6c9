"""Column expressions on sequences, keys and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which bases each ambiguity code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Codes and their complements.
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
BASES = "ACGT"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Rounded to 6 places, as every double is that is compared: first to 11, so that summing in another order doesn't break ties, which then go away from 0."""
    return F.round(F.round(col(c).cast("double"), 11) * 1e6) / 1e6


def nearest6(c: str | Column) -> Column:
    """Rounded to 6 places by the double itself, as DuckDB's round does; F.round takes its shortest decimal form, which turns some ties the other way."""
    return F.round(col(c).cast("double") * 1e6) / 1e6


def normalize_sequence(c: str | Column) -> Column:
    return F.translate(F.upper(F.trim(col(c))), "U", "T")


def ungap(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("-"), F.lit(""))


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(col(c), CODES, COMPLEMENTS))


def normalize_key(c: str | Column) -> Column:
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit("missing"))


def coerce_numeric(c: str | Column) -> Column:
    return col(c).try_cast("double")


def difference_class(differences: str | Column) -> Column:
    d = col(differences)
    return F.when(d == 0, "exact").when(d == 1, "one").otherwise("two_plus")


def gap_class(gaps: str | Column) -> Column:
    return F.when(col(gaps) > 0, "gap").otherwise("no_gap")


def template_atoms(c: str | Column) -> Column:
    """Numbers of a `;` list without its blanks, none for a missing one; entries that aren't all digits are an error."""
    parts = F.filter(F.transform(F.split(F.when(F.trim(col(c)) == "missing", "").otherwise(F.coalesce(col(c), F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), x.cast("int")).otherwise(F.raise_error(F.concat(F.lit("invalid template number: "), x)).cast("int")))


def count_char(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, letters, ""))


def longest(runs: Column) -> Column:
    """Length of the longest of an array of strings, 0 without any."""
    return F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0))


def code_bits(c: Column) -> Column:
    """The bases of an ambiguity code as four bits; 0 for other letters."""
    bits = F.lit(0)
    for code, bases in IUPAC.items():
        bits = F.when(c == code, sum(1 << BASES.index(b) for b in bases)).otherwise(bits)
    return bits


def iupac_compatible(a: str | Column, b: str | Column) -> Column:
    """Same length, and codes that share a base at every position."""
    a, b = col(a), col(b)
    return (F.length(a) == F.length(b)) & F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: code_bits(x).bitwiseAND(code_bits(y)) > 0), lambda ok: ok)
