"""Column functions on headers, residues and peptides; all stay inside whole-stage code or higher-order functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The residue alphabet of diagnostic rules.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYXBZUOJ"
SPACE = r"(?U)\s"


@dataclass(frozen=True)
class Digestion:
    """Cleavage and the peptides that count: `cut` splits a stretch of residues between two matches of zero width."""

    enzyme: str = "trypsin"
    cut: str = "(?<=[KR])(?!P)"
    shortest: int = 7
    longest: int = 50
    missed: int = 0

    def __post_init__(self) -> None:
        if self.shortest < 1 or self.longest < self.shortest:
            raise ValueError("peptide lengths must satisfy 1 <= shortest <= longest")
        if not 0 <= self.missed <= 2:
            raise ValueError("missed cleavages must be 0, 1 or 2")

    @staticmethod
    def from_pattern(enzyme: str, cleavage: str, **lengths: int) -> Digestion:
        """From a cleavage pattern of one residue and an optional lookahead, such as [KR](?!P)."""
        head, _, look = cleavage.partition("(?")
        return Digestion(enzyme, f"(?<={head})" + (f"(?{look}" if look else ""), **lengths)


# --- headers ---------------------------------------------------------------


def header_id(header: Column) -> Column:
    """The first word of a header after one leading '>', '' if there is none."""
    return F.regexp_extract(F.regexp_replace(header, "^>", ""), rf"{SPACE}*(\S*)", 1)


def header_description(header: Column) -> Column:
    """The rest of the header with white space collapsed, null if there is none."""
    words = F.trim(F.regexp_replace(F.regexp_replace(header, "^>", ""), rf"{SPACE}+", " "))
    rest = F.when(F.locate(" ", words) > 0, F.substr(words, F.locate(" ", words) + 1))
    return F.nullif(rest, F.lit(""))


def extract(pattern: str, text: Column, kind: str = "string", values: dict[str, str] | None = None) -> Column:
    """Group 1 of a pattern, null without a match; mapped through `values` (unmapped: null) and cast strictly."""
    found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    if values is not None:
        mapped = F.lit(None).cast("string")
        for name, value in values.items():
            mapped = F.when(found == name, F.lit(value)).otherwise(mapped)
        found = mapped
    return found.cast({"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}[kind])


# --- residues --------------------------------------------------------------


def normalized(sequence: Column) -> Column:
    """Upper case, without exactly one stop at the end."""
    return F.regexp_replace(F.upper(sequence), r"\*\z", "")


def upper_cased(sequence: Column) -> Column:
    return sequence != F.upper(sequence)


def stop_stripped(sequence: Column) -> Column:
    return sequence.endswith("*")


def illegal_residues(sequence: Column, alphabet: str = ALPHABET) -> Column:
    """Residues outside the alphabet, in order and with repeats."""
    return F.translate(sequence, alphabet, "")


def illegal_message(illegal: Column) -> Column:
    """Distinct illegal residues in order, null if there are none."""
    shown = F.array_join(F.array_sort(F.array_distinct(F.split(illegal, ""))), " ")
    return F.when(illegal == "", F.lit(None)).when(illegal.rlike(r"^\*+$"), F.lit("internal stop (*)")).otherwise(F.trim(shown))


def residue_length(sequence: Column) -> Column:
    return F.length(F.regexp_replace(sequence, "[^A-Z]", ""))


def reverse_and_switch(sequence: Column, sites: str = "KR") -> Column:
    """Reverse, then move each cleavage residue one place to the left, from left to right and in place."""
    # A run of sites passes the residue before it, which at the start is the run's own first one; time grows with the length only.
    these = "".join(f"\\{s}" if not s.isalnum() else s for s in sites)
    return F.regexp_replace(F.reverse(sequence), f"(^[{these}]|[^{these}])([{these}]+)", "$2$1")


def composition(peptide: Column) -> Column:
    return F.array_join(F.sort_array(F.split(peptide, "")), "")


def leucine_for_isoleucine(sequence: Column) -> Column:
    return F.translate(sequence, "I", "L")


# --- digestion -------------------------------------------------------------


def segments(sequence: Column, digestion: Digestion) -> Column:
    """Arrays of fully cleaved peptides, one array for each run of residues."""
    return F.transform(F.regexp_extract_all(sequence, F.lit("[A-Z]+"), F.lit(0)), lambda run: F.array_remove(F.split(run, digestion.cut), ""))


def digest(sequence: Column, digestion: Digestion) -> Column:
    """Array of (peptide, missed_cleavages) in order, duplicates kept, within the length window."""
    if not digestion.missed:
        whole = F.filter(F.flatten(segments(sequence, digestion)), lambda p: F.length(p).between(digestion.shortest, digestion.longest))
        return F.transform(whole, lambda p: F.struct(p.alias("peptide"), F.lit(0).cast("bigint").alias("missed_cleavages")))

    def from_run(run: Column) -> Column:
        def starting(_: Column, i: Column) -> Column:
            spans = F.sequence(F.lit(0), F.least(F.lit(digestion.missed), F.size(run) - 1 - i))
            return F.transform(spans, lambda m: F.struct(F.array_join(F.slice(run, i + 1, m + 1), "").alias("peptide"), m.cast("bigint").alias("missed_cleavages")))

        return F.flatten(F.transform(run, starting))

    return F.filter(F.flatten(F.transform(segments(sequence, digestion), from_run)), lambda p: F.length(p["peptide"]).between(digestion.shortest, digestion.longest))


# --- ratios ----------------------------------------------------------------


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return ratio(shared, a + b - shared)


def containment(shared: Column, a: Column, b: Column) -> Column:
    return ratio(shared, F.least(a, b))
