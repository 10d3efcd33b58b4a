"""Peptide inventories: digestion, per-protein maps, comparison of populations and decoy diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import peptide_id
from ..functions.sequences import Digestion, composition, containment, digest, jaccard, ratio, segments
from ..sources.tables import DECOY_REPORT

KINDS = ("target", "contaminant", "entrapment", "decoy")


def digested(proteins: DataFrame, digestion: Digestion, *keep: str) -> DataFrame:
    """One row a peptide occurrence: `keep`, peptide, missed_cleavages; no shuffle."""
    if not digestion.missed:
        whole = proteins.select(*keep, F.explode(F.flatten(segments(F.col("sequence"), digestion))).alias("peptide"), F.lit(0).cast("bigint").alias("missed_cleavages"))
        return whole.where(F.length("peptide").between(digestion.shortest, digestion.longest))
    return proteins.select(*keep, F.explode(digest(F.col("sequence"), digestion)).alias("p")).select(*keep, "p.*")


def protein_peptides(proteins: DataFrame, digestion: Digestion) -> DataFrame:
    """One row for each peptide and protein id: peptide, protein_id, protein_order, protein_kind, missed_cleavages.

    `proteins` has id, final_order, kind, sequence. A peptide keeps its fewest missed cleavages in a protein;
    an id whose peptide comes with different kinds or missed cleavages from different proteins raises.
    """
    rows = digested(proteins, digestion, "id", "final_order", "kind")
    if digestion.missed:
        rows = rows.groupBy("peptide", "id", "final_order", "kind").agg(F.min("missed_cleavages").alias("missed_cleavages"))
    one = rows.groupBy("peptide", "id").agg(
        F.min("final_order").alias("protein_order"),
        F.min("kind").alias("protein_kind"),
        F.max("kind").alias("__kind"),
        F.min("missed_cleavages").alias("missed_cleavages"),
        F.max("missed_cleavages").alias("__missed"),
    )
    clash = (F.col("protein_kind") != F.col("__kind")) | (F.col("missed_cleavages") != F.col("__missed"))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("conflicting mappings of peptide "), "peptide", F.lit(" and protein "), "id"))).otherwise(F.col("protein_kind"))
    return one.select("peptide", F.col("id").alias("protein_id"), "protein_order", checked.alias("protein_kind"), "missed_cleavages")


def inventory(mapped: DataFrame) -> DataFrame:
    """One row a peptide: length, fewest missed cleavages, mappings, and proteins by kind; one shuffle more, with map-side sums."""
    counts = [F.count_if(F.col("protein_kind") == k).alias(f"{k}_count") for k in KINDS]
    rows = mapped.groupBy("peptide").agg(F.min("missed_cleavages").alias("missed_cleavages"), F.count(F.lit(1)).alias("mapping_count"), *counts)
    return rows.select(F.col("peptide").alias("sequence"), F.length("peptide").cast("bigint").alias("length"), "missed_cleavages", "mapping_count", F.col("mapping_count").alias("protein_count"), *[f"{k}_count" for k in KINDS])


def peptides_table(mapped: DataFrame) -> DataFrame:
    """The canonical peptide table, in the order of sequences."""
    return inventory(mapped).orderBy("sequence").select(peptide_id(F.col("sequence")).alias("peptide_id"), "*")


def map_table(mapped: DataFrame) -> DataFrame:
    """The canonical protein-peptide map, in the order of sequences and proteins."""
    rows = mapped.withColumnRenamed("peptide", "peptide_sequence").orderBy("peptide_sequence", "protein_order", "protein_id")
    return rows.select(peptide_id(F.col("peptide_sequence")).alias("peptide_id"), "peptide_sequence", "protein_order", "protein_id", "protein_kind", "missed_cleavages")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Five populations (all and each kind) of two inventories: sizes, shared, jaccard, coverages, containment.

    One full outer join on the sequence and one aggregation for all populations.
    """
    pick = lambda rows, s: rows.select("sequence", *[(F.col(f"{k}_count") > 0).alias(f"{s}_{k}") for k in KINDS], F.lit(True).alias(f"{s}_all"))
    both = pick(a, "a").join(pick(b, "b"), "sequence", "full")
    held = lambda s, k: F.coalesce(F.col(f"{s}_{k}"), F.lit(False))
    populations = ("all", *KINDS)
    sums = []
    for k in populations:
        sums += [F.count_if(held("a", k)).alias(f"a_{k}"), F.count_if(held("b", k)).alias(f"b_{k}"), F.count_if(held("a", k) & held("b", k)).alias(f"s_{k}")]
    rows = both.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(k).alias("population"), F.col(f"a_{k}").alias("distinct_peptides_a"), F.col(f"b_{k}").alias("distinct_peptides_b"), F.col(f"s_{k}").alias("shared_peptides")) for k in populations])).alias("r")).select("r.*")
    a_n, b_n, shared = F.col("distinct_peptides_a"), F.col("distinct_peptides_b"), F.col("shared_peptides")
    return rows.select("*", jaccard(shared, a_n, b_n).alias("jaccard"), ratio(shared, a_n).alias("coverage_a_by_b"), ratio(shared, b_n).alias("coverage_b_by_a"), containment(shared, a_n, b_n).alias("containment"))


def exclusive_deciles(lengths: DataFrame, length: str = "length", n: str = "n", *, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row of p10, p50, p90 of a histogram of lengths, by the exclusive method, and of `sums` over its rows.

    Fewer than ten values give the least, the median and the greatest; none give zeros. The window runs
    over distinct lengths, of which there are as many as the longest peptide allows.
    """
    order = Window.orderBy(length)
    sums = sums or {}
    steps = lengths.groupBy(length).agg(F.sum(n).alias(n), *[F.sum(c).alias(s) for s, c in sums.items()]).withColumn("upto", F.sum(n).over(order)).withColumn("before", F.col("upto") - F.col(n))
    total = F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total")
    held = steps.agg(total, F.sort_array(F.collect_list(F.struct("before", "upto", F.col(length).cast("double").alias("x")))).alias("h"), *[F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias(s) for s in sums])

    def at(k: Column) -> Column:
        return F.get(F.filter("h", lambda s: (s["before"] <= k) & (k < s["upto"])), F.lit(0))["x"]

    def decile(i: int) -> Column:
        m = F.col("total") + 1
        j = F.greatest(F.lit(1), F.least(F.col("total") - 1, F.floor(F.lit(i) * m / 10).cast("bigint")))
        d = F.lit(i) * m - j * 10
        return (at(j - 1) * (10 - d) + at(j) * d) / 10

    few = F.col("total") < 10
    middle = (at(F.floor((F.col("total") - 1) / 2).cast("bigint")) + at(F.floor(F.col("total") / 2).cast("bigint"))) / 2
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return held.select(*sums, zero(F.when(few, at(F.lit(0))).otherwise(decile(1))).alias("length_p10"), zero(F.when(few, middle).otherwise(decile(5))).alias("length_median"), zero(F.when(few, at(F.col("total") - 1)).otherwise(decile(9))).alias("length_p90"))


def population(proteins: DataFrame, digestion: Digestion) -> DataFrame:
    """One row: proteins, peptides, unique_peptides, repeated_peptides and length deciles."""
    rows = digested(proteins.select("sequence"), digestion)
    counts = rows.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"))
    sums = {"peptides": F.col("n"), "unique_peptides": F.lit(1), "repeated_peptides": (F.col("n") > 1).cast("int")}
    found = exclusive_deciles(counts.select(F.length("peptide").alias("length"), "n"), sums=sums)
    return proteins.agg(F.count(F.lit(1)).alias("proteins")).crossJoin(found)  # two tables of one row


def required_normalized(sequence: Column) -> Column:
    """The sequence; one that is not in upper case or has white space raises."""
    bad = (sequence != F.upper(sequence)) | sequence.rlike(r"(?U)\s")
    return F.when(bad, F.raise_error(F.lit("sequence must be normalised before digestion")).cast("string")).otherwise(sequence)


def decoy_report(targets: DataFrame, methods: dict[str, DataFrame], digestion: Digestion) -> DataFrame:
    """The canonical report: the targets as `biological`, then each method's decoys against them.

    A method's frame may have initial_collisions and dropped_peptides of each decoy, which are summed.
    """
    rows = None
    for name, made in {"biological": targets, **methods}.items():
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) if c in made.columns else F.lit(0).cast("bigint").alias(c) for c in ("initial_collisions", "dropped_peptides")]
        held = made.agg(*sums, F.count(F.lit(1)).alias("__made"))
        omitted = targets.agg(F.count(F.lit(1)).alias("__of"))
        one = population(made, digestion).crossJoin(decoy_statistics(made, targets, digestion)).crossJoin(held).crossJoin(omitted)  # tables of one row
        one = one.withColumns({"method": F.lit(name), "unresolved_collisions": F.lit(0) if name == "biological" else F.col("shared_with_targets"), "omitted_decoys": F.col("__of") - F.col("__made")})
        one = one.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECOY_REPORT])
        rows = one if rows is None else rows.union(one)
    return rows


def decoy_statistics(decoys: DataFrame, targets: DataFrame, digestion: Digestion) -> DataFrame:
    """One row: unique_ratio, shared_with_targets and composition_overlap of decoy peptides against target peptides.

    Both sides are read once: peptides with the sides that have them, then compositions with their numbers of peptides.
    """
    side = lambda rows, d: digested(rows.select("sequence"), digestion).select("peptide", F.lit(d).alias("d"))
    both = side(decoys, True).union(side(targets, False)).groupBy("peptide").agg(F.bool_or("d").alias("d"), F.bool_or(~F.col("d")).alias("t"))
    keys = both.groupBy(composition(F.col("peptide")).alias("key")).agg(F.count_if("d").alias("d"), F.count_if("t").alias("t"), F.count_if(F.col("d") & F.col("t")).alias("shared"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    rows = keys.agg(total("d", "d"), total("t", "t"), total("shared", "shared_with_targets"), total(F.when(F.col("t") > 0, F.col("d")), "same"))
    return rows.select(ratio(F.col("d"), F.col("t")).alias("unique_ratio"), "shared_with_targets", ratio(F.col("same"), F.col("d")).alias("composition_overlap"))
