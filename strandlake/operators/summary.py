"""Summaries of sequences and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_summary(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row: count, total, least, greatest, mean and inclusive quartiles of lengths; zeros for no rows."""
    n = F.length(sequence).cast("bigint")
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    made = rows.agg(F.count(F.lit(1)).alias("sequences"), F.sum(n).alias("total_residues"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"), q)
    zero = lambda c, k: F.coalesce(c, F.lit(0)).cast(k)
    return made.select(
        "sequences", *[zero(F.col(c), "bigint").alias(c) for c in ("total_residues", "min_length", "max_length")], zero(F.col("mean_length"), "double").alias("mean_length"),
        *[zero(F.col("q")[k], "double").alias(c) for k, c in enumerate(("length_q1", "length_median", "length_q3"))],
    )


def residue_counts(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Counts of residues: each row's counts are columns of lengths, so only 26 sums and what is left are shuffled."""
    letters = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    sums = rows.agg(*[F.sum(F.length(sequence) - F.length(F.replace(sequence, F.lit(c), F.lit("")))).alias(c) for c in letters])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("residue"), F.col(c).alias("n")) for c in letters])).alias("r")).select("r.*").where("n > 0")


def diagnostic_counts(rows: DataFrame) -> DataFrame:
    """Counts by what was found: (measure, value, n) of namespaces, labels, label combinations, changes and illegal residues."""
    measures = F.array_compact(
        F.array(
            F.struct(F.lit("namespace").alias("measure"), F.col("namespace").alias("value")),
            F.struct(F.lit("combination").alias("measure"), F.array_join("classifications", "+").alias("value")),
            F.when(F.col("upper_cased"), F.struct(F.lit("change").alias("measure"), F.lit("upper_cased").alias("value"))),
            F.when(F.col("terminal_stop_stripped"), F.struct(F.lit("change").alias("measure"), F.lit("terminal_stop_stripped").alias("value"))),
        )
    )
    labels = F.transform("classifications", lambda c: F.struct(F.lit("label").alias("measure"), c.alias("value")))
    illegal = F.transform(F.array_remove(F.split("illegal_residues", ""), ""), lambda c: F.struct(F.lit("illegal").alias("measure"), c.alias("value")))
    return rows.select(F.explode(F.concat(measures, labels, illegal)).alias("m")).groupBy("m.measure", "m.value").agg(F.count(F.lit(1)).alias("n"))
