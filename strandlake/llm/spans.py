"""Positions of regular-expression matches in whole texts, in DataFrame functions only.

Spark has no function for the places of matches. The pieces between matches (split) and the matches
(regexp_extract_all) are exploded side by side, and a running sum of their lengths over each text gives
the places. Only texts with a match reach the shuffle, as lengths and captured groups, never whole.

A text is known by its id and a hash of itself: repeated rows are worked on once and rows that share
an id but not a text are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key columns of a text.
KEY = ("sp_id", "sp_hash")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns sp_id, sp_hash and sp_text; a null text is empty."""
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[key].alias("sp_id"), F.xxhash64(whole).alias("sp_hash"), whole.alias("sp_text"))


def matches(texts: DataFrame, patterns: dict[str, tuple[str, int]], cheap: dict[str, Column] | None = None) -> DataFrame:
    """One row for each match: KEY, kind, nth, start, end (code points, end exclusive), found (the group's text).

    `patterns` maps a kind to its pattern and the group to return; `cheap` may hold a condition that
    every text with a match meets and that costs less than the pattern.
    """
    cheap = cheap or {}
    steps = []
    for kind, (pattern, group) in patterns.items():
        body = F.col("sp_text")
        step = F.struct(
            F.lit(kind).alias("kind"),
            F.arrays_zip(
                F.transform(F.split(body, pattern, -1), F.length).alias("gap"),
                F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.length).alias("size"),
                F.regexp_extract_all(body, F.lit(pattern), F.lit(group)).alias("found"),
            ).alias("parts"),
        )
        steps.append(F.when(cheap.get(kind, F.lit(True)) & body.rlike(pattern), step))
    events = texts.select(*KEY, F.explode(F.array_compact(F.array(*steps))).alias("e")).select(*KEY, "e.kind", F.posexplode("e.parts").alias("nth", "p"))
    events = events.where("p.size is not null").select(*KEY, "kind", "nth", "p.gap", "p.size", "p.found").dropDuplicates([*KEY, "kind", "nth"])
    so_far = Window.partitionBy(*KEY, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(so_far)
    return events.select(*KEY, "kind", "nth", (end - F.col("size")).alias("start"), end.alias("end"), "found")


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["sp_id"].eqNullSafe(b["sp_id"]) & (a["sp_hash"] == b["sp_hash"])
