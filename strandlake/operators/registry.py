"""The registry: entries of many databases, distinct counts, shared counts, ranking, neighbours and clusters.

Entries are rows (database_id, ordinal, sequence_id, kind, sequence_hash, description_hash, ...). All
pairs of databases are compared by one self-join for each metric on distinct values, with map-side
sums; the number of pairs is that of databases, never of entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import containment, jaccard, ratio
from ..session import checkpointed
from ..sources.tables import CANDIDATE_COMPARISON
from .blocks import shared_pairs

KINDS = ("target", "contaminant", "decoy", "entrapment", "sentinel")
GROUP = ["database_id", "kind"]


def kind_stats(entries: DataFrame) -> DataFrame:
    """The distinct battery of each database and kind.

    Three levels of sums on (id, hash) pairs take the place of several count-distincts over raw rows:
    a pair first becomes one row, so later shuffles carry distinct values only.
    """
    pairs = entries.groupBy(*GROUP, "sequence_id", "sequence_hash").agg(F.count(F.lit(1)).alias("n"))
    ids = pairs.groupBy(*GROUP, "sequence_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"))
    by_id = ids.groupBy(*GROUP).agg(
        F.sum("n").alias("entries"), F.count(F.lit(1)).alias("distinct_ids"), F.sum("pairs").alias("distinct_pairs"), F.count_if(F.col("pairs") > 1).alias("conflicting_ids"), F.sum(F.col("n") - 1).alias("duplicate_occurrences")
    )
    hashes = pairs.groupBy(*GROUP, "sequence_hash").agg(F.sum("n").alias("n")).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("distinct_sequences"), F.count_if(F.col("n") > 1).alias("repeated_sequences"))
    words = entries.where(F.col("description_hash").isNotNull()).select(*GROUP, "description_hash").distinct().groupBy(*GROUP).agg(F.count(F.lit(1)).alias("distinct_descriptions"))
    rows = by_id.join(hashes, GROUP).join(words, GROUP, "left")
    return rows.select(*GROUP, "entries", "distinct_ids", "distinct_sequences", F.coalesce("distinct_descriptions", F.lit(0)).cast("bigint").alias("distinct_descriptions"), "distinct_pairs", "duplicate_occurrences", "conflicting_ids", "repeated_sequences")


def _pairs_of_sets(sets: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, low, high: every pair of databases of each sorted array d."""
    lows = sets.select(*keep, "d", F.posexplode("d").alias("__at", "low"))
    return lows.select(*keep, "low", F.explode(F.slice("d", F.col("__at") + 2, F.size("d"))).alias("high"))


#: Databases up to which the counts of pairs are summed before they are shuffled: a task has a sum for each pair at most.
FEW = 256


def shared_counts(entries: DataFrame, columns: list[str], name: str, *, few: int = FEW) -> DataFrame:
    """Of each kind and pair of databases (low < high), how many distinct values of `columns` both hold.

    A value's databases are gathered into one array, which holds each database once; values with the same
    databases are counted together before pairs are made of them, so a value that all databases hold, of
    which there may be very many, adds its pairs once. Of more than `few` databases no pairs of single values
    are shuffled: their counts are added up by pairs of blocks of databases.
    """
    rows = entries.dropna(subset=columns).select(*GROUP, *columns).distinct()
    # An id a database; they are numbered in order.
    ids = entries.where(F.col("database_id").isNotNull()).select("database_id").distinct().orderBy("database_id").toArrow().column(0).combine_chunks()
    if len(ids) > few:
        spark = entries.sparkSession
        places = spark.createDataFrame(pa.table({"database_id": ids, "__place": pa.array(range(len(ids)), pa.int32())}))
        rows = rows.join(F.broadcast(places), "database_id").select("kind", *columns, F.col("__place").alias("database_id"))
    held = rows.groupBy("kind", *columns).agg(F.array_sort(F.collect_list("database_id")).alias("d")).where(F.size("d") > 1)
    sets = held.groupBy("kind", "d").agg(F.count(F.lit(1)).alias("n"))
    if len(ids) > few:
        return shared_pairs(sets, ids, name)
    return _pairs_of_sets(sets, "kind", "n").groupBy("kind", "low", "high").agg(F.sum("n").alias(name))


def matching_ids(entries: DataFrame) -> DataFrame:
    """Shared exact (id, hash) pairs, and the distinct ids among them, of each pair of databases."""
    rows = entries.select(*GROUP, "sequence_id", "sequence_hash").distinct()
    held = rows.groupBy("kind", "sequence_id", "sequence_hash").agg(F.array_sort(F.collect_list("database_id")).alias("d")).where(F.size("d") > 1)
    # An id's sets, one for each hash; ids with the same sets are counted together.
    ids = held.groupBy("kind", "sequence_id").agg(F.array_sort(F.collect_list("d")).alias("sets")).groupBy("kind", "sets").agg(F.count(F.lit(1)).alias("n"))
    pairs = _pairs_of_sets(ids.select("kind", "sets", "n", F.explode("sets").alias("d")), "kind", "sets", "n")
    own = pairs.groupBy("kind", "sets", "n", "low", "high").agg(F.count(F.lit(1)).alias("hashes"))
    return own.groupBy("kind", "low", "high").agg(F.sum(F.col("n") * F.col("hashes")).alias("shared_exact_pairs"), F.sum("n").alias("matching_shared_ids"))


_COUNTS = ("shared_ids", "shared_sequences", "shared_descriptions", "shared_exact_pairs", "matching_shared_ids")


def pair_grid(databases: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Every pair of databases (low < high) and kind: the size of the result, not of the entries."""
    # A join on inequality of ids; the smaller side's rows are sent, and each task pairs its part of the other.
    pairs = databases.select(F.col("database_id").alias("low")).join(databases.select(F.col("database_id").alias("high")), F.col("low") < F.col("high"))
    return pairs.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "low", "high")


def pair_stats(entries: DataFrame, kinds: tuple[str, ...] = ("target", "contaminant")) -> DataFrame:
    """Every pair of databases (low < high) and kind with its shared counts, zeros included."""
    wanted = entries.where(F.col("kind").isin(*kinds))
    grid = pair_grid(entries.select("database_id").distinct(), kinds)
    for found in (shared_counts(wanted, ["sequence_id"], "shared_ids"), shared_counts(wanted, ["sequence_hash"], "shared_sequences"), shared_counts(wanted, ["description_hash"], "shared_descriptions"), matching_ids(wanted)):
        grid = grid.join(found, ["kind", "low", "high"], "left")
    return grid.select("kind", "low", "high", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in _COUNTS])


def representatives(entries: DataFrame) -> DataFrame:
    """kind, database_id, representative: the least of the databases whose ids, sequences, descriptions and counts are equal.

    A database's content is two sums of digests over its distinct pairs, and one over its descriptions.
    """
    half = lambda seed, *c: F.sum(F.xxhash64(F.lit(seed), *c).cast("decimal(38,0)"))
    pairs = entries.select(*GROUP, "sequence_id", "sequence_hash").distinct().groupBy(*GROUP).agg(half(1, "sequence_id", "sequence_hash").alias("h1"), half(2, "sequence_id", "sequence_hash").alias("h2"), F.count(F.lit(1)).alias("pairs"))
    words = entries.where(F.col("description_hash").isNotNull()).select(*GROUP, "description_hash").distinct().groupBy(*GROUP).agg(half(3, "description_hash").alias("h3"), F.count(F.lit(1)).alias("descriptions"))
    rows = pairs.join(words, GROUP, "left").na.fill(0)
    same = ["kind", "h1", "h2", "pairs", "h3", "descriptions"]
    return rows.join(rows.groupBy(*same).agg(F.min("database_id").alias("representative")), same).select("kind", "database_id", "representative")


def expanded_pairs(entries: DataFrame, kinds: tuple[str, ...] = ("target", "contaminant")) -> DataFrame:
    """pair_stats by way of representatives: databases of equal content are counted once and their pairs filled in.

    Digests and representatives are written once; every count reads them, not what the digests are made from.
    """
    entries = checkpointed(entries.select(*GROUP, "sequence_id", "sequence_hash", "description_hash"))
    known = checkpointed(representatives(entries.where(F.col("kind").isin(*kinds))))
    one = entries.join(known.where("database_id = representative").select(*GROUP), GROUP, "left_semi")
    counted = checkpointed(pair_stats(one, kinds)).select("kind", F.col("low").alias("rep_low"), F.col("high").alias("rep_high"), *_COUNTS)
    own = checkpointed(kind_stats(one)).select("kind", F.col("database_id").alias("own"), *[F.col(c).alias(f"own_{n}") for c, n in zip(("distinct_ids", "distinct_sequences", "distinct_descriptions", "distinct_pairs", "distinct_ids"), _COUNTS, strict=True)])
    grid = pair_grid(entries.select("database_id").distinct(), kinds)
    for side in ("low", "high"):
        grid = grid.join(known.select("kind", F.col("database_id").alias(side), F.col("representative").alias(f"of_{side}")), ["kind", side], "left")
    grid = grid.withColumns({"rep_low": F.least("of_low", "of_high"), "rep_high": F.greatest("of_low", "of_high"), "own": F.when(F.col("of_low") == F.col("of_high"), F.col("of_low"))})
    # A database without entries of a kind has no representative and shares nothing.
    absent = F.col("of_low").isNull() | F.col("of_high").isNull()
    rows = grid.join(counted, ["kind", "rep_low", "rep_high"], "left").join(own, ["kind", "own"], "left")
    return rows.select("kind", "low", "high", *[F.when(absent, 0).otherwise(F.coalesce(f"own_{n}", n, F.lit(0))).cast("bigint").alias(n) for n in _COUNTS])


def pairs_touching(entries: DataFrame, changed: DataFrame, kinds: tuple[str, ...] = ("target", "contaminant")) -> DataFrame:
    """The rows of pair_stats that have a database of `changed` (database_id): its values are looked up, no others are paired."""
    wanted = entries.where(F.col("kind").isin(*kinds))
    databases = entries.select("database_id").distinct()
    grid = databases.join(changed.select("database_id").distinct().withColumnRenamed("database_id", "new"), F.col("database_id") != F.col("new"))
    grid = grid.select(F.least("database_id", "new").alias("low"), F.greatest("database_id", "new").alias("high")).distinct().select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "low", "high")

    def met(*columns: str) -> DataFrame:
        rows = wanted.dropna(subset=list(columns)).select(*GROUP, *columns).distinct()
        mine = rows.join(changed.select("database_id").distinct(), "database_id", "left_semi").withColumnRenamed("database_id", "new")
        both = mine.join(rows, ["kind", *columns]).where("new <> database_id")
        return both.select("kind", *columns, F.least("database_id", "new").alias("low"), F.greatest("database_id", "new").alias("high")).distinct()

    for column, name in (("sequence_id", "shared_ids"), ("sequence_hash", "shared_sequences"), ("description_hash", "shared_descriptions")):
        grid = grid.join(met(column).groupBy("kind", "low", "high").agg(F.count(F.lit(1)).alias(name)), ["kind", "low", "high"], "left")
    ids = met("sequence_id", "sequence_hash").groupBy("kind", "low", "high", "sequence_id").agg(F.count(F.lit(1)).alias("n"))
    exact = ids.groupBy("kind", "low", "high").agg(F.sum("n").alias("shared_exact_pairs"), F.count(F.lit(1)).alias("matching_shared_ids"))
    grid = grid.join(exact, ["kind", "low", "high"], "left")
    return grid.select("kind", "low", "high", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in _COUNTS])


def refreshed_pairs(pairs: DataFrame, entries: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """pair_stats after the databases of `changed` were indexed again and those of `gone` deleted (both: database_id)."""
    stale = changed.select("database_id").union(gone.select("database_id")).distinct()
    for side in ("low", "high"):
        pairs = pairs.join(stale.withColumnRenamed("database_id", side), side, "left_anti")
    return pairs.select("kind", "low", "high", *_COUNTS).union(pairs_touching(entries, changed))


def similarities(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Ratios, containments and set relations of each pair, from shared counts and both sides' own counts."""
    own = ("entries", "distinct_ids", "distinct_sequences", "distinct_descriptions", "distinct_pairs")
    side = lambda s: stats.select("kind", F.col("database_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in own])
    rows = pairs.join(side("low"), ["kind", "low"], "left").join(side("high"), ["kind", "high"], "left")
    rows = rows.withColumns({f"{c}_{s}": F.coalesce(f"{c}_{s}", F.lit(0)).cast("bigint") for c in own for s in ("low", "high")})
    made = []
    for what, shared, n in (("id", "shared_ids", "distinct_ids"), ("sequence", "shared_sequences", "distinct_sequences"), ("description", "shared_descriptions", "distinct_descriptions")):
        s, a, b = F.col(shared), F.col(f"{n}_low"), F.col(f"{n}_high")
        made += [
            jaccard(s, a, b).alias(f"{what}_jaccard"), ratio(s, a).alias(f"{what}_coverage_low_by_high"), ratio(s, b).alias(f"{what}_coverage_high_by_low"), containment(s, a, b).alias(f"{what}_containment"),
            ((s > 0) & (s == a)).alias(f"{what}_low_in_high"), ((s > 0) & (s == b)).alias(f"{what}_high_in_low"), ((s > 0) & (s == a) & (s == b)).alias(f"exact_{what}_set"),
        ]
    exact = F.col("shared_exact_pairs")
    return rows.select("*", *made, (F.col("shared_ids") - F.col("matching_shared_ids")).alias("changed_shared_ids"), ((exact > 0) & (exact == F.col("distinct_pairs_low")) & (exact == F.col("distinct_pairs_high"))).alias("exact_content"))


def relationship(exact_content: Column, exact_id_set: Column, shared: Column, selected: Column, other: Column, score: Column, threshold: float) -> Column:
    """The name of how a selected set of ids lies to another."""
    return (
        F.when(exact_content, "exact_content")
        .when(exact_id_set, "exact_id_set")
        .when((shared > 0) & (shared == selected) & (selected < other), "subset")
        .when((shared > 0) & (shared == other) & (other < selected), "superset")
        .when((shared > 0) & (score >= threshold), "near_match")
        .when(shared > 0, "partial_overlap")
        .otherwise("no_overlap")
    )


def comparisons(similar: DataFrame, database: int | str | Column, threshold: float = 0.99) -> DataFrame:
    """All other databases as seen from one, with their relationship and rank."""
    chosen = database if isinstance(database, Column) else F.lit(database)
    flipped = F.col("high") == chosen
    rows = similar.where((F.col("low") == chosen) | flipped)
    pick = lambda c: F.when(flipped, F.col(f"{c}_high")).otherwise(F.col(f"{c}_low"))
    other = lambda c: F.when(flipped, F.col(f"{c}_low")).otherwise(F.col(f"{c}_high"))
    rows = rows.select(
        "kind", F.when(flipped, F.col("low")).otherwise(F.col("high")).alias("database_id"), pick("distinct_ids").alias("selected_ids"), other("distinct_ids").alias("other_ids"),
        "shared_ids", "shared_sequences", "shared_descriptions", "id_jaccard", "id_containment", "description_jaccard", "exact_content", "exact_id_set",
        (pick("distinct_ids") - F.col("shared_ids")).alias("selected_only_ids"), (other("distinct_ids") - F.col("shared_ids")).alias("other_only_ids"),
    )
    label = relationship(F.col("exact_content"), F.col("exact_id_set"), F.col("shared_ids"), F.col("selected_ids"), F.col("other_ids"), F.col("id_containment"), threshold)
    return ranked(rows.withColumn("relationship", label), threshold)


def ranked(rows: DataFrame, threshold: float, partition: list[str] | None = None) -> DataFrame:
    """Add rank: by group (exact, near, overlapping, sequences only, none), then by closeness and name."""
    group = (
        F.when(F.col("exact_content"), 0).when(F.col("exact_id_set"), 1).when((F.col("shared_ids") > 0) & (F.col("id_containment") >= threshold), 2)
        .when(F.col("shared_ids") > 0, 3).when(F.col("shared_sequences") > 0, 4).otherwise(5)
    )
    order = Window.partitionBy(*(partition or ["kind"])).orderBy(group, *[F.col(c).desc() for c in ("id_containment", "id_jaccard", "shared_ids", "shared_sequences", "description_jaccard", "shared_descriptions")], F.lower(F.col("database_id").cast("string")), "database_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def neighbours(similar: DataFrame, metric: str = "id_jaccard", limit: int = 50) -> DataFrame:
    """The `limit` nearest other databases of each, by kind: both directions of each pair, best first, ties by name."""
    both = similar.select("kind", F.col("low").alias("database_id"), F.col("high").alias("neighbour"), F.col(metric).alias("score")).union(similar.select("kind", "high", "low", metric))
    order = Window.partitionBy("kind", "database_id").orderBy(F.col("score").desc(), "neighbour")
    return both.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def best_overlap(similar: DataFrame, database, threshold: float) -> DataFrame:
    """The best other database, if its containment reaches the threshold."""
    return comparisons(similar, database, threshold).where(F.col("id_containment") >= threshold).orderBy(F.col("id_containment").desc(), F.col("id_jaccard").desc(), F.col("shared_ids").desc(), F.lower(F.col("database_id").cast("string")), "database_id").limit(1)


def candidate_counts(candidate: DataFrame, entries: DataFrame) -> DataFrame:
    """Shared counts of a staged candidate with each database, by joins on its distinct values.

    `candidate` has sequence_id, kind, sequence_hash, description_hash. Columns database_id, kind, shared_ids,
    shared_sequences, shared_descriptions, shared_exact_pairs, matching_shared_ids.
    """
    out = None
    for columns, name in ((["sequence_id"], "shared_ids"), (["sequence_hash"], "shared_sequences"), (["description_hash"], "shared_descriptions")):
        mine = candidate.select("kind", *columns).dropna().distinct()
        found = entries.select("database_id", "kind", *columns).distinct().join(mine, ["kind", *columns]).groupBy("database_id", "kind").agg(F.count(F.lit(1)).alias(name))
        out = found if out is None else out.join(found, ["database_id", "kind"], "full")
    pair = ["kind", "sequence_id", "sequence_hash"]
    exact = entries.select("database_id", *pair).distinct().join(candidate.select(*pair).distinct(), pair)
    ids = exact.groupBy("database_id", "kind", "sequence_id").agg(F.count(F.lit(1)).alias("n"))
    exact = ids.groupBy("database_id", "kind").agg(F.sum("n").alias("shared_exact_pairs"), F.count(F.lit(1)).alias("matching_shared_ids"))
    return out.join(exact, ["database_id", "kind"], "full").na.fill(0)


def staged_counts(candidate: DataFrame) -> DataFrame:
    """One row a kind of a staged candidate: its distinct ids, sequences, descriptions and exact pairs."""
    stats = kind_stats(candidate.withColumn("database_id", F.lit("0")))
    return stats.select("kind", "entries", "distinct_ids", "distinct_sequences", "distinct_descriptions", "distinct_pairs")


def compare_candidate(candidate: DataFrame, entries: DataFrame, threshold: float = 0.99, kinds: tuple[str, ...] = ("target", "contaminant"), among: DataFrame | None = None) -> DataFrame:
    """Every registered database against a staged candidate, with relationship and rank by kind.

    `among` (database_id) restricts the databases, such as to representatives.
    """
    if among is not None:
        entries = entries.join(among.select("database_id"), "database_id", "left_semi")
    own = ("distinct_ids", "distinct_sequences", "distinct_descriptions", "distinct_pairs")
    mine = staged_counts(candidate).select("kind", *[F.col(c).alias(f"{c}_low") for c in own])
    theirs = kind_stats(entries).select("kind", "database_id", *[F.col(c).alias(f"{c}_high") for c in own])
    grid = entries.select("database_id").distinct().select("database_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    rows = grid.join(theirs, ["database_id", "kind"], "left").join(mine, "kind", "left").join(candidate_counts(candidate, entries), ["database_id", "kind"], "left").na.fill(0)
    shared, a, b, exact = F.col("shared_ids"), F.col("distinct_ids_low"), F.col("distinct_ids_high"), F.col("shared_exact_pairs")
    rows = rows.select(
        "kind", "database_id", a.alias("selected_ids"), b.alias("other_ids"), *_COUNTS, jaccard(shared, a, b).alias("id_jaccard"), containment(shared, a, b).alias("id_containment"),
        jaccard(F.col("shared_descriptions"), F.col("distinct_descriptions_low"), F.col("distinct_descriptions_high")).alias("description_jaccard"),
        ((exact > 0) & (exact == F.col("distinct_pairs_low")) & (exact == F.col("distinct_pairs_high"))).alias("exact_content"), ((shared > 0) & (shared == a) & (shared == b)).alias("exact_id_set"),
        (a - shared).alias("selected_only_ids"), (b - shared).alias("other_only_ids"),
    )
    label = relationship(F.col("exact_content"), F.col("exact_id_set"), shared, F.col("selected_ids"), F.col("other_ids"), F.col("id_containment"), threshold)
    return ranked(rows.withColumn("relationship", label), threshold)


def comparison_frame(compared: DataFrame) -> DataFrame:
    """Comparisons in their canonical order: targets, then contaminants, each by rank."""
    return compared.orderBy(F.when(F.col("kind") == "target", 0).otherwise(1), "kind", "rank")


def candidate_neighbours(compared: DataFrame, limit: int = 50, metric: str = "id_jaccard", kind: str = "target") -> DataFrame:
    """The databases nearest to a candidate: best first, ties by name."""
    rows = compared.where(F.col("kind") == kind).select("database_id", F.col(metric).alias("score"))
    return rows.orderBy(F.col("score").desc(), F.col("database_id").cast("string")).limit(limit)


def best_of_candidate(compared: DataFrame, threshold: float = 0.0, kind: str = "target") -> DataFrame:
    """The registered database that a candidate overlaps most, if its containment reaches the threshold."""
    rows = compared.where((F.col("kind") == kind) & (F.col("id_containment") >= threshold) & (F.col("shared_ids") > 0))
    return rows.orderBy(F.col("id_containment").desc(), F.col("id_jaccard").desc(), F.col("shared_ids").desc(), F.lower(F.col("database_id").cast("string")), "database_id").limit(1)


def candidate_table(compared: DataFrame) -> DataFrame:
    """Comparisons as the canonical table of candidates, in its order."""
    rows = comparison_frame(compared).withColumns({"filename": F.regexp_extract(F.col("database_id").cast("string"), "([^/]*)$", 1), "changed_shared_ids": F.col("shared_ids") - F.col("matching_shared_ids")})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDIDATE_COMPARISON])


def combined_candidate(entries: DataFrame) -> DataFrame:
    """All staged files of a candidate as one database 0, its entries numbered through the files in order."""
    rows = combined_ordinals(entries)
    return rows.withColumns({"ordinal": F.col("combined_ordinal").cast("bigint"), "database_id": F.lit("0")}).drop("combined_ordinal")


def database_records(entries: DataFrame, most: int = 200_000) -> DataFrame:
    """One row a database: entries by kind, target statistics, dominant namespace, detail level and whether it has decoys."""
    stats = kind_stats(entries)
    by_kind = stats.groupBy("database_id").agg(
        F.sum("entries").alias("entries"), *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("entries"))), F.lit(0)).alias(f"{k}_entries") for k in KINDS],
        *[F.coalesce(F.max(F.when(F.col("kind") == "target", F.col(c))), F.lit(0)).alias(f"target_{c}") for c in ("distinct_ids", "distinct_sequences", "distinct_descriptions")],
    )
    rows = by_kind.select("*", (F.col("decoy_entries") > 0).alias("is_decoy"), F.when(F.col("entries") <= most, "full").otherwise("metadata_only").alias("detail_level"))
    if "namespace" not in entries.columns:
        return rows
    from .classify import dominant_namespace

    return rows.join(dominant_namespace(entries.groupBy("database_id", "namespace").agg(F.count(F.lit(1)).alias("n")), "database_id"), "database_id", "left")


def listed(records: DataFrame, name: str = "database_id") -> DataFrame:
    """Databases by name, whatever its case, then by id."""
    return records.orderBy(F.lower(F.col(name).cast("string")), "database_id")


def kind_grid(stats: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The statistics of every kind of each database, zeros for kinds it has no entries of."""
    grid = stats.select("database_id").distinct().select("database_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return grid.join(stats, ["database_id", "kind"], "left").na.fill(0)


def complete_kinds(stats: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Statistics by database as one array each; a database that lacks a kind raises."""
    rows = stats.groupBy("database_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in stats.columns if c != "database_id"]))).alias("stats"))
    whole = F.when(F.size("stats") != len(kinds), F.raise_error(F.concat(F.lit("incomplete statistics of "), F.col("database_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(whole)


def scan_facts(entries: DataFrame) -> DataFrame:
    """What a scan learns of each database beside its entries: residues, the first sentinel's ordinal, and its contaminant groups in order of arrival."""
    markers = entries.where(F.col("contaminant_group").isNotNull()).groupBy("database_id", "contaminant_group").agg(F.min("ordinal").alias("at"))
    ordered = markers.groupBy("database_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "contaminant_group"))), lambda m: m["contaminant_group"]).alias("contaminant_groups"))
    sums = entries.groupBy("database_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("sequence_length").alias("residues"), F.min(F.when(F.col("kind") == "sentinel", F.col("ordinal"))).alias("first_sentinel"))
    return sums.join(ordered, "database_id", "left")


def sampled(entries: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` entries of each database, chosen by a seeded hash, so the sample does not depend on the order of the scan."""
    turn = Window.partitionBy("database_id").orderBy(F.xxhash64(F.lit(seed), F.col("database_id").cast("string"), F.col("ordinal").cast("bigint")), "ordinal")
    return entries.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= most).drop("__turn")


def content_groups(entries: DataFrame) -> DataFrame:
    """Databases of equal content (the set of id and hash pairs) by kind: representative and members.

    A database's content is the sum of its pairs' 128-bit digests in two halves, which needs no ordered
    gathering: order does not count and map-side sums apply.
    """
    pairs = entries.select(*GROUP, "sequence_id", "sequence_hash").distinct()
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), "sequence_id", "sequence_hash").cast("decimal(38,0)"))
    prints = pairs.groupBy(*GROUP).agg(half(1).alias("h1"), half(2).alias("h2"), F.count(F.lit(1)).alias("pairs"))
    return prints.groupBy("kind", "h1", "h2", "pairs").agg(F.min("database_id").alias("representative"), F.count(F.lit(1)).alias("members")).select("kind", "representative", "pairs", "members")


def long_export(similar: DataFrame) -> DataFrame:
    """The long form of pairs, as text, in the order of pairs."""
    return similar.select(*[export_text(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in similar.schema]).orderBy("kind", "low", "high")


def export_text(value: Column, kind: str) -> Column:
    """Numbers with up to 12 significant digits and no trailing zeros, 0.0 and 1.0 as such, booleans in lower case."""
    if kind != "double":
        return value.cast("string")
    digits = F.format_string("%.12g", value)
    trimmed = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, "0.0").when(value == 1, "1.0").otherwise(trimmed)


def jaccard_matrix(similar: DataFrame, kind: str, databases: list, metric: str = "id_jaccard") -> DataFrame:
    """A row and a column for each database, 1 on the diagonal; `databases` names the columns."""
    one = similar.where(F.col("kind") == kind)
    diagonal = one.sparkSession.createDataFrame([(d, d, 1.0) for d in databases], f"row {one.schema['low'].dataType.simpleString()}, col {one.schema['low'].dataType.simpleString()}, value double")
    cells = one.select(F.col("low").alias("row"), F.col("high").alias("col"), F.col(metric).alias("value")).union(one.select("high", "low", metric)).union(diagonal)
    return cells.groupBy("row").pivot("col", databases).agg(F.first("value")).orderBy("row")


def distances(similar: DataFrame, kind: str, metric: str, size: str) -> tuple[list, np.ndarray, list]:
    """(names, matrix of 1 - similarity, names left out since their sets are empty), for one kind of entries.

    The distances of databases (not of entries) come to the driver: n * (n - 1) / 2 numbers, of which a
    neighbourhood of 50 databases is the usual size. A missing, repeated or impossible similarity raises.
    """
    rows = similar.where(F.col("kind") == kind).select("low", "high", metric, f"{size}_low", f"{size}_high").toArrow()
    low, high, values, low_size, high_size = (c.to_pylist() for c in rows.columns)
    sizes = dict(zip(low, low_size, strict=True)) | dict(zip(high, high_size, strict=True))
    names = sorted((d for d, n in sizes.items() if n), key=str)
    place = {d: k for k, d in enumerate(names)}
    apart = np.full((len(names), len(names)), np.nan)
    for a, b, value in zip(low, high, values, strict=True):
        if a in place and b in place:
            i, j = sorted((place[a], place[b]))
            if not 0 <= value <= 1 or not np.isnan(apart[i, j]):
                raise ValueError(f"{metric} of {a} and {b} is repeated or not between 0 and 1")
            apart[i, j] = 1.0 - value
    if np.isnan(apart[np.triu_indices(len(names), 1)]).any():
        raise ValueError("similarities of some pairs of databases are missing")
    return names, apart, sorted((d for d, n in sizes.items() if not n), key=str)


def average_linkage(similar: DataFrame, kind: str = "target", metric: str = "id_jaccard", size: str = "distinct_ids") -> DataFrame:
    """Merges of average linkage over 1 - similarity: step, cluster_id, left_id, right_id, distance, leaf_count.

    Databases with empty sets are left out. Ties go to the pair whose members come first by name: a cluster
    keeps the row of its first member, so that is the first least cell of the upper triangle.
    """
    names, apart, _ = distances(similar, kind, metric, size)
    n = len(names)
    apart[np.tril_indices(n)] = np.inf
    ids, leaves, merges = np.arange(n), np.ones(n, np.int64), []
    for step in range(n - 1):
        a, b = divmod(int(apart.argmin()), n)
        merges.append((step, n + step, int(ids[a]), int(ids[b]), float(apart[a, b]), int(leaves[a] + leaves[b])))
        others = np.delete(np.arange(n), (a, b))
        to_a, to_b = (apart[np.minimum(others, k), np.maximum(others, k)] for k in (a, b))
        apart[np.minimum(others, a), np.maximum(others, a)] = (leaves[a] * to_a + leaves[b] * to_b) / (leaves[a] + leaves[b])
        apart[b, :] = apart[:, b] = np.inf
        ids[a], leaves[a] = n + step, leaves[a] + leaves[b]
    return similar.sparkSession.createDataFrame(merges, "step int, cluster_id int, left_id int, right_id int, distance double, leaf_count int")


def leaf_order(similar: DataFrame, kind: str = "target", metric: str = "id_jaccard", size: str = "distinct_ids") -> DataFrame:
    """position and database_id of the leaves as a tree of the merges is drawn; databases left out have no position."""
    names, _, empty = distances(similar, kind, metric, size)
    held = {k: [k] for k in range(len(names))}
    for m in average_linkage(similar, kind, metric, size).orderBy("step").collect():  # one row less than databases
        held[m["cluster_id"]] = held.pop(m["left_id"]) + held.pop(m["right_id"])
    rows = [(k, names[leaf]) for k, leaf in enumerate(next(iter(held.values()), []))] + [(None, d) for d in empty]
    return similar.sparkSession.createDataFrame(rows, f"position int, database_id {similar.schema['low'].dataType.simpleString()}")


def neighbourhood(similar: DataFrame, database, *, metric: str = "id_jaccard", kind: str = "target", limit: int = 50) -> DataFrame:
    """The similarities among a database and its `limit` nearest ones of a kind, for clustering them."""
    near = neighbours(similar.where(F.col("kind") == kind), metric, limit).where(F.col("database_id") == F.lit(database)).select(F.col("neighbour").alias("d"))
    held = F.broadcast(near.union(near.sparkSession.createDataFrame([(database,)], near.schema)))  # limit + 1 rows
    return similar.where(F.col("kind") == kind).join(held.withColumnRenamed("d", "low"), "low", "left_semi").join(held.withColumnRenamed("d", "high"), "high", "left_semi")


def orphans(entries: DataFrame, databases: DataFrame) -> DataFrame:
    """Entries whose database is not registered."""
    return entries.join(databases, "database_id", "left_anti")


def duplicated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def combined_ordinals(entries: DataFrame) -> DataFrame:
    """Number entries from 0 through all databases in order: counts of databases give each its offset, so no task gets all rows."""
    sizes = entries.groupBy("database_id").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("database_id", (F.sum("n").over(Window.orderBy("database_id")) - F.col("n")).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("database_id").orderBy("ordinal")) - 1
    return entries.withColumn("__own", own).join(offsets, "database_id").withColumn("combined_ordinal", F.col("__offset") + F.col("__own")).drop("__own", "__offset")
