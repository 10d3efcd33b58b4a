"""Identifier classification: decorations peeled to a fixed point, namespaces, kinds and contaminant blocks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CLASSIFIERS, NAMESPACES, Classifier, Namespace, java

#: Passes over the peeling rules; an identifier that still changes after them raises.
PASSES = 8
AUTHORITY_LENGTH = 12
UNLABELLED, UNMATCHED = "unlabelled", "unmatched"


def _keeping(pattern: str) -> tuple[str, str]:
    """The pattern for Java, and its replacement: the group `keep`, if it has one, survives."""
    return java(pattern), "${keep}" if "(?P<keep>" in pattern else ""


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda's variable is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unnamed(pattern: str) -> str:
    return f"(?:{java(pattern.replace('(?P<keep>', '(?:'))})"


def peel(identifier: Column, classifiers: tuple[Classifier, ...] = CLASSIFIERS, passes: int = PASSES) -> Column:
    """A struct of the bare identifier and the labels of what was taken off, in authored order until nothing changes.

    One test of all decorations together lets identifiers without any pass untouched, and ends every later pass.
    """
    rules = [(k, *_keeping(p)) for k, c in enumerate(classifiers) for p in (*c.prefixes, *c.suffixes)]
    if not rules:
        return F.struct(identifier.alias("bare"), F.array().cast("array<string>").alias("labels"))
    decorated = "|".join(_unnamed(p) for c in classifiers for p in (*c.prefixes, *c.suffixes))

    def state(bare: Column, flags: list[Column]) -> Column:
        return F.struct(bare.alias("bare"), *[f.alias(f"f{k}") for k, f in enumerate(flags)])

    def taking(k: int, pattern: str, kept: str):
        def taken(of: Column) -> Column:
            flags = [of[f"f{j}"] for j in range(len(classifiers))]
            flags[k] = flags[k] | of["bare"].rlike(pattern)
            return state(F.regexp_replace(of["bare"], pattern, kept), flags)

        return taken

    def once(of: Column, _: Column) -> Column:
        full = of
        for rule in rules:
            full = _bound(full, taking(*rule))
        return F.when(of["bare"].rlike(decorated), full).otherwise(of)

    start = state(identifier, [F.lit(False)] * len(classifiers))

    def settled(done: Column) -> Column:
        stuck = F.when(done["bare"].rlike(decorated), F.raise_error(F.lit(f"identifier has more than {passes} layers of decorations")).cast("string")).otherwise(done["bare"])
        return F.struct(stuck.alias("bare"), F.array_compact(F.array(*[F.when(done[f"f{k}"], F.lit(c.name)) for k, c in enumerate(classifiers)])).alias("labels"))

    none = F.struct(identifier.alias("bare"), F.array().cast("array<string>").alias("labels"))
    return F.when(identifier.rlike(decorated), _bound(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, once), settled)).otherwise(none)


def labels(peeled: Column, classifiers: tuple[Classifier, ...] = CLASSIFIERS) -> Column:
    """Sorted labels: of decorations, and of patterns that match the bare identifier."""
    matched = [F.when(F.lit(False) if not c.matches else peeled["bare"].rlike("|".join(f"(?:{java(p)})" for p in c.matches)), F.lit(c.name)) for c in classifiers]
    return F.array_sort(F.array_distinct(F.concat(peeled["labels"], F.array_compact(F.array(*matched)))))


def namespace(bare: Column, namespaces: tuple[Namespace, ...] = NAMESPACES) -> Column:
    """The first namespace that fits, else a short alphanumeric authority before the first pipe, else unmatched."""
    out = None
    for rule in namespaces:
        out = F.when(bare.rlike(java(rule.pattern)), rule.name) if out is None else out.when(bare.rlike(java(rule.pattern)), rule.name)
    authority = F.regexp_extract(bare, r"(?U)^([^|\W_]{1,%d})\|" % AUTHORITY_LENGTH, 1)
    rest = F.when(authority != "", F.concat(authority, F.lit("|"))).otherwise(F.lit(UNMATCHED))
    return rest if out is None else out.otherwise(rest)


def kind(label: Column) -> Column:
    """Sentinel, decoy, entrapment, contaminant, target: the first whose label is there."""
    out = None
    for name in ("sentinel", "decoy", "entrapment", "contaminant"):
        held = F.array_contains(label, name)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("target")


def contaminant_group(group: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(group), F.lit("")), F.lit(UNLABELLED))


def marker_group(raw_header: Column, decoy_prefix: str = "REV_") -> Column:
    """The group that a sentinel header opens a contaminant block for; null for other sentinels."""
    core = F.when(raw_header.startswith(decoy_prefix), F.substr(raw_header, F.lit(len(decoy_prefix) + 1))).otherwise(raw_header)
    field = F.get(F.split(core, r"\|", 3), F.lit(1))
    return F.when(field.startswith("Cont_"), contaminant_group(F.substr(field, F.lit(6))))


#: Ordinals of a database that are ordered together.
CHUNK = 1 << 16


def contaminant_blocks(rows: DataFrame, database: list[str], ordinal: str, configured: str = "kind", marker: str = "marker_group") -> DataFrame:
    """Resolve kinds in file order: a marker opens a contaminant block, any other sentinel closes it.

    Adds resolved_kind and contaminant_group. Decoys and entrapment neither join nor use up a block; a
    block that got no entries makes the next marker's group unlabelled. A database is ordered by chunks of
    CHUNK ordinals, so no task holds all of it: sentinels before a chunk are sums over chunks, and a segment's
    facts one row each, of which only those of markers are joined with entries.
    """
    sentinel, ordinary = F.col(configured) == "sentinel", F.col(configured).isin("target", "contaminant")
    same = lambda *on: reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*database, *on)])
    names = rows.columns
    rows = rows.withColumn("__chunk", F.floor(F.col(ordinal) / CHUNK))
    chunks = rows.groupBy(*database, "__chunk").agg(F.count_if(sentinel).alias("__n"))
    before = chunks.select(*database, "__chunk", (F.sum("__n").over(Window.partitionBy(*database).orderBy("__chunk")) - F.col("__n")).alias("__before"))
    # A row for each CHUNK ordinals.
    rows = rows.alias("l").join(F.broadcast(before).alias("r"), same("__chunk")).select("l.*", "__before")
    upto = Window.partitionBy(*database, "__chunk").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__segment", F.col("__before") + F.count_if(sentinel).over(upto))
    segments = rows.groupBy(*database, "__segment").agg(F.max(F.when(sentinel, F.col(marker))).alias("__opened"), F.max(ordinary.cast("int")).alias("__used"))
    # The segment before ends where its successor's sentinel stands.
    stale = segments.where(F.col("__opened").isNotNull() & (F.col("__used") == 0)).select(*database, (F.col("__segment") + 1).alias("__segment"), F.lit(True).alias("__stale"))
    blocks = segments.where(F.col("__opened").isNotNull()).alias("l").join(stale.alias("r"), same("__segment"), "left")
    blocks = blocks.select("l.*", F.when(F.col("__stale"), F.lit(UNLABELLED)).otherwise(F.col("__opened")).alias("__group"))
    rows = rows.alias("l").join(blocks.alias("r"), same("__segment"), "left").select(*[f"l.{c}" for c in names], "__group")
    resolved = F.when(ordinary & F.col("__group").isNotNull(), "contaminant").otherwise(F.col(configured))
    given = F.when(resolved == "contaminant", F.coalesce("__group", F.lit(UNLABELLED)))
    return rows.select("*", resolved.alias("resolved_kind"), given.alias("contaminant_group")).drop("__group")


def capped_namespaces(rows: DataFrame, database: str, ordinal: str, namespace: str, most: int = 32) -> DataFrame:
    """Counts by database and namespace, where only the first `most` namespaces to arrive keep their name."""
    counts = rows.groupBy(database, namespace).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    rank = F.row_number().over(Window.partitionBy(database).orderBy(F.when(F.col(namespace) == UNMATCHED, 1).otherwise(0), "first", namespace))
    kept = F.when(rank <= most, F.col(namespace)).otherwise(F.lit(UNMATCHED))
    return counts.select(database, kept.alias(namespace), "n").groupBy(database, namespace).agg(F.sum("n").alias("n"))


def dominant_namespace(counts: DataFrame, database: str, namespace: str = "namespace", n: str = "n") -> DataFrame:
    """The most frequent namespace; of equal ones a recognised one, then the first by name."""
    best = F.min_by(namespace, F.struct(-F.col(n), F.col(namespace) == UNMATCHED, F.col(namespace)))
    return counts.groupBy(database).agg(best.alias("dominant_namespace"))
