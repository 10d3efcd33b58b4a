"""Registry tables on disk: indexing, incremental updates, validation, snapshots and copies.

A registry is a folder of Parquet tables: entries (partitioned by database_id), kind_stats, pair_stats, sources
(the indexed files) and meta. Updates write the changed databases' partitions and pairs only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import description_hash, pair_fingerprint, sequence_hash
from ..functions.rules import NAMESPACES, REGISTRY_CLASSIFIERS, REGISTRY_NAMESPACES
from ..session import checkpointed
from ..sources import files
from .classify import CHUNK, contaminant_blocks, kind, labels, marker_group, namespace, peel
from .registry import database_records, duplicated_keys, kind_stats, listed, orphans, pair_stats, refreshed_pairs

SCHEMA_VERSION = "2"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ENTRIES = _schema(
    ordinal=T.LongType(), sequence_id=T.StringType(), kind=T.StringType(), contaminant_group=T.StringType(), namespace=T.StringType(),
    sequence_length=T.LongType(), sequence_hash=T.BinaryType(), description_hash=T.BinaryType(), database_id=T.StringType(),
)
SOURCES = _schema(path=T.StringType(), bytes=T.LongType(), modified=T.TimestampType())


def entries_of(proteins: DataFrame, database: str = "source_path", *, override: str | None = None) -> DataFrame:
    """Registry entries of proteins (source_path, record_ordinal, raw_header, id, description, sequence)."""
    rows = proteins.withColumn("__peeled", peel(F.col("id"), REGISTRY_CLASSIFIERS))
    rows = rows.withColumns({"kind": kind(labels(F.col("__peeled"), REGISTRY_CLASSIFIERS)), "namespace": namespace(F.col("__peeled.bare"), (*REGISTRY_NAMESPACES, *NAMESPACES)), "marker_group": marker_group(F.col("raw_header"))})
    # Only digests go on, which are written once: blocks are found by several passes over them.
    hashed = [F.length("sequence").cast("bigint").alias("sequence_length"), sequence_hash(F.col("sequence")).alias("sequence_hash"), description_hash(F.col("description")).alias("description_hash")]
    rows = rows.select(F.col(database).alias("database_id"), "record_ordinal", "id", "kind", "namespace", "marker_group", *hashed)
    rows = contaminant_blocks(checkpointed(rows), ["database_id"], "record_ordinal")
    resolved = F.col("resolved_kind")
    if override is not None:
        resolved = F.when(resolved.isin("target", "contaminant"), F.lit(override)).otherwise(resolved)
    return rows.select(
        "database_id", F.col("record_ordinal").alias("ordinal"), F.col("id").alias("sequence_id"), resolved.alias("kind"), "contaminant_group", "namespace", "sequence_length", "sequence_hash", "description_hash"
    )


def entries_of_inventory(rows: DataFrame, database: str) -> DataFrame:
    """Registry entries of an inventory, whose kinds and groups are given; nothing is parsed again."""
    bare = peel(F.col("id"), REGISTRY_CLASSIFIERS)["bare"]
    return rows.select(
        F.lit(database).alias("database_id"), F.col("final_order").alias("ordinal"), F.col("id").alias("sequence_id"), "kind", "contaminant_group", namespace(bare, (*REGISTRY_NAMESPACES, *NAMESPACES)).alias("namespace"),
        F.length("sequence").cast("bigint").alias("sequence_length"), sequence_hash(F.col("sequence")).alias("sequence_hash"), description_hash(F.col("description")).alias("description_hash"),
    )


def index_inventory(rows: DataFrame, root: str, database: str) -> None:
    """Add an inventory to a registry, or replace it there; an empty one raises."""
    if rows.isEmpty():
        raise ValueError(f"{database}: no entries to index")
    spark = rows.sparkSession
    held = open_registry(spark, root)
    write_entries(entries_of_inventory(rows, database), root)
    name = spark.createDataFrame([(database,)], "database_id string")
    now = read_entries(spark, root)
    pairs = refreshed_pairs(held["pair_stats"], now, name, name.limit(0))
    stats = without_databases(held["kind_stats"], name, "database_id").unionByName(kind_stats(now.join(name, "database_id", "left_semi")))
    _write_aside(spark, {"kind_stats": stats, "pair_stats": pairs}, root)


def with_row_checksums(rows: DataFrame) -> DataFrame:
    """Add each row's sequence_hash and id_sequence_fingerprint (of its id and hash), both in hexadecimal digits."""
    hashed = rows.withColumn("sequence_hash", F.lower(F.hex(sequence_hash(F.col("sequence")))))
    return hashed.withColumn("id_sequence_fingerprint", F.lower(F.hex(pair_fingerprint(F.col("id"), F.unhex("sequence_hash")))))


def detail_levels(entries: DataFrame, most: int = 200_000) -> DataFrame:
    """full or metadata_only, by the number of a database's entries."""
    return entries.groupBy("database_id").agg(F.count(F.lit(1)).alias("n")).select("database_id", "n", F.when(F.col("n") <= most, "full").otherwise("metadata_only").alias("detail_level"))


def detailed(entries: DataFrame, most: int = 200_000) -> DataFrame:
    """Entries of databases that keep details."""
    return entries.join(detail_levels(entries, most).where("detail_level = 'full'").select("database_id"), "database_id", "left_semi")


def write_entries(entries: DataFrame, root: str) -> None:
    """Write or replace the partitions of the databases in `entries`, and of no others; a large database is written by many tasks."""
    spark = entries.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        entries.select(*ENTRIES.names).repartition("database_id", F.floor(F.col("ordinal") / CHUNK)).write.mode("overwrite").partitionBy("database_id").parquet(f"{root}/entries")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with their types: a database's id is text, also where its folder looks like a number."""
    return spark.read.schema(ENTRIES).parquet(f"{root}/entries")


def _write_aside(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Replace tables of a registry: all are written aside before the first is moved into place."""
    stamp = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/.{name}-{stamp}")
    for name in tables:
        files.delete(spark, f"{root}/{name}")
        files.move(spark, f"{root}/.{name}-{stamp}", f"{root}/{name}")


def _statistics(held: DataFrame) -> dict[str, DataFrame]:
    return {"kind_stats": kind_stats(held), "pair_stats": pair_stats(held)}


def _meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("schema_version", SCHEMA_VERSION)], "key string, value string")


def _sources(spark: SparkSession, found: DataFrame | None) -> DataFrame:
    return found.select(*[F.col(f.name).cast(f.dataType) for f in SOURCES]) if found is not None else spark.createDataFrame([], SOURCES)


def rebuild(entries: DataFrame, root: str, found: DataFrame | None = None) -> None:
    """Write a whole registry beside an older one, check it, and only then put it in its place.

    `found` has the files that were indexed (path, bytes, modified), which later updates compare with.
    """
    spark = entries.sparkSession
    aside = f"{root.rstrip('/')}.{uuid.uuid4().hex}.part"
    write_entries(entries, aside)
    held = read_entries(spark, aside)
    for name, rows in (_statistics(held) | {"meta": _meta(spark), "sources": _sources(spark, found)}).items():
        rows.write.parquet(f"{aside}/{name}")
    made = open_registry(spark, aside)
    if wrong := problems(made["entries"], made["kind_stats"], made["pair_stats"]).collect():  # a few rows, one a check
        files.delete(spark, aside)
        raise ValueError(f"{root}: not published: {', '.join(r['check'] for r in wrong)}")
    files.delete(spark, root)
    files.move(spark, aside, root)


def refresh(spark: SparkSession, root: str) -> None:
    """Statistics of what entries hold now."""
    _write_aside(spark, _statistics(read_entries(spark, root)) | {"meta": _meta(spark)}, root)
    if not files.exists(spark, f"{root}/sources"):
        _sources(spark, None).write.parquet(f"{root}/sources")


def update(spark: SparkSession, found: DataFrame, root: str, entries_of_files, *, prune: bool = True, force: bool = False) -> dict[str, int]:
    """Index the files of `found` (path, bytes, modified) that are new or changed, and drop those that are gone.

    `entries_of_files` makes entries of a list of paths; a file's path is its database. Only changed databases are
    read and written, and of the pairs only theirs are counted again. Returns how many files were indexed and dropped.
    """
    held = open_registry(spark, root)
    known = held["sources"]
    fresh = found if force else changed_files(found, known)
    paths = [r["path"] for r in fresh.select("path").collect()]  # names of files
    gone = [r["path"] for r in gone_files(found, known).select("path").collect()] if prune else []
    if not paths and not gone:
        return {"indexed": 0, "dropped": 0}
    if paths:
        write_entries(entries_of_files(paths), root)
    for path in gone:
        delete_database(spark, root, path)
    names = lambda ids: spark.createDataFrame([(i,) for i in ids], "database_id string")
    now = read_entries(spark, root)
    pairs = refreshed_pairs(held["pair_stats"], now, names(paths), names(gone))
    stats = without_databases(held["kind_stats"], names([*paths, *gone]), "database_id").unionByName(kind_stats(now.join(names(paths), "database_id", "left_semi")))
    sources = known.join(names([*paths, *gone]).withColumnRenamed("database_id", "path"), "path", "left_anti").unionByName(_sources(spark, fresh))
    _write_aside(spark, {"kind_stats": stats, "pair_stats": pairs, "sources": sources}, root)
    return {"indexed": len(paths), "dropped": len(gone)}


def delete_database(spark: SparkSession, root: str, database: str) -> None:
    """Delete the entries of a database."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(database)
    files.delete(spark, f"{root}/entries/database_id={name}")


def stats_only_copy(spark: SparkSession, root: str, target: str) -> None:
    """A copy of a registry without its entries; an existing target raises."""
    if files.exists(spark, target):
        raise FileExistsError(target)
    held = open_registry(spark, root)
    for name in ("kind_stats", "pair_stats", "meta", "sources"):
        held[name].write.parquet(f"{target}/{name}")


def open_registry(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a registry by name (a copy of statistics has no entries); one of another version raises."""
    tables = {t: spark.read.parquet(f"{root}/{t}") for t in ("kind_stats", "pair_stats", "meta", "sources")}
    version = {r["key"]: r["value"] for r in tables["meta"].collect()}.get("schema_version")
    if version != SCHEMA_VERSION:
        raise ValueError(f"{root}: registry of version {version}, not {SCHEMA_VERSION}: index it anew")
    return tables | ({"entries": read_entries(spark, root)} if files.exists(spark, f"{root}/entries") else {})


def read_registry(spark: SparkSession, root: str) -> DataFrame | None:
    """The databases of a registry in the order of their names; None where there is no registry."""
    return listed(database_records(open_registry(spark, root)["entries"])) if files.exists(spark, root) else None


def target_ids(entries: DataFrame) -> DataFrame:
    """The distinct ids of target entries by database."""
    return entries.where("kind = 'target'").select("database_id", "sequence_id").distinct()


def changed_files(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or differ in size or time: both have path, bytes, modified."""
    return seen.join(known.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti")


def gone_files(seen: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(seen.select("path"), "path", "left_anti")


def without_databases(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows of a registry table none of whose `columns` names a database of `gone` (database_id)."""
    for c in columns:
        table = table.join(gone.select(F.col("database_id").alias(c)), c, "left_anti")
    return table


def upserted(meta: DataFrame, new: DataFrame) -> DataFrame:
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)


def problems(entries: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Integrity findings: check, n; no rows for a sound registry."""
    databases = entries.select("database_id").distinct()
    wrong = stats.join(entries.groupBy("database_id", "kind").agg(F.count(F.lit(1)).alias("__n")), ["database_id", "kind"], "left").where("__n is null or __n <> entries")
    expected = databases.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("n"))
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    found = count(duplicated_keys(entries, "database_id", "ordinal"), "duplicate ordinals")
    found = found.union(count(orphans(stats, databases), "statistics without entries")).union(count(wrong, "statistics that differ"))
    missing = expected.crossJoin(pairs.agg(F.count(F.lit(1)).alias("has"))).select(F.lit("pair rows").alias("check"), F.abs(F.col("n") - F.col("has")).alias("n"))
    disordered = count(pairs.where("low >= high or matching_shared_ids > shared_ids"), "disordered pairs")
    return found.union(missing).union(disordered).where("n > 0")
