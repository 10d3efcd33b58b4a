"""Queries of the registry's life: records, staged candidates, representatives, updates and copies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle, registry
from ..sources import fasta, files, tables
from .registry import query
from .sequence_queries import _BATTERY, ENTRIES, PARTS, SEQ, _similar, entries, parts, table

_PAIR = ["kind", "low", "high"]
_COUNTS = ["shared_ids", "shared_sequences", "shared_descriptions", "shared_exact_pairs", "matching_shared_ids"]


def _pair_sql(source: str) -> str:
    """pair_stats of a table expression `entries`, as common table expressions up to `pairs`."""
    def shared(column: str) -> str:
        return f"SELECT a.kind, a.database_id AS low, b.database_id AS high, count(*) AS n FROM (SELECT DISTINCT database_id, kind, {column} AS v FROM entries WHERE {column} IS NOT NULL) a JOIN (SELECT DISTINCT database_id, kind, {column} AS v FROM entries WHERE {column} IS NOT NULL) b ON a.kind = b.kind AND a.v = b.v AND a.database_id < b.database_id GROUP BY ALL"

    return f"""{source}, dbs AS (SELECT DISTINCT database_id FROM entries), grid AS (SELECT k.kind, a.database_id AS low, b.database_id AS high FROM dbs a JOIN dbs b ON a.database_id < b.database_id, (SELECT unnest(['target', 'contaminant']) AS kind) k),
 si AS ({shared('sequence_id')}), ss AS ({shared('sequence_hash')}), sd AS ({shared('description_hash')}),
 dp AS (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash FROM entries), sx AS (SELECT a.kind, a.database_id AS low, b.database_id AS high, count(*) AS x, count(DISTINCT a.sequence_id) AS m FROM dp a JOIN dp b ON a.kind = b.kind AND a.sequence_id = b.sequence_id AND a.sequence_hash = b.sequence_hash AND a.database_id < b.database_id GROUP BY ALL),
 pairs AS (SELECT g.kind, g.low, g.high, coalesce(si.n, 0) AS shared_ids, coalesce(ss.n, 0) AS shared_sequences, coalesce(sd.n, 0) AS shared_descriptions, coalesce(x, 0) AS shared_exact_pairs, coalesce(m, 0) AS matching_shared_ids
  FROM grid g LEFT JOIN si ON (si.kind, si.low, si.high) = (g.kind, g.low, g.high) LEFT JOIN ss ON (ss.kind, ss.low, ss.high) = (g.kind, g.low, g.high) LEFT JOIN sd ON (sd.kind, sd.low, sd.high) = (g.kind, g.low, g.high) LEFT JOIN sx ON (sx.kind, sx.low, sx.high) = (g.kind, g.low, g.high))"""


@query("pair_statistics", f"WITH {_pair_sql(ENTRIES)} SELECT * FROM pairs")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.pair_stats(entries(spark, sf_dir))


def _long_sql() -> str:
    """The long form of all pairs as text, with both sides' own counts and every ratio."""
    own = {"entries": "count(*)", "distinct_ids": "count(DISTINCT sequence_id)", "distinct_sequences": "count(DISTINCT sequence_hash)", "distinct_descriptions": "count(DISTINCT description_hash)", "distinct_pairs": "count(DISTINCT (sequence_id, sequence_hash))"}
    sides = ", ".join(f"coalesce({side}.{c}, 0) AS {c}_{name}" for side, name in (("x", "low"), ("y", "high")) for c in own)
    number = lambda v: f"CASE WHEN {v} = 0 THEN '0.0' WHEN {v} = 1 THEN '1.0' ELSE printf('%.12g', {v}) END"
    ratio = lambda a, b: number(f"coalesce({a} / nullif({b}, 0), 0.0)")
    columns = ["kind", "low", "high", *[f"CAST({c} AS VARCHAR) AS {c}" for c in (*_COUNTS, *(f"{c}_{s}" for c in own for s in ("low", "high")))]]
    for what in ("id", "sequence", "description"):
        s, a, b = f"shared_{what}s", f"distinct_{what}s_low", f"distinct_{what}s_high"
        columns += [f"{ratio(s, f'({a} + {b} - {s})')} AS {what}_jaccard", f"{ratio(s, a)} AS {what}_coverage_low_by_high", f"{ratio(s, b)} AS {what}_coverage_high_by_low", f"{ratio(s, f'least({a}, {b})')} AS {what}_containment"]
        columns += [f"CAST({s} > 0 AND {s} = {a} AS VARCHAR) AS {what}_low_in_high", f"CAST({s} > 0 AND {s} = {b} AS VARCHAR) AS {what}_high_in_low", f"CAST({s} > 0 AND {s} = {a} AND {s} = {b} AS VARCHAR) AS exact_{what}_set"]
    x = "shared_exact_pairs"
    columns += ["CAST(shared_ids - matching_shared_ids AS VARCHAR) AS changed_shared_ids", f"CAST({x} > 0 AND {x} = distinct_pairs_low AND {x} = distinct_pairs_high AS VARCHAR) AS exact_content"]
    return f"""WITH {_pair_sql(ENTRIES)}, own AS (SELECT database_id, kind, {", ".join(f"{e} AS {n}" for n, e in own.items())} FROM entries GROUP BY ALL),
 wide AS (SELECT pairs.*, {sides} FROM pairs LEFT JOIN own x ON x.database_id = low AND x.kind = pairs.kind LEFT JOIN own y ON y.database_id = high AND y.kind = pairs.kind) SELECT {", ".join(columns)} FROM wide"""


@query("long_export", _long_sql())
def long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.long_export(_similar(spark, sf_dir))


#: Every source twice, under its own name and a copy's, and a third time without its contaminants.
_COPIES = ENTRIES.replace("entries AS (", "single AS (") + ", entries AS (SELECT * FROM single UNION ALL SELECT * REPLACE ('copy_' || database_id AS database_id) FROM single UNION ALL SELECT * REPLACE ('part_' || database_id AS database_id) FROM single WHERE kind <> 'contaminant')"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = entries(spark, sf_dir)
    named = lambda rows, p: rows.withColumn("database_id", F.concat(F.lit(p), "database_id"))
    return one.union(named(one, "copy_")).union(named(one.where("kind <> 'contaminant'"), "part_"))


@query("representatives", f"""WITH {_COPIES}, s AS (SELECT DISTINCT kind, database_id, replace(replace(database_id, 'copy_', ''), 'part_', '') AS source FROM entries)
SELECT kind, database_id, min(database_id) OVER (PARTITION BY kind, source) AS representative FROM s""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.representatives(_copies(spark, sf_dir))


@query("pair_expansion", f"WITH {_pair_sql(_COPIES)} SELECT * FROM pairs")
def pair_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.expanded_pairs(_copies(spark, sf_dir))


@query("pair_refresh", f"WITH {_pair_sql(ENTRIES)} SELECT * FROM pairs WHERE 'src7' NOT IN (low, high)")
def pair_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a former state, in which two databases had other entries and one more was there, brought up to date."""
    now = entries(spark, sf_dir).where("database_id <> 'src7'")
    former = entries(spark, sf_dir).withColumn("sequence_id", F.when(F.col("database_id").isin("src0", "src3"), F.lower("sequence_id")).otherwise(F.col("sequence_id")))
    names = lambda *ids: spark.createDataFrame([(i,) for i in ids], "database_id string")
    return registry.refreshed_pairs(registry.pair_stats(former), now, names("src0", "src3"), names("src7")).select(*_PAIR, *_COUNTS)


@query("database_records", f"""WITH {ENTRIES} SELECT database_id, count(*) AS entries, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_entries" for k in registry.KINDS)},
 count(DISTINCT sequence_id) FILTER (kind = 'target') AS target_distinct_ids, count(DISTINCT sequence_hash) FILTER (kind = 'target') AS target_distinct_sequences, count(DISTINCT description_hash) FILTER (kind = 'target') AS target_distinct_descriptions,
 bool_or(kind = 'decoy') AS is_decoy, CASE WHEN count(*) <= 20 THEN 'full' ELSE 'metadata_only' END AS detail_level FROM entries GROUP BY database_id""")
def database_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.database_records(entries(spark, sf_dir), 20)


@query("database_listing", f"WITH {ENTRIES}, d AS (SELECT DISTINCT CASE WHEN database_id LIKE '%1%' THEN upper(database_id) ELSE database_id END AS database_id FROM entries) SELECT database_id, row_number() OVER (ORDER BY lower(database_id), database_id) AS place FROM d")
def database_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = entries(spark, sf_dir).select(F.when(F.col("database_id").contains("1"), F.upper("database_id")).otherwise(F.col("database_id")).alias("database_id")).distinct()
    rows = registry.listed(names).collect()  # names of databases
    return spark.createDataFrame([(r["database_id"], k + 1) for k, r in enumerate(rows)], "database_id string, place bigint")


@query("detail_levels", f"WITH {ENTRIES}, n AS (SELECT database_id, count(*) AS n FROM entries GROUP BY ALL) SELECT CASE WHEN n <= 20 THEN 'full' ELSE 'metadata_only' END AS detail_level, count(*) AS databases FROM n GROUP BY ALL")
def detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.detail_levels(entries(spark, sf_dir), 20).groupBy("detail_level").agg(F.count(F.lit(1)).alias("databases"))


@query("detailed_entries", f"WITH {ENTRIES} SELECT database_id, ordinal FROM entries WHERE database_id IN (SELECT database_id FROM entries GROUP BY ALL HAVING count(*) <= 20)")
def detailed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.detailed(entries(spark, sf_dir), 20).select("database_id", "ordinal")


@query("kind_grid", f"""WITH {ENTRIES}, stats AS ({_BATTERY}) SELECT d.database_id, k.kind, coalesce(s.entries, 0) AS entries, coalesce(s.distinct_ids, 0) AS distinct_ids FROM (SELECT DISTINCT database_id FROM entries) d, (SELECT unnest(['target', 'contaminant', 'decoy', 'entrapment', 'sentinel']) AS kind) k
 LEFT JOIN stats s ON s.database_id = d.database_id AND s.kind = k.kind""")
def kind_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = registry.complete_kinds(registry.kind_grid(registry.kind_stats(entries(spark, sf_dir))))
    return whole.select("database_id", F.explode("stats").alias("s")).select("database_id", "s.kind", "s.entries", "s.distinct_ids")


@query("scan_facts", """WITH e AS (SELECT user_id % 20 AS database_id, event_id AS ordinal, event_id % 7 AS sequence_length, CASE WHEN event_id % 13 = 0 THEN 'sentinel' ELSE 'target' END AS kind, CASE WHEN event_id % 5 = 0 THEN event_type END AS contaminant_group FROM events),
 g AS (SELECT database_id, contaminant_group, min(ordinal) AS place FROM e WHERE contaminant_group IS NOT NULL GROUP BY ALL)
SELECT database_id, count(*) AS entries, CAST(sum(sequence_length) AS BIGINT) AS residues, min(ordinal) FILTER (kind = 'sentinel') AS first_sentinel, (SELECT string_agg(contaminant_group, ',' ORDER BY place) FROM g WHERE g.database_id = e.database_id) AS contaminant_groups FROM e GROUP BY database_id""")
def scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("database_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 7).alias("sequence_length"),
        F.when(F.col("event_id") % 13 == 0, "sentinel").otherwise("target").alias("kind"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("contaminant_group"),
    )
    return registry.scan_facts(rows).withColumn("contaminant_groups", F.array_join("contaminant_groups", ","))


@query("sampled_entries", f"WITH {PARTS} SELECT database_id, least(count(*), 100) AS n FROM entries GROUP BY database_id")
def sampled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sampled(parts(spark, sf_dir), 100).groupBy("database_id").agg(F.count(F.lit(1)).alias("n"))


# --- candidates -------------------------------------------------------------

_STAGED = f"{ENTRIES}, mine AS (SELECT * FROM entries WHERE database_id = 'src0'), theirs AS (SELECT * FROM entries WHERE database_id <> 'src0')"


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One source as a candidate, and the others as the registry."""
    rows = entries(spark, sf_dir)
    return rows.where("database_id = 'src0'"), rows.where("database_id <> 'src0'")


@query("staged_counts", f"WITH {_STAGED} SELECT kind, count(*) AS entries, count(DISTINCT sequence_id) AS distinct_ids, count(DISTINCT sequence_hash) AS distinct_sequences, count(DISTINCT description_hash) AS distinct_descriptions, count(DISTINCT (sequence_id, sequence_hash)) AS distinct_pairs FROM mine GROUP BY kind")
def staged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.staged_counts(_staged(spark, sf_dir)[0])


_COMPARED = f"""{_STAGED}, ids AS (SELECT DISTINCT database_id, kind, sequence_id FROM theirs), own AS (SELECT DISTINCT kind, sequence_id FROM mine),
 s AS (SELECT database_id, kind, count(*) AS n FROM ids JOIN own USING (kind, sequence_id) GROUP BY ALL), x AS (SELECT t.database_id, t.kind, count(*) AS n FROM (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash FROM theirs) t JOIN (SELECT DISTINCT kind, sequence_id, sequence_hash FROM mine) USING (kind, sequence_id, sequence_hash) GROUP BY ALL),
 c AS (SELECT k.kind, d.database_id, (SELECT count(*) FROM own WHERE own.kind = k.kind) AS a, (SELECT count(*) FROM ids WHERE ids.kind = k.kind AND ids.database_id = d.database_id) AS b, coalesce(s.n, 0) AS shared_ids, coalesce(x.n, 0) AS shared_exact_pairs
  FROM (SELECT DISTINCT database_id FROM theirs) d, (SELECT unnest(['target', 'contaminant']) AS kind) k LEFT JOIN s ON s.database_id = d.database_id AND s.kind = k.kind LEFT JOIN x ON x.database_id = d.database_id AND x.kind = k.kind)"""


@query("candidate_comparison", f"""WITH {_COMPARED} SELECT kind, database_id, a AS selected_ids, b AS other_ids, shared_ids, shared_exact_pairs, a - shared_ids AS selected_only_ids, b - shared_ids AS other_only_ids,
 round(coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0), 9) AS id_jaccard, round(coalesce(shared_ids / nullif(least(a, b), 0), 0.0), 9) AS id_containment FROM c""")
def candidate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.comparison_frame(registry.compare_candidate(*_staged(spark, sf_dir)))
    return rows.select("kind", "database_id", "selected_ids", "other_ids", "shared_ids", "shared_exact_pairs", "selected_only_ids", "other_only_ids", F.round("id_jaccard", 9).alias("id_jaccard"), F.round("id_containment", 9).alias("id_containment"))


@query("candidate_among", f"WITH {_COMPARED} SELECT kind, database_id, shared_ids FROM c WHERE database_id IN ('src1', 'src2')")
def candidate_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    among = spark.createDataFrame([("src1",), ("src2",)], "database_id string")
    return registry.compare_candidate(*_staged(spark, sf_dir), among=among).select("kind", "database_id", "shared_ids")


@query("candidate_neighbours", f"WITH {_COMPARED} SELECT database_id, round(coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0), 9) AS score FROM c WHERE kind = 'target' ORDER BY coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0) DESC, database_id LIMIT 5")
def candidate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.candidate_neighbours(registry.compare_candidate(*_staged(spark, sf_dir)), 5).withColumn("score", F.round("score", 9))


@query("candidate_table", f"WITH {_COMPARED} SELECT kind, database_id, database_id AS filename, a AS selected_ids, b AS other_ids, shared_ids, shared_exact_pairs FROM c")
def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "candidates")
    tables.write_table(registry.candidate_table(registry.compare_candidate(*_staged(spark, sf_dir))), path, "candidate_comparison")
    return tables.read_table(spark, path, "candidate_comparison").select("kind", "database_id", "filename", "selected_ids", "other_ids", "shared_ids", "shared_exact_pairs")


@query("overlap_check", f"WITH {_COMPARED} SELECT database_id, shared_ids FROM c WHERE kind = 'target' AND shared_ids > 0 ORDER BY coalesce(shared_ids / nullif(least(a, b), 0), 0.0) DESC, coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0) DESC, shared_ids DESC, lower(database_id), database_id LIMIT 1")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.best_of_candidate(registry.compare_candidate(*_staged(spark, sf_dir))).select("database_id", "shared_ids")


@query("combined_candidate", f"WITH {ENTRIES} SELECT '0' AS database_id, row_number() OVER (ORDER BY database_id, ordinal) - 1 AS ordinal, sequence_id, kind FROM entries")
def combined_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.combined_candidate(entries(spark, sf_dir)).select("database_id", "ordinal", "sequence_id", "kind")


@query("target_ids", f"WITH {ENTRIES} SELECT DISTINCT database_id, sequence_id FROM entries WHERE kind = 'target'")
def target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.target_ids(entries(spark, sf_dir))


# --- registries on disk -----------------------------------------------------


def _fasta(spark: SparkSession, sf_dir: str, condition: str, name: str) -> str:
    """A folder with a FASTA file for each language: records of documents."""
    path = files.scratch(spark, name)
    docs = table(spark, sf_dir, "documents").where(condition)
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    for lang in ("de", "en", "es", "fr"):
        rows = docs.where(F.col("lang") == lang).select("doc_id", F.concat(F.lit("D"), F.col("doc_id") % 50, F.lit(" "), "source").alias("raw_header"), letters.alias("sequence"))
        tables.write_fasta_file(rows, f"{path}/{lang}.fasta", order=["doc_id"])
    return path


def _entries_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    return lifecycle.entries_of(fasta.proteins(fasta.read_records(spark, paths)))


def _indexed(spark: SparkSession, folder: str, root: str) -> None:
    found = fasta.discover(spark, folder)
    lifecycle.rebuild(_entries_of(spark, [r["path"] for r in found.collect()]), root, found)  # four files


def _named(column: str = "database_id"):
    """The language that a file is named after."""
    return F.regexp_extract(column, "([a-z]+)[.]fasta$", 1)


def _disk_sql(condition: str) -> str:
    return f"entries AS (SELECT lang AS database_id, doc_id AS ordinal, 'D' || (doc_id % 50) AS sequence_id, 'target' AS kind, md5({SEQ}) AS sequence_hash, source AS description_hash FROM documents WHERE {condition})"


@query("registry_index", f"WITH {_disk_sql('true')} SELECT database_id, count(*) AS entries, count(DISTINCT sequence_id) AS distinct_ids, count(DISTINCT sequence_hash) AS distinct_sequences, count(DISTINCT description_hash) AS distinct_descriptions FROM entries GROUP BY database_id")
def registry_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = files.scratch(spark, "registry")
    _indexed(spark, _fasta(spark, sf_dir, "true", "in"), root)
    held = lifecycle.open_registry(spark, root)["kind_stats"]
    return held.select(_named().alias("database_id"), "entries", "distinct_ids", "distinct_sequences", "distinct_descriptions")


@query("registry_second_rebuild", "SELECT DISTINCT lang AS database_id FROM documents WHERE lang <> 'fr'")
def registry_second_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that is built again from fewer files keeps none of the others."""
    folder, root = _fasta(spark, sf_dir, "true", "in"), files.scratch(spark, "registry")
    _indexed(spark, folder, root)
    files.delete(spark, f"{folder}/fr.fasta")
    _indexed(spark, folder, root)
    return lifecycle.open_registry(spark, root)["entries"].select(_named().alias("database_id")).distinct()


_UPDATED = "(lang <> 'fr' AND (lang <> 'de' OR doc_id % 2 = 0))"


@query("registry_update", f"WITH {_pair_sql(_disk_sql(_UPDATED))} SELECT low, high, shared_ids, shared_sequences, shared_descriptions, shared_exact_pairs, matching_shared_ids FROM pairs WHERE kind = 'target'")
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a file was changed and one is gone, an update reads the changed one and leaves the pairs of the others."""
    folder, root = _fasta(spark, sf_dir, "true", "in"), files.scratch(spark, "registry")
    _indexed(spark, folder, root)
    other = _fasta(spark, sf_dir, "doc_id % 2 = 0", "other")
    for name in ("fr", "de"):
        files.delete(spark, f"{folder}/{name}.fasta")
    files.move(spark, f"{other}/de.fasta", f"{folder}/de.fasta")
    lifecycle.update(spark, fasta.discover(spark, folder), root, lambda paths: _entries_of(spark, paths))
    held = lifecycle.open_registry(spark, root)["pair_stats"].where("kind = 'target'")
    return held.select(_named("low").alias("low"), _named("high").alias("high"), *_COUNTS)


@query("inventory_index", f"""WITH {_pair_sql(_disk_sql("lang <> 'de'") + f", extra AS (SELECT 'inventory' AS database_id, 0 AS ordinal, 'D' || (doc_id % 50) AS sequence_id, 'target' AS kind, md5({SEQ}) AS sequence_hash, source AS description_hash FROM documents WHERE lang = 'de')").replace("entries AS (SELECT", "files AS (SELECT", 1).replace(", dbs AS", ", entries AS (SELECT * FROM files UNION ALL SELECT * FROM extra), dbs AS", 1)}
SELECT low, high, shared_ids, shared_sequences FROM pairs WHERE kind = 'target'""")
def inventory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, and an inventory of the fourth language that is added to their registry."""
    folder, root = _fasta(spark, sf_dir, "lang <> 'de'", "in"), files.scratch(spark, "registry")
    files.delete(spark, f"{folder}/de.fasta")
    _indexed(spark, folder, root)
    docs = table(spark, sf_dir, "documents").where("lang = 'de'")
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    rows = docs.select(F.col("doc_id").alias("final_order"), F.concat(F.lit("D"), F.col("doc_id") % 50).alias("id"), F.lit("target").alias("kind"), F.lit(None).cast("string").alias("contaminant_group"), letters.alias("sequence"), F.col("source").alias("description"))
    lifecycle.index_inventory(rows, root, "inventory")
    held = lifecycle.open_registry(spark, root)["pair_stats"].where("kind = 'target'")
    name = lambda c: F.when(F.col(c) == "inventory", F.col(c)).otherwise(_named(c))
    low, high = name("low"), name("high")
    return held.select(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"), "shared_ids", "shared_sequences")


@query("registry_statistics_copy", f"WITH {_disk_sql('true')} SELECT database_id, count(*) AS entries, false AS has_entries FROM entries GROUP BY database_id")
def registry_statistics_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, copy = files.scratch(spark, "registry"), files.scratch(spark, "copy")
    _indexed(spark, _fasta(spark, sf_dir, "true", "in"), root)
    lifecycle.stats_only_copy(spark, root, copy)
    held = lifecycle.open_registry(spark, copy)
    return held["kind_stats"].select(_named().alias("database_id"), "entries", F.lit("entries" in held).alias("has_entries"))


@query("registry_problems", "SELECT 'statistics that differ' AS check, 1 AS n")
def registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    stats = registry.kind_stats(rows)
    wrong = stats.withColumn("entries", F.when((F.col("database_id") == "src0") & (F.col("kind") == "target"), F.col("entries") + 1).otherwise(F.col("entries")))
    return lifecycle.problems(rows, wrong, registry.pair_stats(rows))


@query("metadata_upsert", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM orders")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return lifecycle.upserted(rows, rows.where("key % 2 = 0").withColumn("value", F.lit("new")))


@query("changed_and_gone_files", """SELECT path, what FROM (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 3 = 0 THEN 'new' END AS what FROM orders WHERE o_orderkey % 7 <> 0) WHERE what IS NOT NULL
 UNION ALL SELECT o_orderkey, 'gone' FROM orders WHERE o_orderkey % 7 = 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0)""")
def changed_and_gone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("bytes"), F.col("o_orderdate").alias("modified"))
    seen = rows.where("path % 7 <> 0")
    known = rows.where("path % 3 <> 0 or path % 5 = 0").withColumn("bytes", F.when(F.col("path") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    fresh = lifecycle.changed_files(seen, known).select("path", F.when(F.col("path") % 5 == 0, "changed").otherwise("new").alias("what"))
    return fresh.union(lifecycle.gone_files(seen, known).select("path", F.lit("gone")))


@query("leaf_positions", f"WITH {ENTRIES}, n AS (SELECT count(DISTINCT database_id) AS n FROM entries WHERE kind = 'target') SELECT unnest(range(n)) AS position FROM n")
def leaf_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.leaf_order(_similar(spark, sf_dir)).where("position is not null").select(F.col("position").cast("bigint").alias("position"))
