"""Queries of scans, sinks and canonical tables: what is written of the test tables is read again and held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import CLASSIFIERS, HeaderColumn, HeaderFormat
from ..functions.sequences import Digestion, illegal_message, illegal_residues
from ..operators import build, generate, peptides, summary
from ..operators.formats import enrich, validate
from ..sources import fasta, files, tables
from .registry import query
from .sequence_queries import HEADERS, OCCURRENCES, PROTEINS, SEQ, SPLIT, TRYPSIN, headers, proteins, table

#: A record of each document: its id, language and source as header, its letters as sequence.
RECORDS = f"records AS (SELECT doc_id, 'D' || doc_id || ' ' || lang || ' of ' || source AS raw_header, {SEQ} AS sequence FROM documents)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.lit("D"), "doc_id", F.lit(" "), "lang", F.lit(" of "), "source")
    return docs.select("doc_id", header.alias("raw_header"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))


def _number(header: str):
    return F.regexp_extract(header, "^D([0-9]+)", 1).cast("bigint")


def _written(rows: DataFrame, name: str, *, codec: str = "uncompressed", line_end: str = "\n", width: int = 60) -> str:
    path = files.scratch(rows.sparkSession, name)
    ordered = rows.orderBy("doc_id").select(fasta_lines(rows, width).alias("value"))
    ordered.select(F.replace("value", F.lit("\n"), F.lit(line_end)).alias("value")).write.option("compression", codec).option("lineSep", line_end).text(path)
    return path


def fasta_lines(rows: DataFrame, width: int):
    return tables.fasta_text(F.col("raw_header"), F.col("sequence"), width)


@query("fasta_scan", f"WITH {RECORDS} SELECT doc_id, raw_header, sequence FROM records")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "scan")
    tables.write_fasta(records(spark, sf_dir), path, order=["doc_id"])
    return fasta.read_records(spark, path).select(_number("raw_header").alias("doc_id"), "raw_header", "sequence")


@query("fasta_codecs", f"WITH {RECORDS} SELECT codec, doc_id, length(sequence) AS residues, md5(sequence) AS digest FROM records, (SELECT unnest(['plain', 'gzip', 'bzip2']) AS codec)")
def fasta_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for codec in ("plain", "gzip", "bzip2"):
        read = fasta.read_records(spark, _written(records(spark, sf_dir), codec, codec="uncompressed" if codec == "plain" else codec))
        part = read.select(F.lit(codec).alias("codec"), _number("raw_header").alias("doc_id"), F.length("sequence").cast("bigint").alias("residues"), F.md5("sequence").alias("digest"))
        out = part if out is None else out.union(part)
    return out


@query("fasta_line_ends", f"WITH {RECORDS} SELECT ends, doc_id, raw_header, md5(sequence) AS digest FROM records, (SELECT unnest(['lf', 'crlf', 'cr']) AS ends)")
def fasta_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, end in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
        read = fasta.read_records(spark, _written(records(spark, sf_dir), name, line_end=end))
        part = read.select(F.lit(name).alias("ends"), _number("raw_header").alias("doc_id"), "raw_header", F.md5("sequence").alias("digest"))
        out = part if out is None else out.union(part)
    return out


@query("fasta_headers", f"WITH {RECORDS} SELECT doc_id, raw_header FROM records")
def fasta_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(records(spark, sf_dir), "headers")
    return fasta.read_headers(spark, path).select(_number("raw_header").alias("doc_id"), "raw_header")


def _lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in lower case with a stop at the end."""
    return records(spark, sf_dir).withColumn("sequence", F.concat(F.lower("sequence"), F.lit("*")))


@query("fasta_proteins", f"WITH {RECORDS} SELECT 'D' || doc_id AS id, substr(raw_header, instr(raw_header, ' ') + 1) AS description, sequence, sequence <> '' AS upper_cased, true AS terminal_stop_stripped FROM records")
def fasta_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = fasta.read_records(spark, _written(_lower(spark, sf_dir), "proteins"))
    return fasta.proteins(read).select("id", "description", "sequence", "upper_cased", "terminal_stop_stripped")


@query("fasta_basic", f"WITH {RECORDS} SELECT 'D' || doc_id AS id, substr(raw_header, instr(raw_header, ' ') + 1) AS description, sequence FROM records")
def fasta_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.basic_frame(spark, _written(records(spark, sf_dir), "basic", width=0))


@query("fasta_diagnosed", f"""
WITH {PROTEINS} SELECT id, 'unmatched' AS namespace, CASE WHEN final_order % 3 = 0 THEN 'decoy' ELSE '' END AS classifications, regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYXBZUOJ]', '', 'g') || '-' AS illegal_residues, '-' AS message FROM
 (SELECT (CASE WHEN final_order % 3 = 0 THEN 'REV_' ELSE '' END) || 'd_' || id AS id, final_order, sequence FROM proteins)""")
def fasta_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    named = F.concat(F.when(F.col("final_order") % 3 == 0, "REV_").otherwise(""), F.lit("d_"), "id")
    path = _written(rows.select(F.col("final_order").alias("doc_id"), named.alias("raw_header"), F.concat("sequence", F.lit("-")).alias("sequence")), "diagnosed")
    found = fasta.diagnosed(fasta.proteins(fasta.read_records(spark, path)))
    return found.select("id", "namespace", F.array_join("classifications", "+").alias("classifications"), "illegal_residues", illegal_message(F.col("illegal_residues")).alias("message"))


@query("diagnostic_summary", f"""
WITH {PROTEINS} SELECT measure, value, count(*) AS n FROM (SELECT 'namespace' AS measure, 'unmatched' AS value FROM proteins UNION ALL SELECT 'combination', CASE WHEN final_order % 3 = 0 THEN 'decoy' ELSE '' END FROM proteins
 UNION ALL SELECT 'label', 'decoy' FROM proteins WHERE final_order % 3 = 0 UNION ALL SELECT 'change', 'terminal_stop_stripped' FROM proteins UNION ALL SELECT 'change', 'upper_cased' FROM proteins WHERE sequence <> ''
 UNION ALL SELECT 'illegal', '-' FROM proteins) GROUP BY measure, value""")
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    named = F.concat(F.when(F.col("final_order") % 3 == 0, "REV_").otherwise(""), F.lit("d_"), "id")
    raw = rows.select(F.lit("").alias("source_path"), F.col("final_order").alias("record_ordinal"), named.alias("raw_header"), F.concat(F.lit("-"), F.lower("sequence"), F.lit("*")).alias("sequence"))
    return summary.diagnostic_counts(fasta.diagnosed(fasta.proteins(raw)))


@query("fasta_provenance", f"WITH {RECORDS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS BIGINT) AS record_ordinal, 'part' || (doc_id % 4) AS folder FROM records")
def fasta_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = []
    for k in range(4):
        paths.append(files.scratch(spark, f"part{k}"))
        tables.write_fasta_file(records(spark, sf_dir).where(F.col("doc_id") % 4 == k), f"{paths[-1]}/records.fasta", order=["doc_id"])
    rows = fasta.proteins(fasta.read_records(spark, paths))
    return rows.select(_number("raw_header").alias("doc_id"), "record_ordinal", F.regexp_extract("source_path", "(part[0-9])/[^/]*$", 1).alias("folder"))


@query("fasta_inline", "SELECT n_nationkey AS record_ordinal, 'N' || n_nationkey AS id, n_name AS description, regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS sequence FROM nation")
def fasta_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "\n" + "".join(f">N{r['n_nationkey']} {r['n_name']}\r\n{r['n_name'].lower()[:3]}\n\n{r['n_name'][3:]}*\n" for r in rows)
    found = fasta.proteins(fasta.parse_text(spark, text))
    return found.select("record_ordinal", "id", "description", F.regexp_replace("sequence", "[^A-Z]", "").alias("sequence"))


def _uniprot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("doc_id", "raw_header", F.lit("ACD").alias("sequence"))


@query("strict_frame", f"WITH {HEADERS} SELECT doc_id, 'uniprotkb' AS database, 'D' || doc_id AS accession, doc_id AS taxonomy_id, false AS is_decoy FROM headers")
def strict_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fasta.basic_frame(spark, _written(_uniprot(spark, sf_dir), "strict"))
    return enrich(rows, strict=True).select(F.col("taxonomy_id").alias("doc_id"), "database", "accession", "taxonomy_id", "is_decoy")


@query("strict_frame_of_mixed_formats", "SELECT count(*) AS n, 'id description sequence' AS columns FROM documents")
def strict_frame_of_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers(spark, sf_dir).withColumn("raw_header", F.when(F.col("doc_id") % 2 == 0, F.col("raw_header")).otherwise("other")).select("doc_id", "raw_header", F.lit("ACD").alias("sequence"))
    found = enrich(fasta.basic_frame(spark, _written(rows, "mixed")), strict=True)
    return found.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(" ".join(found.columns)))


#: A format of the records above, as a rule document would state it.
RECORD_FORMAT = HeaderFormat(
    "documents",
    r"^D[0-9]+\s+(?:en|de|fr|es)\s+of\s+\S+$",
    (
        HeaderColumn("database", value="documents", required=True),
        HeaderColumn("number", r"^D([0-9]+)\s", kind="integer", required=True),
        HeaderColumn("language", r"^D[0-9]+\s+(\S+)\s", values=(("en", "English"), ("de", "German"))),
        HeaderColumn("origin", r"\sof\s+(\S+)$"),
    ),
)


@query("configured_frame", "SELECT doc_id AS number, 'documents' AS database, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END AS language, source AS origin, false AS is_contaminant FROM documents")
def configured_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich(fasta.basic_frame(spark, _written(records(spark, sf_dir), "configured")), (RECORD_FORMAT,), CLASSIFIERS)
    return found.select("number", "database", "language", "origin", "is_contaminant")


@query("database_schema", "SELECT * FROM (VALUES ('database', 'string'), ('number', 'bigint'), ('language', 'string'), ('origin', 'string')) AS t(name, type)")
def database_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(validate((RECORD_FORMAT,), CLASSIFIERS).items()), "name string, type string")


@query("versioned_table", f"WITH {RECORDS} SELECT doc_id, raw_header, sequence FROM records")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, config = files.scratch(spark, "versioned"), {"formats": ["documents"], "version": 1}
    tables.write_versioned(records(spark, sf_dir), path, config)
    return tables.read_versioned(spark, path, config)


@query("exported_csv_and_tsv", f"WITH {RECORDS} SELECT form, doc_id, raw_header FROM records, (SELECT unnest(['csv', 'tsv', 'parquet']) AS form)")
def exported_csv_and_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for form in ("csv", "tsv", "parquet"):
        path = files.scratch(spark, f"export.{form}")
        tables.write_export(records(spark, sf_dir), path, exclude_sequence=True)
        read = spark.read.parquet(path) if form == "parquet" else spark.read.option("header", "true").option("sep", "," if form == "csv" else "\t").csv(path)
        part = read.select(F.lit(form).alias("form"), F.col("doc_id").cast("bigint").alias("doc_id"), "raw_header")
        out = part if out is None else out.union(part)
    return out


# --- canonical tables -------------------------------------------------------

#: Documents with letters, as input of two sources: targets, and contaminants of one block.
INPUT = f"input AS (SELECT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_order, doc_id AS record_order, CASE WHEN lang = 'en' THEN 'target' ELSE 'contaminant' END AS role, 'D' || doc_id AS id, {SEQ} AS sequence FROM documents WHERE {SEQ} <> '')"


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(records(spark, sf_dir), "doc_id").where("sequence <> ''").withColumnRenamed("doc_id", "record_ordinal")
    one = build.legal(build.prepared(rows.where("lang = 'en'"), source_order=0, source_id="targets"), "targets")
    two = build.legal(build.prepared(rows.where("lang <> 'en'"), source_order=1, source_id="contaminants", role="contaminant", block_name="block"), "contaminants")
    return one.unionByName(two)


def _stored(rows: DataFrame, name: str) -> str:
    path = files.scratch(rows.sparkSession, name)
    tables.write_table(rows, path, name)
    return path


@query("protein_input_table", f"WITH {INPUT} SELECT CAST(source_order AS BIGINT) AS source_order, record_order, role, CASE WHEN role = 'contaminant' THEN 'block' END AS block_name, id, sequence, false AS upper_cased FROM input")
def protein_input_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables.read_table(spark, _stored(_input(spark, sf_dir), "protein_input"), "protein_input")
    return read.select("source_order", "record_order", "role", "block_name", "id", "sequence", "upper_cased")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.inventory_of(tables.read_table(spark, _stored(_input(spark, sf_dir), "protein_input"), "protein_input"))


_INVENTORY = f"{INPUT}, inventory AS (SELECT row_number() OVER (ORDER BY source_order, record_order) - 1 AS final_order, * FROM input)"


@query("protein_inventory_table", f"WITH {_INVENTORY} SELECT final_order, record_order, role AS source_role, id, sequence, role AS kind, CASE WHEN role = 'contaminant' THEN 'block' END AS contaminant_group FROM inventory")
def protein_inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables.inventory_entries(tables.read_inventory(spark, _stored(_inventory(spark, sf_dir), "protein_inventory")))
    return read.select("final_order", "record_order", "source_role", "id", "sequence", "kind", "contaminant_group")


@query("search_inventory_table", f"""WITH {_INVENTORY} SELECT final_order, id, kind, sequence, decoy_strategy, decoy_source_order, decoy_source_kind, raw_header LIKE '%; decoys (reverse)' AS annotated FROM (
 SELECT final_order, id, role AS kind, sequence, CAST(NULL AS VARCHAR) AS decoy_strategy, CAST(NULL AS BIGINT) AS decoy_source_order, CAST(NULL AS VARCHAR) AS decoy_source_kind, CASE WHEN final_order = 0 THEN '; decoys (reverse)' ELSE '' END AS raw_header FROM inventory
 UNION ALL SELECT final_order + (SELECT count(*) FROM inventory), 'REV_' || id, 'decoy', reverse(sequence), 'reverse', final_order, role, '' FROM inventory)""")
def search_inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inventory(spark, sf_dir)
    decoys = generate.reverse_decoys(rows.select("final_order", "id", "raw_header", "sequence")).withColumn("id", F.concat(F.lit("REV_"), "id"))
    made = build.annotated(build.search_inventory(build.without_decoys(rows), decoys, "reverse"), "decoys (reverse)")
    read = tables.inventory_entries(tables.read_inventory(spark, _stored(made, "search_inventory")))
    return read.select("final_order", "id", "kind", "sequence", "decoy_strategy", "decoy_source_order", "decoy_source_kind", F.col("raw_header").endswith("; decoys (reverse)").alias("annotated"))


@query("derived_input_table", f"WITH {_INVENTORY} SELECT final_order AS record_order, role, CASE WHEN role = 'contaminant' THEN 'block' END AS block_name, id FROM inventory")
def derived_input_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build.derived_input(_inventory(spark, sf_dir), source_order=3, source_id="derived")
    return tables.read_table(spark, _stored(made, "protein_input"), "protein_input").select("record_order", "role", "block_name", "id")


@query("derived_input_counts", f"WITH {PROTEINS} SELECT kind, count(*) AS n, kind IN ('target', 'contaminant') AS kept FROM proteins GROUP BY kind")
def derived_input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.derived_counts(proteins(spark, sf_dir))


@query("packaging_filter", f"WITH {PROTEINS} SELECT id, kind FROM proteins WHERE kind NOT IN ('sentinel', 'decoy')")
def packaging_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.without_packaging(proteins(spark, sf_dir)).select("id", "kind")


@query("scientific_filter", f"WITH {PROTEINS} SELECT id, kind FROM proteins WHERE kind IN ('target', 'contaminant', 'entrapment')")
def scientific_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.scientific(proteins(spark, sf_dir)).select("id", "kind")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.protein_peptides(proteins(spark, sf_dir), TRYPSIN)


@query("peptides_table", f"""WITH {OCCURRENCES}, one AS (SELECT DISTINCT peptide, id, kind FROM occ)
SELECT peptide AS sequence, length(peptide) AS length, count(*) AS protein_count, count(*) FILTER (kind = 'decoy') AS decoy_count, 36 AS id_length FROM one GROUP BY peptide""")
def peptides_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables.read_table(spark, _stored(peptides.peptides_table(_mapped(spark, sf_dir)), "peptides"), "peptides")
    return read.select("sequence", "length", "protein_count", "decoy_count", F.length("peptide_id").cast("bigint").alias("id_length"))


@query("protein_peptide_map_table", f"WITH {OCCURRENCES} SELECT peptide AS peptide_sequence, id AS protein_id, min(final_order) AS protein_order, kind AS protein_kind FROM occ GROUP BY peptide, id, kind")
def protein_peptide_map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables.read_table(spark, _stored(peptides.map_table(_mapped(spark, sf_dir)), "protein_peptide_map"), "protein_peptide_map")
    return read.select("peptide_sequence", "protein_id", "protein_order", "protein_kind")


@query("peptide_comparison_table", f"""WITH {OCCURRENCES}, a AS (SELECT DISTINCT peptide FROM occ WHERE kind = 'target'), b AS (SELECT DISTINCT peptide FROM occ WHERE kind <> 'target')
SELECT 'all' AS population, (SELECT count(*) FROM a) AS distinct_peptides_a, (SELECT count(*) FROM b) AS distinct_peptides_b, (SELECT count(*) FROM a JOIN b USING (peptide)) AS shared_peptides""")
def peptide_comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    a, b = (peptides.inventory(peptides.protein_peptides(rows.where(c), TRYPSIN)) for c in ("kind = 'target'", "kind <> 'target'"))
    read = tables.read_table(spark, _stored(peptides.compare(a, b), "peptide_comparison"), "peptide_comparison")
    return read.where("population = 'all'").select("population", "distinct_peptides_a", "distinct_peptides_b", "shared_peptides")


@query("decoy_report_table", f"""
WITH {OCCURRENCES}, rd AS (SELECT unnest({SPLIT.format('reverse(sequence)')}) AS peptide FROM proteins), r AS (SELECT peptide, count(*) AS n FROM rd WHERE length(peptide) BETWEEN 7 AND 50 GROUP BY peptide), t AS (SELECT peptide, count(*) AS n FROM occ GROUP BY peptide)
SELECT 'biological' AS method, (SELECT count(*) FROM proteins) AS proteins, CAST(sum(n) AS BIGINT) AS peptides, count(*) AS unique_peptides, count(*) FILTER (n > 1) AS repeated_peptides, count(*) AS shared_with_targets FROM t
UNION ALL SELECT 'reverse', (SELECT count(*) FROM proteins), CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (n > 1), (SELECT count(*) FROM r JOIN t USING (peptide)) FROM r""")
def decoy_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).select("id", F.col("id").alias("raw_header"), "sequence")
    read = tables.read_table(spark, _stored(peptides.decoy_report(rows, {"reverse": generate.reverse_decoys(rows)}, TRYPSIN), "decoy_report"), "decoy_report")
    return read.select("method", "proteins", "peptides", "unique_peptides", "repeated_peptides", "shared_with_targets")


@query("entrapment_pairs_table", f"WITH {OCCURRENCES} SELECT DISTINCT id AS source_id, peptide AS target_peptide, CAST(0 AS BIGINT) AS fold_index, true AS rearranged FROM occ")
def entrapment_pairs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).select("id", F.col("id").alias("raw_header"), "sequence")
    read = tables.read_table(spark, _stored(generate.entrapment_pairs(rows, TRYPSIN, 1, 7), "entrapment_pairs"), "entrapment_pairs")
    sorted_letters = lambda c: F.array_sort(F.split(c, ""))
    same = (sorted_letters("target_peptide") == sorted_letters("generated_peptide")) & (F.col("target_peptide") != F.col("generated_peptide"))
    return read.select("source_id", "target_peptide", "fold_index", same.alias("rearranged"))


@query("entrapment_pairs_text", f"WITH {OCCURRENCES} SELECT DISTINCT id AS source_id, '0' AS fold_index, peptide AS target_peptide FROM occ")
def entrapment_pairs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "pairs")
    tables.write_pairs(generate.entrapment_pairs(proteins(spark, sf_dir).select("id", F.col("id").alias("raw_header"), "sequence"), TRYPSIN, 1, 7), path)
    return spark.read.option("header", "true").option("sep", "\t").csv(path).select("source_id", "fold_index", "target_peptide")


@query("uniprot_catalog_table", "SELECT 'UP' || c_custkey AS proteome_id, c_custkey AS taxid, c_name AS organism, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS swissprot, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 5 END AS swissprot_trembl FROM customer")
def uniprot_catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import uniprot

    counts = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_nationkey").alias("reviewedProteinCount"), F.lit(5).alias("unreviewedProteinCount")))
    raw = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.concat(F.lit("UP"), "c_custkey").alias("id"), F.struct(F.col("c_custkey").alias("taxonId"), F.col("c_name").alias("scientificName")).alias("taxonomy"), F.lit("1").alias("proteomeType"), counts.alias("proteomeStatistics"))).alias("json"))
    read = tables.read_table(spark, _stored(uniprot.catalog_rows(raw), "uniprot_catalog"), "uniprot_catalog")
    return read.select("proteome_id", "taxid", "organism", "swissprot", "swissprot_trembl")


@query("uniprot_catalog_filter", "SELECT c_custkey AS taxid FROM customer WHERE contains(lower('UP' || c_custkey || ' ' || c_name || ' ' || c_custkey), '7')")
def uniprot_catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import uniprot

    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("UP"), "c_custkey").alias("proteome_id"), F.col("c_custkey").alias("taxid"), F.col("c_name").alias("organism"))
    return uniprot.filter_catalog(rows, " 7 ").select("taxid")


@query("uniprot_records", "SELECT (CASE WHEN p_partkey % 2 = 0 THEN 'sp' ELSE 'tr' END) || '|P' || p_partkey || '|E' || p_partkey || '_X ' || p_name || ' OX=' || p_size || ' PE=1' AS raw_header, 'ACD' AS sequence FROM part WHERE p_partkey % 5 <> 0")
def uniprot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import uniprot

    p = F.struct(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.concat(F.lit("E"), "p_partkey", F.lit("_X")).alias("uniProtkbId"), F.when(F.col("p_partkey") % 2 == 0, "UniProtKB reviewed").otherwise("UniProtKB unreviewed").alias("entryType"),
        F.col("p_name").alias("proteinName"), F.lit("1: Evidence").alias("proteinExistence"), F.struct(F.col("p_size").cast("string").alias("taxonId")).alias("organism"), F.when(F.col("p_partkey") % 5 != 0, F.struct(F.lit("ACD").alias("value"))).alias("sequence"),
    )
    return uniprot.fasta_records(table(spark, sf_dir, "part").select(F.to_json(F.struct(p.alias("canonicalProtein"))).alias("json")))


# --- names ------------------------------------------------------------------


@query("file_names", """SELECT o_orderkey, 'db_' || o_orderkey AS database, CAST(o_orderdate AS DATE) AS date, o_orderkey % 2 = 0 AS is_decoy, o_orderkey % 3 = 0 AS is_entrapment FROM orders""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/data/R_db_"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "_d").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, "_e").otherwise(""), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".fasta.gz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fasta.file_name_parts(name).alias("p")).select("o_orderkey", "p.*")


@query("build_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2020-02-03' END AS build_date FROM orders")
def build_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/data/x_20201399_"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("none"), F.lit(".fasta"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fasta.build_date(name, F.lit("2020-02-03 04:05:06").cast("timestamp")).alias("build_date"))


@query("sentinel_metadata", "SELECT o_orderkey, 'db' || o_custkey AS database, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS description FROM orders")
def sentinel_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = build.sentinel_column(F.concat(F.lit("db"), "o_custkey"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", build.sentinel_metadata(header).alias("m")).select("o_orderkey", "m.*")


@query("decoy_annotations", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'shuffle' END AS mode, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS seed FROM orders")
def decoy_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("decoys (shuffle) seed ("), "o_custkey", F.lit(")"))).otherwise(F.col("o_comment") if "o_comment" in table(spark, sf_dir, "orders").columns else F.lit("none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", build.decoy_annotation(text).alias("a")).select("o_orderkey", "a.*")


@query("relative_paths", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sub/' || o_orderkey || '.fasta' ELSE o_orderkey || '.fasta' END AS path FROM orders")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "file:///data/in/sub/").otherwise("/elsewhere/"), "o_orderkey", F.lit(".fasta"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.relative_path(whole, F.lit("/data/in/")).alias("path"))


@query("rendered_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'db_' || o_custkey ELSE 'db' END || '_' || strftime(o_orderdate, '%Y%m%d') || '.fasta' AS name FROM orders")
def rendered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(" ")
    name = build.rendered_name("{project}_{part}_{date}.fasta", project=F.lit("db"), part=part, date=F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


@query("guarded_digestion", f"WITH {OCCURRENCES} SELECT id, count(*) AS n FROM occ GROUP BY id")
def guarded_digestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides.digested(proteins(spark, sf_dir).withColumn("sequence", peptides.required_normalized(F.col("sequence"))), Digestion(shortest=7, longest=50), "id")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("leucine_targets", f"WITH {PROTEINS} SELECT id, replace(sequence, 'I', 'L') AS sequence, regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYXBZUOJ]', '', 'g') AS illegal FROM proteins")
def leucine_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.leucine_targets(proteins(spark, sf_dir))
    return rows.select("id", "sequence", illegal_residues(F.col("sequence")).alias("illegal"))

