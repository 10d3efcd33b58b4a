"""Canonical tables: schemas, exact checks when read, and writers."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """A schema of `name: type` lines; a type with ? may be null."""
    columns = [part.strip().split(": ") for part in text.replace("\n", ",").split(",") if part.strip()]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")) for name, kind in columns])


#: The columns of each table, in order; ? may be null.
PROTEIN_INPUT = _schema("source_order: long, record_order: long, source_id: string, role: string, block_name: string?, block_description: string?, raw_header: string, id: string, description: string?, sequence: string, upper_cased: boolean, terminal_stop_stripped: boolean")
PROTEIN_INVENTORY = _schema("final_order: long, source_order: long?, record_order: long?, source_id: string?, source_role: string?, raw_header: string, id: string, description: string?, sequence: string, kind: string, contaminant_group: string?, sequence_hash: string, entrapment_strategy: string?")
SEARCH_INVENTORY = T.StructType([*PROTEIN_INVENTORY.fields, *_schema("decoy_strategy: string?, decoy_source_order: long?, decoy_source_id: string?, decoy_source_kind: string?").fields])
ENTRAPMENT_PAIRS = _schema("source_id: string, target_peptide: string, generated_peptide: string, fold_index: long")
PEPTIDES = _schema("peptide_id: string, sequence: string, length: long, missed_cleavages: long, mapping_count: long, protein_count: long, target_count: long, contaminant_count: long, entrapment_count: long, decoy_count: long")
PROTEIN_PEPTIDE_MAP = _schema("peptide_id: string, peptide_sequence: string, protein_order: long, protein_id: string, protein_kind: string, missed_cleavages: long")
PEPTIDE_COMPARISON = _schema("population: string, distinct_peptides_a: long, distinct_peptides_b: long, shared_peptides: long, jaccard: double, coverage_a_by_b: double, coverage_b_by_a: double, containment: double")
DECOY_REPORT = _schema("method: string, proteins: long, peptides: long, unique_peptides: long, unique_ratio: double, length_p10: double, length_median: double, length_p90: double, shared_with_targets: long, repeated_peptides: long, composition_overlap: double, initial_collisions: long, unresolved_collisions: long, dropped_peptides: long, omitted_decoys: long")
UNIPROT_CATALOG = _schema("proteome_id: string, taxid: long, organism: string, proteome_type: string, swissprot: long?, swissprot_trembl: long?, one_seq_per_gene: long?")
CANDIDATE_COMPARISON = _schema("database_id: string, filename: string, kind: string, relationship: string, selected_ids: long, other_ids: long, shared_ids: long, id_containment: double, id_jaccard: double, shared_sequences: long, shared_descriptions: long, description_jaccard: double, shared_exact_pairs: long, changed_shared_ids: long, selected_only_ids: long, other_only_ids: long, exact_id_set: boolean, exact_content: boolean")

SCHEMAS = {
    "protein_input": PROTEIN_INPUT,
    "protein_inventory": PROTEIN_INVENTORY,
    "search_inventory": SEARCH_INVENTORY,
    "entrapment_pairs": ENTRAPMENT_PAIRS,
    "peptides": PEPTIDES,
    "protein_peptide_map": PROTEIN_PEPTIDE_MAP,
    "peptide_comparison": PEPTIDE_COMPARISON,
    "decoy_report": DECOY_REPORT,
    "uniprot_catalog": UNIPROT_CATALOG,
    "candidate_comparison": CANDIDATE_COMPARISON,
}


def same_schema(found: T.StructType, wanted: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in wanted]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A canonical table; any other columns, order or types raise."""
    rows = spark.read.parquet(path)
    if not same_schema(rows.schema, SCHEMAS[name]):
        raise ValueError(f"{path}: not a {name} table: {rows.schema.simpleString()}")
    return rows


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A biological or a search inventory, told apart by its columns."""
    rows = spark.read.parquet(path)
    for name in ("protein_inventory", "search_inventory"):
        if same_schema(rows.schema, SCHEMAS[name]):
            return rows
    raise ValueError(f"{path}: not an inventory: {rows.schema.simpleString()}")


def inventory_entries(rows: DataFrame) -> DataFrame:
    """The rows of an inventory, checked: an unknown kind raises, and so does a decoy without its source or one elsewhere."""
    wrong = ~F.col("kind").isin("target", "contaminant", "entrapment", "decoy", "sentinel")
    if "decoy_strategy" in rows.columns:
        has = F.col("decoy_strategy").isNotNull() & F.col("decoy_source_order").isNotNull()
        wrong = wrong | (has != (F.col("kind") == "decoy"))
    return rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("not a valid inventory row: "), "id", F.lit(" "), "kind")).cast("boolean")).otherwise(F.lit(True)))


def write_table(rows: DataFrame, path: str, name: str) -> None:
    """Write a canonical table where there is none yet."""
    if not same_schema(rows.schema, SCHEMAS[name]):
        raise ValueError(f"not a {name} table: {rows.schema.simpleString()}")
    rows.write.mode("errorifexists").parquet(path)


def fasta_text(header: Column, sequence: Column, width: int = 60) -> Column:
    """A record's text without the last line feed; width 0 keeps the sequence on one line."""
    wrapped = F.regexp_replace(sequence, "(.{%d})(?=.)" % width, "$1\n") if width > 0 else sequence
    if width > 0:
        return F.when(sequence == "", F.concat(F.lit(">"), header)).otherwise(F.concat(F.lit(">"), header, F.lit("\n"), wrapped))
    return F.concat(F.lit(">"), header, F.lit("\n"), wrapped)


def write_fasta(rows: DataFrame, path: str, *, order: list[str], header: str = "raw_header", sequence: str = "sequence", width: int = 60) -> None:
    """Records in order, as part files whose names keep the order."""
    rows.orderBy(*order).select(fasta_text(F.col(header), F.col(sequence), width).alias("value")).write.mode("errorifexists").text(path)


def write_fasta_file(rows: DataFrame, path: str, *, order: list[str], width: int = 60) -> None:
    """Records in order as one file: its parts are sorted and written by many tasks beside it, then joined."""
    aside = f"{path}.{uuid.uuid4().hex}.part"
    write_fasta(rows, aside, order=order, width=width)
    spark = rows.sparkSession
    files.joined(spark, [f"{aside}/{n}" for n in files.names(spark, aside) if n.startswith("part-")], path)
    files.delete(spark, aside)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Entrapment pairs as tab-separated text with a header, in a stable order."""
    rows = pairs.select("source_id", "fold_index", "target_peptide", "generated_peptide")
    rows.orderBy(*rows.columns).write.mode("errorifexists").option("header", "true").option("sep", "\t").csv(path)


def write_export(rows: DataFrame, path: str, *, exclude_sequence: bool = False) -> None:
    """A table by the suffix of its name: .csv, .tsv or .parquet; others raise (Spark writes no spreadsheets)."""
    rows = rows.drop("sequence") if exclude_sequence else rows
    suffix = Path(path).suffix
    writer = rows.write.mode("errorifexists")
    if suffix == ".parquet":
        writer.parquet(path)
    elif suffix in (".csv", ".tsv"):
        writer.option("header", "true").option("sep", "," if suffix == ".csv" else "\t").csv(path)
    else:
        raise ValueError(f"{path}: unknown suffix {suffix}")


def write_versioned(rows: DataFrame, path: str, config: dict) -> None:
    """Parquet with its configuration in the metadata of its first column, which read_versioned compares."""
    fields = [T.StructField(f.name, f.dataType, f.nullable, {"strandlake.config": json.dumps(config, sort_keys=True)} if k == 0 else f.metadata) for k, f in enumerate(rows.schema.fields)]
    first = fields[0]
    rows.withColumn(first.name, F.col(first.name).alias(first.name, metadata=first.metadata)).write.mode("errorifexists").parquet(path)


def read_versioned(spark: SparkSession, path: str, config: dict) -> DataFrame:
    rows = spark.read.parquet(path)
    if rows.schema.fields[0].metadata.get("strandlake.config") != json.dumps(config, sort_keys=True):
        raise ValueError(f"{path}: written with another configuration")
    return rows


def write_json(path: str | Path, document: dict, *, replace: bool = False) -> None:
    """A small evidence document, written aside and moved into place."""
    path = Path(path)
    if path.exists() and not replace:
        raise FileExistsError(path)
    aside = path.with_name(f".{path.name}.part")
    aside.write_text(json.dumps(document, sort_keys=True, indent=2) + "\n")
    os.replace(aside, path)
