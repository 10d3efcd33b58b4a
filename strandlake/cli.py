"""Command line: each command is one call of the engine on a local session or the launcher's."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import CLASSIFIERS, FORMATS, load_classifiers, load_format
from .functions.sequences import Digestion
from .operators import build, formats, generate, lifecycle, peptides, registry, summary
from .session import local_session
from .sources import fasta, tables


def _digestion(a: argparse.Namespace) -> Digestion:
    return Digestion(shortest=a.shortest, longest=a.longest, missed=a.missed)


def _proteins(spark: SparkSession, path: str) -> DataFrame:
    return fasta.proteins(fasta.read_records(spark, path))


def table(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = formats.enrich(_proteins(spark, a.fasta).select("id", "description", "sequence"), strict=a.strict)
    tables.write_export(rows, a.output, exclude_sequence=a.exclude_sequence)


def basic(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_export(fasta.basic_frame(spark, a.fasta), a.output)


def configured(spark: SparkSession, a: argparse.Namespace) -> None:
    rules = tuple(load_format(f) for f in a.format) or FORMATS
    rows = _proteins(spark, a.fasta).select("id", "description", "sequence")
    tables.write_export(formats.enrich(rows, rules, load_classifiers(a.classifiers) if a.classifiers else CLASSIFIERS, strict=a.strict), a.output)


def database(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = formats.enrich(_proteins(spark, a.fasta), static_schema=True)
    tables.write_versioned(rows, a.output, {"formats": [f.name for f in FORMATS]})


def format_counts(spark: SparkSession, a: argparse.Namespace) -> None:
    formats.diagnostics(_proteins(spark, a.fasta)).show(truncate=False)


def diagnostics(spark: SparkSession, a: argparse.Namespace) -> None:
    summary.diagnostic_counts(fasta.diagnosed(_proteins(spark, a.fasta))).orderBy("measure", "value").show(1000, truncate=False)


def digest(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = peptides.digested(_proteins(spark, a.fasta), _digestion(a), "id")
    tables.write_export(rows.select(F.col("id").alias("protein_id"), "peptide", "missed_cleavages"), a.output)


def peptide_tables(spark: SparkSession, a: argparse.Namespace) -> None:
    mapped = peptides.protein_peptides(tables.read_inventory(spark, a.inventory), _digestion(a))
    tables.write_table(peptides.peptides_table(mapped), f"{a.output}/peptides", "peptides")
    tables.write_table(peptides.map_table(mapped), f"{a.output}/map", "protein_peptide_map")


def pepcompare(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(peptides.compare(*(tables.read_table(spark, p, "peptides") for p in (a.first, a.second))), a.output, "peptide_comparison")


def checksum(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.rows:
        tables.write_export(lifecycle.with_row_checksums(fasta.basic_frame(spark, a.fasta)), a.rows)
    else:
        fasta.file_checksums(spark, a.fasta).show(1000, truncate=False)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(build.prepared(fasta.read_records(spark, a.fasta), source_order=a.order, source_id=a.source, role=a.role, block_name=a.block), a.output, "protein_input")


def derive_input(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = build.derived_input(tables.read_inventory(spark, a.inventory), source_order=a.order, source_id=a.source, foreign=a.foreign)
    tables.write_table(rows, a.output, "protein_input")


def build_database(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(build.inventory_of(tables.read_table(spark, a.input, "protein_input")), a.output, "protein_inventory")


def decoy(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_table(spark, a.inventory, "protein_inventory")
    sources = rows.where(F.col("kind").isin("target", "contaminant", "entrapment")).select("final_order", "id", "raw_header", "sequence")
    if a.mode == "decoypyrat":
        made = generate.decoypyrat(sources, _digestion(a), a.seed).join(sources.select("id", "final_order"), "id").select("final_order", "id", "raw_header", "sequence")
    else:
        made = generate.reverse_decoys(sources) if a.mode == "reverse" else generate.shuffle_decoys(sources, a.seed)
    named = made.withColumn("id", F.concat(F.lit("REV_"), "id"))
    tables.write_table(build.search_inventory(rows, named, a.mode), a.output, "search_inventory")


def decoy_report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = build.scientific(tables.read_inventory(spark, a.inventory)).select("raw_header", "id", "sequence")
    methods = {"reverse": generate.reverse_decoys(rows), "shuffle": generate.shuffle_decoys(rows, a.seed), "decoypyrat": generate.decoypyrat(rows, _digestion(a), a.seed)}
    tables.write_table(peptides.decoy_report(rows, methods, _digestion(a)), a.output, "decoy_report")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    found = fasta.discover(spark, a.directory)
    entries = lambda paths: lifecycle.entries_of(_proteins(spark, paths))
    if a.update:
        print(lifecycle.update(spark, found, a.registry, entries, prune=not a.keep, force=a.force))
    else:
        lifecycle.rebuild(entries([r["path"] for r in found.collect()]), a.registry, found)  # names of files


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    held = lifecycle.open_registry(spark, a.registry)
    registry.comparisons(registry.similarities(held["pair_stats"], held["kind_stats"]), a.database, a.threshold).orderBy("kind", "rank").show(1000, truncate=False)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    held = lifecycle.open_registry(spark, a.registry)
    registry.average_linkage(registry.similarities(held["pair_stats"], held["kind_stats"])).orderBy("step").show(1000, truncate=False)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    held = lifecycle.open_registry(spark, a.registry)
    tables.write_export(registry.long_export(registry.similarities(held["pair_stats"], held["kind_stats"])), a.output)


def index_inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    lifecycle.index_inventory(tables.inventory_entries(tables.read_inventory(spark, a.inventory)), a.registry, a.database)


def list_registry(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = lifecycle.read_registry(spark, a.registry)
    if rows is not None:
        rows.show(1000, truncate=False)


def candidate(spark: SparkSession, a: argparse.Namespace) -> None:
    staged = registry.combined_candidate(lifecycle.entries_of(_proteins(spark, a.fasta)))
    held = lifecycle.open_registry(spark, a.registry)["entries"]
    registry.comparison_frame(registry.compare_candidate(staged, held, a.threshold)).show(1000, truncate=False)


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    held = lifecycle.open_registry(spark, a.registry)
    similar = registry.similarities(held["pair_stats"], held["kind_stats"])
    if a.matrix:
        names = [r["database_id"] for r in held["kind_stats"].select("database_id").distinct().orderBy("database_id").collect()]  # names of databases
        tables.write_export(registry.jaccard_matrix(similar, "target", names, a.metric), a.output)
    else:
        tables.write_export(registry.long_export(similar), a.output)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    held = lifecycle.open_registry(spark, a.registry)
    lifecycle.problems(held["entries"], held["kind_stats"], held["pair_stats"]).show(truncate=False)


_LENGTHS = (("--shortest", dict(type=int, default=7)), ("--longest", dict(type=int, default=50)), ("--missed", dict(type=int, default=0)))
_STRICT = (("--strict", dict(action="store_true")),)
_SEED = (("--seed", dict(type=int, default=7)),)
_SOURCE = (("--order", dict(type=int, default=0)), ("--source", dict(required=True)))

#: Each command: its function, its arguments and its options.
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], tuple[str, ...], tuple]] = {
    "table": (table, ("fasta", "output"), (*_STRICT, ("--exclude-sequence", dict(action="store_true")))),
    "basic": (basic, ("fasta", "output"), ()),
    "configured": (configured, ("fasta", "output"), (*_STRICT, ("--format", dict(action="append", default=[])), ("--classifiers", {}))),
    "database": (database, ("fasta", "output"), ()),
    "formats": (format_counts, ("fasta",), ()),
    "diagnostics": (diagnostics, ("fasta",), ()),
    "digest": (digest, ("fasta", "output"), _LENGTHS),
    "peptides": (peptide_tables, ("inventory", "output"), _LENGTHS),
    "pepcompare": (pepcompare, ("first", "second", "output"), ()),
    "checksum": (checksum, ("fasta",), (("--rows", {}),)),
    "prepare": (prepare, ("fasta", "output"), (*_SOURCE, ("--role", dict(default="target")), ("--block", {}))),
    "derive-input": (derive_input, ("inventory", "output"), (*_SOURCE, ("--foreign", dict(action="store_true")))),
    "build": (build_database, ("input", "output"), ()),
    "decoy": (decoy, ("inventory", "output"), (*_LENGTHS, *_SEED, ("--mode", dict(choices=("reverse", "shuffle", "decoypyrat"), default="reverse")))),
    "decoy-report": (decoy_report, ("inventory", "output"), (*_LENGTHS, *_SEED)),
    "index": (index, ("directory", "registry"), (("--update", dict(action="store_true")), ("--keep", dict(action="store_true")), ("--force", dict(action="store_true")))),
    "index-inventory": (index_inventory, ("inventory", "registry", "database"), ()),
    "registry": (list_registry, ("registry",), ()),
    "candidate": (candidate, ("registry", "fasta"), (("--threshold", dict(type=float, default=0.99)),)),
    "pairs": (pairs, ("registry", "output"), (("--metric", dict(default="id_jaccard")), ("--matrix", dict(action="store_true")))),
    "compare": (compare, ("registry", "database"), (("--threshold", dict(type=float, default=0.99)),)),
    "cluster": (cluster, ("registry",), ()),
    "export": (export, ("registry", "output"), ()),
    "check": (check, ("registry",), ()),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments, options) in COMMANDS.items():
        one = commands.add_parser(name)
        for argument in arguments:
            one.add_argument(argument)
        for flag, settings in options:
            one.add_argument(flag, **settings)
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](spark or local_session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
