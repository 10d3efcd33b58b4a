"""Provider catalogues: pages of JSON become rows; the transport is given, so no network is needed to use or test it.

A transport is any object with `pages(endpoint, query)`, which yields lists of JSON texts, and
`fasta(query)`, which yields lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .tables import UNIPROT_CATALOG


class Transport(Protocol):
    def pages(self, endpoint: str, query: str) -> Iterator[list[str]]: ...

    def fasta(self, query: str) -> Iterable[str]: ...


#: Query templates of the provider.
REVIEWED = "(proteome:{}) AND (reviewed:true)"
COMPLETE = "(proteome:{})"
CANONICAL = "(upid:{})"
REFERENCE_TAXONOMY = "(taxonomy_id:{}) AND (proteome_type:1)"
TAXONOMY = "(taxonomy_id:{})"

PROTEOME = "id string, proteinCount string, geneCount string, proteomeType string, taxonomy struct<taxonId: string, scientificName: string>, proteomeStatistics struct<reviewedProteinCount: string, unreviewedProteinCount: string>"
GENE = "canonicalProtein struct<id: string, uniProtkbId: string, entryType: string, proteinName: string, geneName: string, proteinExistence: string, sequenceVersion: string, organism: struct<scientificName: string, taxonId: string>, sequence: struct<value: string>>"


def _integer(text: Column) -> Column:
    """A JSON integer; booleans, fractions and texts that are no number are null."""
    return F.when(text.rlike("^-?[0-9]+$"), text.cast("bigint"))


def catalog_query(selection: str, authored: str | None = None) -> str:
    return {"reference": "reference:true", "all": "*"}.get(selection) or authored or ""


def catalog_rows(raw: DataFrame, json: str = "json") -> DataFrame:
    """The canonical catalogue of proteome objects; an object without an id raises."""
    p = raw.select(F.from_json(json, PROTEOME).alias("p")).select("p.*")
    reviewed, unreviewed = (_integer(F.col(f"proteomeStatistics.{k}ProteinCount")) for k in ("reviewed", "unreviewed"))
    total = F.coalesce(_integer(F.col("proteinCount")), F.when(reviewed.isNotNull() | unreviewed.isNotNull(), F.coalesce(reviewed, F.lit(0)) + F.coalesce(unreviewed, F.lit(0))))
    named = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.raise_error(F.lit("proteome without an id")).cast("string"))
    rows = p.select(named.alias("proteome_id"), _integer(F.col("taxonomy.taxonId")).alias("taxid"), F.col("taxonomy.scientificName").alias("organism"), F.col("proteomeType").alias("proteome_type"), reviewed.alias("swissprot"), total.alias("swissprot_trembl"), _integer(F.col("geneCount")).alias("one_seq_per_gene"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in UNIPROT_CATALOG])


def fasta_records(raw: DataFrame, json: str = "json") -> DataFrame:
    """raw_header and sequence of gene-centric objects; those without a canonical sequence go."""
    p = raw.select(F.from_json(json, GENE).alias("g")).select("g.canonicalProtein.*")
    kind = F.lower(F.coalesce("entryType", F.lit("")))
    database = F.when(kind.contains("reviewed") & ~kind.contains("unreviewed"), "sp").otherwise("tr")
    accession = F.coalesce("id", F.lit(""))
    first = F.rtrim(F.concat(database, F.lit("|"), accession, F.lit("|"), F.coalesce(F.nullif(F.col("uniProtkbId"), F.lit("")), accession), F.lit(" "), F.coalesce("proteinName", F.lit(""))))
    given = lambda tag, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(tag), value.cast("string")))
    existence = F.nullif(F.regexp_extract(F.coalesce("proteinExistence", F.lit("")), "^([0-9])", 1), F.lit(""))
    header = F.concat_ws(" ", first, given("OS=", F.col("organism.scientificName")), given("OX=", _integer(F.col("organism.taxonId"))), given("GN=", F.col("geneName")), given("PE=", existence), given("SV=", _integer(F.col("sequenceVersion"))))
    return p.where(F.coalesce(F.col("sequence.value"), F.lit("")) != "").select(header.alias("raw_header"), F.col("sequence.value").alias("sequence"))


def fetched(spark: SparkSession, transport: Transport, endpoint: str, query: str, folder: str) -> DataFrame:
    """All pages of a query as one row an object, column json.

    A page is written as it comes, on the file system that Spark reads (a provider is one stream), so the driver holds one page.
    """
    if files.exists(spark, folder):
        raise FileExistsError(folder)
    for k, page in enumerate(transport.pages(endpoint, query)):
        files.write_bytes(spark, f"{folder}/page-{k:06d}.jsonl", "".join(" ".join(text.splitlines()) + "\n" for text in page).encode())
    rows = spark.read.schema("value string").text(folder).where("value <> ''")
    return rows.withColumnRenamed("value", "json")


def committed_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogues of a folder, the latest first: those whose manifest (name.json, with the MD5 of the file) still holds."""
    held = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.md5("content").alias("md5"), F.when(F.col("path").endswith(".json"), F.col("content").cast("string")).alias("text"))
    manifests = held.where("text is not null").select(F.from_json("text", "name string, md5 string").alias("m")).select("m.name", F.col("m.md5").alias("stated"))
    return held.where("text is null").join(manifests, "name").where("md5 = stated").select("name", "md5").orderBy(F.col("name").desc())


def download_fasta(transport: Transport, query: str, path: str) -> int:
    """Stream FASTA lines to a new file; the number of records, of which there must be one."""
    target, n = Path(path), 0
    aside = target.with_name(f".{target.name}.part")
    if target.exists():
        raise FileExistsError(path)
    with aside.open("w", encoding="utf-8", newline="\n") as out:
        for line in transport.fasta(query):
            out.write(line + "\n")
            n += line.startswith(">")
    if not n:
        aside.unlink()
        raise LookupError(f"no records for {query}")
    aside.rename(target)
    return n


def resolve_taxonomy(transport: Transport, taxid: int) -> tuple[str, str]:
    """(first object, query): of the reference proteome if there is one, else of any."""
    for template in (REFERENCE_TAXONOMY, TAXONOMY):
        query = template.format(taxid)
        for page in transport.pages("proteomes", query):
            if page:
                return page[0], query
    raise LookupError(f"no proteome of taxonomy {taxid}")


def filter_catalog(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose id, organism or taxonomy number holds the text, whatever its case; a blank text keeps all."""
    needle = query.strip().lower()
    if not needle:
        return rows
    number = F.coalesce(F.nullif(F.col("taxid"), F.lit(0)).cast("string"), F.lit(""))
    return rows.where(F.lower(F.concat_ws(" ", "proteome_id", F.coalesce("organism", F.lit("")), number)).contains(needle))
