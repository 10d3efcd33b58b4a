"""FASTA as DataFrames: a splittable scan of records, their normalisation, provenance and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import SPACE, header_description, header_id, illegal_residues, normalized, stop_stripped, upper_cased
from ..operators.classify import labels, namespace, peel

#: File names that a directory is searched for.
PATTERNS = "*.{fasta,fa,fas,fna,fasta.gz,fasta.bz2}"


def _lines(raw: DataFrame) -> DataFrame:
    """Columns of raw, then raw_header and sequence, of records cut at a line feed before '>'."""
    text = F.when(F.col("value").contains("\r"), F.regexp_replace("value", r"\r\n?", "\n")).otherwise(F.col("value"))
    header = F.regexp_extract(text, r"^>?([^\n]*)", 1)
    body = F.when(text.contains("\n"), F.replace(F.substr(text, F.locate("\n", text) + 1), F.lit("\n"), F.lit(""))).otherwise("")
    body = F.when(body.rlike(SPACE), F.regexp_replace(body, SPACE + "+", "")).otherwise(body)
    return raw.select(*[c for c in raw.columns if c != "value"], header.alias("raw_header"), body.alias("sequence"), text.alias("__text"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Number the records of each file in order, from 0, without sorting or shuffling them.

    A record's place in its split comes from its running id. How many records each split has is counted by a
    pass of its own; that table has a row for each split of the scan, of which the driver holds the list anyway,
    so it is sent to all tasks. A blank piece before a file's first header is not a record and gets -1.
    """
    pieces = pieces.withColumn("__id", F.monotonically_increasing_id())
    blank = ~F.col("value").rlike(r"\S")
    splits = pieces.groupBy("source_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__from"), F.min_by(blank.cast("int"), "__id").alias("__blank"))
    order = Window.partitionBy("source_path").orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.select("source_path", "block", (F.sum("n").over(order) - F.col("n") - F.col("__from") - F.first("__blank").over(whole)).alias("__shift"), (F.first("__blank").over(whole) == 1).alias("__after_blank"))
    return pieces.join(F.broadcast(splits), ["source_path", "block"]).withColumn("record_ordinal", F.col("__id") + F.col("__shift")).drop("__id", "__shift")


def read_records(spark: SparkSession, path: str | list[str], *, recursive: bool = False) -> DataFrame:
    """Records of FASTA files (plain, .gz, .bz2 by name): source_path, record_ordinal, raw_header, sequence.

    Only '>' in the first column begins a header; lines end in LF, CRLF or a lone CR; white space inside
    sequences is dropped; a header without a sequence has an empty one; invalid UTF-8 raises. Plain and bzip2
    files are split (one whose lines all end in lone CR comes whole: such line ends are found after splitting).
    """
    reader = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"))
    broken = F.when(~F.is_valid_utf8("value"), F.raise_error(F.concat("source_path", F.lit(": invalid UTF-8"))).cast("boolean"))
    raw = raw.where(F.coalesce(broken, F.lit(True)))
    unified = F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r\n?", "\n")).otherwise(F.col("value"))
    # Only a file's first record keeps its '>' (or lacks it); splits begin behind a separator.
    pieces = raw.select("source_path", "block", F.explode(F.split(unified, "\n>", -1)).alias("value"))
    rows = _numbered(pieces).where("record_ordinal >= 0")
    # Blank lines and the '>' of the first header may come before a file's first record.
    lead = F.regexp_replace("value", r"^(?:[^\S\n]*\n)+(?=>)", "")
    first = F.col("record_ordinal") == 0
    made = _lines(rows.withColumn("value", F.when(first, lead).otherwise(F.col("value"))))
    made = made.withColumn("__headed", F.col("__text").startswith(">") | F.col("__after_blank"))
    wrong = F.when(first & ~F.col("__headed"), F.raise_error(F.concat("source_path", F.lit(": content before the first header"))).cast("boolean"))
    return made.where(F.coalesce(wrong, F.lit(True))).select("source_path", "record_ordinal", "raw_header", "sequence")


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw headers without their sequences: only the lines that begin with '>' leave the scan, which splits by lines."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    lines = raw.select("source_path", F.explode(F.split("value", "\r", -1)).alias("line")).where(F.col("line").startswith(">"))
    return lines.select("source_path", F.substr("line", F.lit(2)).alias("raw_header"))


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    """Records of a FASTA literal, in order; blank lines before the first header don't count."""
    lead = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"^(?:[^\S\n]*\n)+(?=>)", "")
    rows = spark.createDataFrame([(text,)], "value string").select(F.posexplode(F.split(lead, "\n>", -1)).alias("pos", "value"))
    made = _lines(rows.select(F.lit("<text>").alias("source_path"), F.col("pos").cast("bigint").alias("record_ordinal"), "value"))
    first = F.col("record_ordinal") == 0
    blank = first & (F.trim(F.regexp_replace("__text", r"\s+", "")) == "")
    wrong = F.when(first & ~F.col("__text").startswith(">") & ~blank, F.raise_error(F.lit("<text>: content before the first header")).cast("boolean"))
    return made.where(F.coalesce(wrong, F.lit(True)) & ~blank).select("source_path", "record_ordinal", "raw_header", "sequence")


def proteins(records: DataFrame) -> DataFrame:
    """Add id, description and the normalised sequence; keeps raw_header and provenance."""
    return records.select(
        "source_path",
        "record_ordinal",
        "raw_header",
        header_id(F.col("raw_header")).alias("id"),
        header_description(F.col("raw_header")).alias("description"),
        normalized(F.col("sequence")).alias("sequence"),
        upper_cased(F.col("sequence")).alias("upper_cased"),
        stop_stripped(F.col("sequence")).alias("terminal_stop_stripped"),
    )


def basic_frame(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return proteins(read_records(spark, path)).select("id", "description", "sequence")


def diagnosed(rows: DataFrame) -> DataFrame:
    """Add namespace, classifications and illegal residues to proteins."""
    rows = rows.withColumn("__peeled", peel(F.col("id")))
    return rows.select("*", namespace(F.col("__peeled.bare")).alias("namespace"), labels(F.col("__peeled")).alias("classifications"), illegal_residues(F.col("sequence")).alias("illegal_residues")).drop("__peeled")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of the exact bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def discover(spark: SparkSession, directory: str, *, recursive: bool = True, most_bytes: int | None = None, since: str | None = None) -> DataFrame:
    """FASTA files of a directory: path, bytes, modified, build_date; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", PATTERNS).load(directory).select("path", "length", "modificationTime")
    files = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), build_date(F.col("path"), F.col("modificationTime")).alias("build_date"))
    if most_bytes is not None:
        files = files.where(F.col("bytes") < most_bytes)
    if since is not None:
        files = files.where(F.col("build_date") >= F.lit(since).cast("date"))
    return files.orderBy("path")


def build_date(path: Column, modified: Column) -> Column:
    """The last valid YYYYMMDD token of the file name, else the date of its modification."""
    tokens = F.split(F.regexp_extract(path, r"([^/]*)$", 1), "[_.]")
    dates = F.array_compact(F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]{8}$")), lambda t: F.try_to_date(t, "yyyyMMdd")))
    return F.coalesce(F.try_element_at(dates, F.lit(-1)), F.to_date(modified))


def file_name_parts(name: Column, config_decoy: str = "d", config_entrapment: str = "e") -> Column:
    """A struct of database name, date, decoy and entrapment flags of a FASTA file name."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.(?:fasta|fa|fas|fna)(?:\.gz|\.bz2)?$", ""), "^R_", "")
    tokens = F.split(bare, "_")
    valid = F.transform(tokens, lambda t: F.coalesce(t.rlike("^[0-9]{8}$") & F.try_to_date(t, "yyyyMMdd").isNotNull(), F.lit(False)))
    dates = F.filter(tokens, lambda t: F.coalesce(t.rlike("^[0-9]{8}$") & F.try_to_date(t, "yyyyMMdd").isNotNull(), F.lit(False)))
    last = F.try_element_at(dates, F.lit(-1))
    at = F.size(valid) - F.array_position(F.reverse(valid), True)
    rest = F.filter(tokens, lambda t, i: ~((i == at) & last.isNotNull()) & ~t.isin(config_decoy, config_entrapment))
    return F.struct(
        F.array_join(rest, "_").alias("database"), F.try_to_date(last, "yyyyMMdd").alias("date"), F.array_contains(tokens, config_decoy).alias("is_decoy"), F.array_contains(tokens, config_entrapment).alias("is_entrapment")
    )
