"""Database assembly: prepared sources, ordered groups, first-wins deduplication, inventories and search databases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sequence_hash
from ..functions.sequences import header_description, header_id, illegal_message, illegal_residues, leucine_for_isoleucine, normalized, stop_stripped, upper_cased
from ..session import checkpointed
from ..sources.tables import PROTEIN_INVENTORY, SEARCH_INVENTORY

#: The sequence of sentinels and markers, which are no proteins.
MARKER_SEQUENCE = "WWWWWWWWWW"


def prepared(records: DataFrame, *, source_order: int, source_id: str, role: str = "target", block_name: str | None = None, block_description: str | None = None) -> DataFrame:
    """Canonical input rows of one source; an empty sequence raises."""
    sequence = normalized(F.col("sequence"))
    checked = F.when(sequence == "", F.raise_error(F.concat(F.lit(f"{source_id}: empty sequence of "), "raw_header")).cast("string")).otherwise(sequence)
    text = lambda v: F.lit(v).cast("string")
    return records.select(
        F.lit(source_order).cast("bigint").alias("source_order"), F.col("record_ordinal").alias("record_order"), text(source_id).alias("source_id"), text(role).alias("role"), text(block_name).alias("block_name"), text(block_description).alias("block_description"),
        "raw_header", header_id(F.col("raw_header")).alias("id"), header_description(F.col("raw_header")).alias("description"), checked.alias("sequence"), upper_cased(F.col("sequence")).alias("upper_cased"), stop_stripped(F.col("sequence")).alias("terminal_stop_stripped"),
    )


def legal(rows: DataFrame, source: str) -> DataFrame:
    """Rows whose sequences have residues of the alphabet only; others raise."""
    message = F.concat(F.lit(f"{source}: illegal residues in "), "id", F.lit(": "), F.coalesce(illegal_message(illegal_residues(F.col("sequence"))), F.lit("")))
    bad = illegal_residues(F.col("sequence")) != ""
    return rows.withColumn("sequence", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("sequence")))


def first_wins(rows: DataFrame, *, key: str = "id", order: list[str], conflict: str | None = "sequence") -> DataFrame:
    """The first row of each key in order; a key with different values of `conflict` raises.

    Map-side: the least row of each key is kept, so repeated rows of a hot key are reduced before the shuffle.
    """
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    if conflict is None:
        return rows.groupBy(key).agg(first).select(key, "r.*").select(*rows.columns)
    kept = rows.groupBy(key).agg(first, F.min(conflict).alias("__a"), F.max(conflict).alias("__b"))
    checked = F.when(F.col("__a") != F.col("__b"), F.raise_error(F.concat(F.lit(f"conflicting {conflict} of "), key)).cast(rows.schema[key].dataType)).otherwise(F.col(key))
    return kept.select(checked.alias(key), "r.*").select(*rows.columns)


def assembled(groups: list[tuple[str, DataFrame]], order: list[str]) -> DataFrame:
    """Union of ordered groups with their kind, first id wins, numbered from 0 in order (final_order).

    The numbers are row counts of ranges plus places in them, so no task sorts all rows.
    """
    rows = None
    for k, (kind, group) in enumerate(groups):
        part = group.withColumn("kind", F.lit(kind)).withColumn("__group", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return numbered(first_wins(rows, order=["__group", *order]), ["__group", *order]).drop("__group")


def numbered(rows: DataFrame, order: list[str], name: str = "final_order") -> DataFrame:
    """Add consecutive numbers from 0 in an order.

    The sorted rows are written once; a row's place in its range comes from its running id, and a sum over
    ranges (one row each) gives the ranges' first numbers.
    """
    ordered = checkpointed(rows.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("__range", F.shiftright("__at", 33))
    sizes = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    return ordered.join(starts, "__range").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__range", "__start")


def inventory(rows: DataFrame) -> DataFrame:
    """The canonical inventory of assembled rows."""
    hashed = rows.withColumn("sequence_hash", F.lower(F.hex(sequence_hash(F.col("sequence")))))
    kinds = {f.name: f.dataType for f in PROTEIN_INVENTORY}
    return hashed.select(*[(F.col(n) if n in hashed.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def search_inventory(biological: DataFrame, decoys: DataFrame, strategy: str) -> DataFrame:
    """Biological rows, then decoys numbered after them with the rows they come from.

    `decoys` has final_order of the source row, raw_header, id, sequence.
    """
    last = biological.agg((F.max("final_order") + 1).alias("__from"))  # one row
    rows = decoys.crossJoin(last)
    sources = biological.select(F.col("final_order").alias("decoy_source_order"), F.col("id").alias("decoy_source_id"), F.col("kind").alias("decoy_source_kind"))
    rows = rows.withColumn("decoy_source_order", F.col("final_order")).join(sources, "decoy_source_order").withColumn("final_order", F.col("__from") + F.col("decoy_source_order"))
    rows = rows.withColumns({"kind": F.lit("decoy"), "decoy_strategy": F.lit(strategy), "sequence_hash": F.lower(F.hex(sequence_hash(F.col("sequence")))), "description": header_description(F.col("raw_header"))})
    both = biological.unionByName(rows.select(*[c for c in rows.columns if c in SEARCH_INVENTORY.names]), allowMissingColumns=True)
    return both.select(*[(F.col(f.name) if f.name in both.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SEARCH_INVENTORY])


def inventory_of(inputs: DataFrame) -> DataFrame:
    """The inventory of canonical input rows: targets, then contaminants with their block as group; first ids win."""
    rows = inputs.withColumnRenamed("role", "source_role")
    groups = []
    for kind in ("target", "contaminant"):
        group = F.coalesce("block_name", F.lit("unlabelled")) if kind == "contaminant" else F.lit(None).cast("string")
        groups.append((kind, legal(rows.where(F.col("source_role") == kind).withColumn("contaminant_group", group), kind)))
    return inventory(assembled(groups, ["source_order", "record_order"]))


def packaged(inventory: DataFrame, database: str, date: str, description: str = "") -> DataFrame:
    """Records of a database in file order: a sentinel, targets, a marker before each block of contaminants, entrapment.

    Columns order (section, block, place), raw_header, sequence. Sentinels and markers have a sequence of their own.
    """
    spark = inventory.sparkSession
    section = F.when(F.col("kind") == "target", 1).when(F.col("kind") == "contaminant", 2).otherwise(3)
    rows = scientific(inventory).select(section.alias("section"), F.when(F.col("kind") == "contaminant", F.coalesce("contaminant_group", F.lit("unlabelled"))).otherwise("").alias("block"), F.col("final_order").alias("place"), "raw_header", "sequence")
    marker = lambda block: F.concat(F.lit("aa|Cont_"), block, F.lit(f"|{database}"))
    markers = rows.where("section = 2").select("section", "block").distinct().select("section", "block", F.lit(-1).cast("bigint").alias("place"), marker(F.col("block")).alias("raw_header"), F.lit(MARKER_SEQUENCE).alias("sequence"))
    sentinel = spark.createDataFrame([(0, "", -1, sentinel_header(database, date, description), MARKER_SEQUENCE)], "section int, block string, place bigint, raw_header string, sequence string")
    return sentinel.union(markers).union(rows)


def without_packaging(rows: DataFrame) -> DataFrame:
    """Rows that are neither sentinels nor decoys."""
    return rows.where(~F.col("kind").isin("sentinel", "decoy"))


def scientific(rows: DataFrame) -> DataFrame:
    """Targets, contaminants and entrapment."""
    return rows.where(F.col("kind").isin("target", "contaminant", "entrapment"))


def without_decoys(rows: DataFrame) -> DataFrame:
    """The rows; a decoy among them raises."""
    decoy = F.when(F.col("kind") == "decoy", F.raise_error(F.concat(F.lit("has decoys already: "), "id")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(decoy)


def derived_counts(inventory: DataFrame) -> DataFrame:
    """kind, n, kept: what derived_input keeps and drops of an inventory."""
    return inventory.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.col("kind").isin("target", "contaminant"))


def leucine_targets(rows: DataFrame) -> DataFrame:
    """Sequences with leucine for isoleucine, which weigh the same."""
    return rows.withColumn("sequence", leucine_for_isoleucine(F.col("sequence")))


def annotated(inventory: DataFrame, note: str) -> DataFrame:
    """The inventory whose first row's header tells how its decoys were made."""
    return inventory.withColumn("raw_header", F.when(F.col("final_order") == 0, F.concat("raw_header", F.lit(f"; {note}"))).otherwise(F.col("raw_header")))


def derived_input(inventory: DataFrame, *, source_order: int, source_id: str, foreign: bool = False) -> DataFrame:
    """Input rows of an inventory: sentinels, entrapment and decoys go; contaminants keep their group as block."""
    role = F.when(F.lit(foreign), "foreign").otherwise(F.col("kind"))
    block = F.when(F.col("kind") == "contaminant", F.coalesce("contaminant_group", F.lit("derived-contaminants")))
    return inventory.where(F.col("kind").isin("target", "contaminant")).select(
        F.lit(source_order).cast("bigint").alias("source_order"), F.col("final_order").alias("record_order"), F.lit(source_id).alias("source_id"), role.alias("role"), block.alias("block_name"), F.lit(None).cast("string").alias("block_description"),
        "raw_header", "id", "description", "sequence", F.lit(False).alias("upper_cased"), F.lit(False).alias("terminal_stop_stripped"),
    )


def sentinel_header(database: str, date: str, description: str, provenance: str = "") -> str:
    return ", ".join(p for p in (f"aa|{database}|{date} {description}".strip(), provenance) if p)


def marker_header(block: str, database: str, description: str = "") -> str:
    return f"aa|Cont_{block}|{database} {description}".strip()


def sentinel_metadata(raw_header: Column) -> Column:
    """A struct of database, date and description of a sentinel header; null for any other header and for markers."""
    fields = F.split(raw_header, r"\|", 3)
    ok = raw_header.startswith("aa|") & (F.size(fields) == 3) & ~F.get(fields, F.lit(1)).startswith("Cont_")
    rest = F.get(fields, F.lit(2))
    date = F.try_to_date(F.nullif(F.regexp_extract(rest, "^([0-9]{8})", 1), F.lit("")), "yyyyMMdd")
    return F.when(ok, F.struct(F.get(fields, F.lit(1)).alias("database"), date.alias("date"), F.trim(F.regexp_replace(rest, "^[0-9]{8}", "")).alias("description")))


def sentinel_column(database: Column, date: Column, description: Column) -> Column:
    """The sentinel header of columns."""
    return F.concat(F.lit("aa|"), database, F.lit("|"), F.rtrim(F.concat_ws(" ", date, description)))


def decoy_annotation(note: Column) -> Column:
    """A struct of mode and seed of an annotation such as `decoys (shuffle) seed (7)`; nulls where there is none."""
    part = lambda k: F.nullif(F.regexp_extract(note, r"decoys \(([a-z_]+)\)(?: seed \(([0-9]+)\))?", k), F.lit(""))
    return F.struct(part(1).alias("mode"), part(2).cast("bigint").alias("seed"))


def rendered_name(template: str, **fields: Column) -> Column:
    """A name of a template whose fields are in braces: a blank field goes together with the separator before it."""
    out, rest = F.lit(""), template
    for name in re.findall(r"\{(\w+)\}", template):
        before, _, rest = rest.partition("{" + name + "}")
        value = F.trim(fields[name])
        out = F.concat(out, F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(before), value)))
    return F.concat(out, F.lit(rest))
