"""Header formats: detection counts, diagnostics, and row-wise or whole-file enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CLASSIFIERS, FORMATS, Classifier, HeaderColumn, HeaderFormat, java
from ..functions.sequences import extract
from .classify import labels, peel

TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def value_of(column: HeaderColumn, header: Column) -> Column:
    if column.value is not None:
        return F.lit(column.value).cast(TYPES[column.kind])
    return extract(java(column.pattern), header, column.kind, dict(column.values) if column.values else None)


def validate(formats: tuple[HeaderFormat, ...], classifiers: tuple[Classifier, ...]) -> dict[str, str]:
    """Output columns and their types; a name may come again only with the same type and never as a classifier's."""
    out: dict[str, str] = {}
    for column in (c for f in formats for c in f.columns):
        if out.setdefault(column.name, TYPES[column.kind]) != TYPES[column.kind]:
            raise ValueError(f"column {column.name} has different types in different formats")
    if clash := {f"is_{c.name}" for c in classifiers} & out.keys():
        raise ValueError(f"format and classifier columns clash: {sorted(clash)}")
    return out


def working_header(rows: DataFrame, classifiers: tuple[Classifier, ...]) -> DataFrame:
    """Add __labels and __header (bare identifier and description)."""
    rows = rows.withColumn("__peeled", peel(F.col("id"), classifiers))
    return rows.select("*", labels(F.col("__peeled"), classifiers).alias("__labels"), F.concat_ws(" ", F.col("__peeled.bare"), "description").alias("__header")).drop("__peeled")


def match_counts(rows: DataFrame, formats: tuple[HeaderFormat, ...] = FORMATS, classifiers: tuple[Classifier, ...] = CLASSIFIERS) -> dict[str, int]:
    """Rows that each format's detection pattern matches, and all rows under ''; one row comes to the driver."""
    worked = working_header(rows, classifiers)
    found = worked.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("__header").rlike(java(f.detection))).alias(f"m{k}") for k, f in enumerate(formats)]).first()
    return {"": found["n"]} | {f.name: found[f"m{k}"] for k, f in enumerate(formats)}


def diagnostics(rows: DataFrame, formats: tuple[HeaderFormat, ...] = FORMATS, classifiers: tuple[Classifier, ...] = CLASSIFIERS) -> DataFrame:
    """Columns format, matched_rows, total_rows, status (no_match, selected, ambiguous, partial)."""
    worked = working_header(rows, classifiers)
    counts = worked.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col("__header").rlike(java(f.detection))).alias(f"m{k}") for k, f in enumerate(formats)])
    whole = sum(((F.col(f"m{k}") == F.col("total_rows")) & (F.col("total_rows") > 0)).cast("int") for k in range(len(formats)))
    listed = F.explode(F.array(*[F.struct(F.lit(f.name).alias("format"), F.col(f"m{k}").alias("matched_rows")) for k, f in enumerate(formats)]))
    rows = counts.select("total_rows", whole.alias("whole"), listed.alias("f")).select("f.*", "total_rows", "whole")
    complete = (F.col("matched_rows") == F.col("total_rows")) & (F.col("total_rows") > 0)
    status = F.when(F.col("matched_rows") == 0, "no_match").when(complete & (F.col("whole") == 1), "selected").when(complete, "ambiguous").otherwise("partial")
    return rows.select("format", "matched_rows", "total_rows", status.alias("status"))


def enrich(rows: DataFrame, formats: tuple[HeaderFormat, ...] = FORMATS, classifiers: tuple[Classifier, ...] = CLASSIFIERS, *, strict: bool = False, static_schema: bool = False) -> DataFrame:
    """Add classifier flags and the columns of the format that fits each row (strict: all rows).

    A row that several formats fit gets none. Formats that no row uses add no columns, and if none is used
    only the input's columns are returned; `static_schema` keeps all columns and needs no pass for that.
    """
    kinds = validate(formats, classifiers)
    base = rows.columns
    worked = working_header(rows, classifiers)
    fits = [F.col("__header").rlike(java(f.detection)) for f in formats]
    alone = sum(m.cast("int") for m in fits) == 1
    if strict:
        counts = match_counts(rows, formats, classifiers)
        whole = [f for f in formats if counts[f.name] == counts[""] > 0]
        used = whole if len(whole) == 1 else []
        chosen = {f.name: F.lit(True) for f in used}
    else:
        chosen = {f.name: m & alone for f, m in zip(formats, fits, strict=True)}
        used = list(formats)
        if not static_schema:
            seen = worked.agg(*[F.max(chosen[f.name].cast("int")).alias(f.name) for f in formats]).first()
            used = [f for f in formats if seen[f.name]]
    if not used and not static_schema:
        return rows
    flags = [F.array_contains("__labels", c.name).alias(f"is_{c.name}") for c in classifiers]
    names = list(kinds) if static_schema else list(dict.fromkeys(c.name for f in used for c in f.columns))
    made = []
    for name in names:
        value = F.lit(None).cast(kinds[name])
        for f in used:
            for column in (c for c in f.columns if c.name == name):
                found = value_of(column, F.col("__header"))
                if column.required:
                    missing = F.raise_error(F.lit(f"{f.name}: required column {name} has no value")).cast(kinds[name])
                    found = F.coalesce(found, missing)
                value = F.when(chosen[f.name], found).otherwise(value)
        made.append(value.alias(name))
    return worked.select(*base, *flags, *made)
