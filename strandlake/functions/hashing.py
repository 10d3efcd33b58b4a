"""BLAKE2b-128 digests, which Spark has no function for: vectorised Arrow functions and streamed fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def blake2b_128(text: Column) -> Column:
    """The 16-byte digest of a text's UTF-8 bytes; null stays null."""

    @arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _digest(t.encode()) for t in texts.to_pylist()], pa.binary())

    return run(text)


def sequence_hash(sequence: Column) -> Column:
    """Digest of an ASCII sequence, case kept; other characters raise."""
    checked = F.when(sequence.rlike(r"^\p{ASCII}*$") | sequence.isNull(), sequence).otherwise(F.raise_error(F.lit("sequence must be ASCII")).cast("string"))
    return blake2b_128(checked)


def peptide_id(sequence: Column) -> Column:
    return F.concat(F.lit("pep|"), F.lower(F.hex(sequence_hash(sequence))))


def description_hash(description: Column) -> Column:
    return blake2b_128(F.nullif(F.trim(F.regexp_replace(description, r"(?U)\s+", " ")), F.lit("")))


def pair_fingerprint(identifier: Column, digest: Column) -> Column:
    """The content fingerprint of one id and the digest of its sequence."""

    @arrow_udf("binary")
    def run(ids: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array([_digest(i.encode() + b"\0" + d + b"\n") for i, d in zip(ids.to_pylist(), digests.to_pylist(), strict=True)], pa.binary())

    return run(identifier, digest)


def ordered_fingerprint(rows: DataFrame, group: list[str], columns: list[str], *, separator: bytes = b"\0", distinct: bool = True) -> DataFrame:
    """Per group, BLAKE2b-128 over its distinct rows in byte order, each row's values joined and ended by a line feed.

    Groups are dealt whole to partitions and streamed in order, so memory does not grow with a group.
    """
    rows = rows.select(*group, *columns).dropna(subset=columns)
    rows = rows.dropDuplicates() if distinct else rows
    dealt = rows.repartition(*group).sortWithinPartitions(*group, *columns)
    width = len(group)
    names = [*group, "fingerprint"]
    schema = ", ".join([f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group] + ["fingerprint binary"])
    arrow_types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, types = None, None, arrow_types

        def row(key: tuple, digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), pa.array([digest.digest()], pa.binary())], names)

        for batch in batches:
            types = [c.type for c in batch.columns[:width]]
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[:width] != key:
                    if key is not None:
                        yield row(key, digest)
                    key, digest = values[:width], hashlib.blake2b(digest_size=16)
                digest.update(separator.join(v if isinstance(v, bytes) else str(v).encode() for v in values[width:]) + b"\n")
        if key is not None:
            yield row(key, digest)

    from ..session import ship

    ship(rows.sparkSession)
    return dealt.mapInArrow(run, schema)
