"""Shared ground of the corpus operators: tables, checkpoints, row keys and Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, checkpointed, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written rows."""
    return checkpointed(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that no letter changes its width or its place."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What a worker process keeps from task to task: by operator, how it lets go of that.
KEPT: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Give memory that this process has freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if (back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        back(0)


def let_go(keeps: str | None) -> None:
    """Drop what other operators than `keeps` have left in this worker, which goes on to serve later stages."""
    for name, drop in KEPT.items():
        if name != keeps:
            drop()
    trim()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *, keeps: str | None = None) -> DataFrame:
    """mapInArrow, after this package has been sent to the executors; batches are bounded by bytes, since rows hold whole texts.

    A worker holds what it keeps for `keeps` only, and gives back what a task has freed when the task ends.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from run(batches)
        trim()

    return df.mapInArrow(held, schema)


def blocks(texts: list, limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Rows of a value that is frequent, at least (and a thousandth of all rows, so that there are few such), and tasks they are dealt to.
FREQUENT, SALT = 10_000, 32


def spread_join(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Left join of rows with names (one row a value of `on`); the rows of a frequent value are dealt to SALT tasks.

    The frequent values, each of a thousandth of all rows at least, are sent to all tasks: a thousand at most.
    """
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    frequent = F.broadcast(counts.where(F.col("__n") >= max(FREQUENT, rows.count() // 1000)).select(on, F.lit(SALT).alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    salted = rows.join(frequent, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("__salts")
    spread = names.join(frequent, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return salted.join(spread, [on, "__salt"], "left").drop("__salt")
