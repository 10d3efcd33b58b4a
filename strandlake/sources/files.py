"""Small files on whatever file system Spark reads: through Hadoop's, so that no folder of the driver is meant by accident."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names (a temporary one only where none is, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandlake-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def write_bytes(spark: SparkSession, path: str, content: bytes, *, replace: bool = False) -> None:
    """A new file, written aside and moved into place; an existing one raises unless it may be replaced."""
    fs, at = _at(spark, path)
    if fs.exists(at) and not replace:
        raise FileExistsError(path)
    aside = at.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if replace:
        fs.delete(at, True)
    fs.rename(aside, at)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _at(spark, source)
    if not fs.exists(at):
        raise FileNotFoundError(source)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def joined(spark: SparkSession, parts: list[str], target: str) -> None:
    """A new file of the bytes of others, one behind the other; they run through a buffer, so no task and no memory holds them."""
    fs, at = _at(spark, target)
    out = fs.create(at, False)
    try:
        for part in parts:
            source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(part))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def publish(spark: SparkSession, staged: dict[str, str]) -> None:
    """Move staged paths to their targets together: if one can't be moved, those before it are moved back.

    Targets must differ (also when case does not count) and must not exist.
    """
    targets = list(staged.values())
    if len({t.casefold() for t in targets}) != len(targets):
        raise ValueError(f"targets must differ: {targets}")
    if taken := [t for t in targets if exists(spark, t)]:
        raise FileExistsError(", ".join(taken))
    done: list[tuple[str, str]] = []
    try:
        for source, target in staged.items():
            move(spark, source, target)
            done.append((source, target))
    except Exception:
        for source, target in reversed(done):
            move(spark, target, source)
        raise


def manifest(spark: SparkSession, path: str, *, schema_name: str, schema_version: str = "1", rows: int | None = None) -> DataFrame:
    """One row a file of an artifact: schema, name, MD5 of its bytes, bytes, and the rows of the artifact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.lit(schema_name).alias("schema_name"), F.lit(schema_version).alias("schema_version"), relative_path(F.col("path"), F.lit(path)).alias("path"),
        F.md5("content").alias("md5"), F.col("length").alias("bytes"), F.lit(rows).cast("bigint").alias("rows"),
    )


def relative_path(path, root):
    """A path below a root, else its last name; schemes such as file: don't count."""
    bare = lambda c: F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*:/*(?=/)", "")
    p, r = bare(path), F.concat(F.regexp_replace(bare(root), "/+$", ""), F.lit("/"))
    return F.when(p.startswith(r), F.substr(p, F.length(r) + 1)).otherwise(F.regexp_extract(p, "([^/]*)$", 1))


def stamped(folder: str, at, suffix: str = "") -> str:
    """The name of a snapshot taken at a UTC time; such names sort by time."""
    return f"{folder.rstrip('/')}/snapshot-{at:%Y%m%dT%H%M%S%fZ}{suffix}"


def snapshots(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Snapshots of a folder, the oldest first; those with another suffix don't count."""
    ending = f"Z{suffix}"
    return [f"{folder.rstrip('/')}/{n}" for n in names(spark, folder) if n.startswith("snapshot-") and n.endswith(ending)]


def superseded(spark: SparkSession, folder: str, keep: int, suffix: str = "") -> list[str]:
    """Snapshots that the `keep` latest ones supersede."""
    if keep < 1:
        raise ValueError("at least one snapshot must be kept")
    return snapshots(spark, folder, suffix)[:-keep]
