"""Session settings for local work; on a cluster the session comes from the launcher."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, *, memory: str = "12g", partitions: int | None = None, app: str = "strandlake") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not share a folder with the driver.

    Once a context; the archive holds the package's sources only (some hundred KB).
    """
    context = spark.sparkContext
    if getattr(context, "_strandlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandlake-code-")) / "strandlake_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")) + sorted(root.rglob("*.json")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._strandlake_shipped = True


#: The session's bound on an Arrow batch, and the bytes that are set where the session names none.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for rows that hold whole texts or parts of a table."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; only a local session that names none (tests) gets one of its own."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
