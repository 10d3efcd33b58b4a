"""Incremental indexing as a stream of FASTA files: each micro-batch indexes the files that arrived.

An extension of the registry's updates: files are found by the stream's own log, each batch replaces the
partitions of its databases (so a batch that is run again changes nothing), and statistics follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import entries_of, refresh, write_entries
from ..sources.fasta import PATTERNS, proteins, read_records


def stream_index(spark: SparkSession, directory: str, root: str, checkpoint: str, *, files_a_batch: int = 1000) -> StreamingQuery:
    """Index what is in the directory and end; started again, it goes on with what came since."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", PATTERNS).option("maxFilesPerTrigger", str(files_a_batch)).load(directory)
    # Only the path is asked for, so no content is read here.
    paths = files.select("path")

    def index(batch: DataFrame, _: int) -> None:
        # One name a file of this batch, of which there are at most files_a_batch.
        found = [r["path"] for r in batch.distinct().collect()]
        if found:
            write_entries(entries_of(proteins(read_records(batch.sparkSession, found))), root)
            refresh(batch.sparkSession, root)

    return paths.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
