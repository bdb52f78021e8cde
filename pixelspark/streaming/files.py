"""Files that arrive in a folder as a stream: every operator that works row by row runs unchanged on it.

A file is one row, so image operators need no watermark and keep no state. ``binaryFile`` streams a folder in
micro-batches; what was read is kept in the query's checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, *, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive."""
    return spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def run_to_table(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """``work`` over the stream, written as Parquet, each file's rows exactly once."""
    writer = work(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
