"""New logs are decoded as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import decode_logs

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, table: str = "events", pattern: str = "*.binlog", once: bool = True, skip_bad: bool = True) -> StreamingQuery:
    """A log that can't be opened doesn't stop the stream (skip_bad): it is in the table `failures`. Append the rows of logs that come into folder to a Parquet table; once: those there now, then stop."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    query = decode_logs(files, table, root=folder, skip_bad=skip_bad).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if table == "events":
        query = query.partitionBy("kind")
    return query.trigger(availableNow=True).start() if once else query.start()
