"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs in one process (local mode), a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewell-"))
            known = spark.sparkContext.getCheckpointDir()
        folder = known
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tracewell-{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written as Parquet into the shared folder and read again: its lineage ends there, and any executor can read it.

    Shuffle files of the frame, which nothing else reads, are deleted after it.
    """
    spark, key = frame.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = new_path(spark, name), spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(frame.schema).parquet(path)


def drop(frame: DataFrame) -> None:
    """Delete a table made by written() that no later query reads."""
    spark = frame.sparkSession
    for file in {f.rpartition("/")[0] for f in frame.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
