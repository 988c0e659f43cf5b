"""Logs to tables: batch and streaming ingest, and a data source.

A log is one gzip stream with running dictionaries, so it is one task's work; logs are
decoded side by side, and after that all tables are columnar.

A log's id is its path under the folder that is read (a build tool gives all its logs
one name, so names tell no logs apart); of a single file, its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .codec import Log, LogError
from .layout import SCHEMAS

BATCH_ROWS = 5000


def rows_of(table: str, log_id: str, path: str, content: bytes, strict: bool = False) -> Iterator[dict]:
    """The rows that a log adds to a table; failures has one for a log that can't be opened."""
    if table == "failures":
        try:
            Log(content)
        except LogError as e:
            yield {"log_id": log_id, "path": path, "error": str(e)}
        return
    log = Log(content)
    if table == "events":
        rows = log.events(strict)
    elif table == "logs":
        rows = iter([{"path": path, "file_format_version": log.version, "min_reader_version": log.min_reader}])
    elif table == "strings":
        rows = ({"string_id": 10 + k, "value": s} for k, s in enumerate(log.tables.strings))
    elif table == "name_values":
        rows = ({"nvl_id": 10 + k, "pos": p, **pair} for k in range(len(log.tables.lists)) for p, pair in enumerate(log.tables.pairs(10 + k)))
    elif table == "archives":
        rows = ({"archive_no": k, "content": a} for k, a in enumerate(log.archives))
    else:
        rows = log.archive_files()
    for row in rows:
        yield {"log_id": log_id, **row}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def log_id(path: str, root: str | None) -> str:
    """The path under the root, without a scheme; its last part if it is the root, and all of it if it isn't under it."""
    bare = lambda p: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", p).rstrip("/")
    path = bare(path)
    if root is None:
        return path
    root = bare(root)
    return path.rpartition("/")[2] if path == root else path.removeprefix(root + "/")


def decode_logs(files: DataFrame, table: str = "events", strict: bool = False, root: str | None = None, skip_bad: bool = False) -> DataFrame:
    """A table from files (path, content), as spark.read.format("binaryFile") gives them; ids are paths under root.

    A log that can't be opened is an error, or, with skip_bad, has rows in the table `failures` alone.
    """
    schema = StructType.fromDDL(SCHEMAS[table])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if skip_bad and any(rows_of("failures", "", path, content)):
                    rows = rows_of("failures", log_id(path, root), path, content) if table == "failures" else iter(())
                else:
                    rows = rows_of(table, log_id(path, root), path, content, strict)
                yield from _batches(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_logs(spark: SparkSession, path: str, table: str = "events", strict: bool = False, skip_bad: bool = False) -> DataFrame:
    """A table of a log, or of all logs in a folder and those in it."""
    return decode_logs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), table, strict, path, skip_bad)


def ingest(events: DataFrame, path: str) -> None:
    """Write an events table for queries: partitioned by kind, which nearly every query filters by, with logs together and in order inside."""
    events.repartition("log_id", "kind").sortWithinPartitions("log_id", "event_index").write.partitionBy("kind").mode("overwrite").parquet(path)


class BuildLogSource(DataSource):
    """spark.read.format("buildlog").option("table", "events").load(path): a task for each log."""

    @classmethod
    def name(cls) -> str:
        return "buildlog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "events")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.table, self.strict, self.root = options.get("table", "events"), options.get("strict", "false").lower() == "true", options["path"]
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        found = system.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(i.path) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        with system.open_input_stream(partition.value, compression=None) as file:
            content = file.read()
        yield from _batches(rows_of(self.table, log_id(partition.value, self.root), partition.value, content, self.strict), self.arrow)
