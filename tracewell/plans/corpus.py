"""Build logs made from the driver's tables, so that every query runs on decoded logs and has an SQL oracle on the tables.

A: one event for each row of events, dealt to eight logs. B: a build of projects, targets and
tasks for the customers, their orders and lines, in forty logs.
C: an archive and messages for documents, a log for each source.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.codec import Writer
from ..sources.ingest import decode_logs

A_LOGS, B_LOGS = 8, 40
WRITERS = 64  # tasks that logs are dealt to, so that those with several logs don't hold up the rest
EPOCH_TICKS = 621355968000000000


def _ticks(c: str) -> str:
    """100 ns since year 1 of a timestamp without zone, whatever the session's zone."""
    return f"{EPOCH_TICKS} + (datediff(cast({c} as date), date'1970-01-01') * 86400L + hour({c}) * 3600 + minute({c}) * 60) * 10000000 + cast(extract(second from {c}) * 10000000 as bigint)"


def _ctx(project: str, target: str, task: str) -> str:
    return f"named_struct('node_id', 1, 'project_context_id', cast({project} as int), 'target_id', cast({target} as int), 'task_id', cast({task} as int), 'submission_id', 0, 'project_instance_id', 0, 'evaluation_id', 0)"


def _rows_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = "'CS' || lpad(cast(user_id as string), 4, '0')"
    return e.selectExpr(
        f"concat('a', event_id % {A_LOGS}) as log_id", f"event_id div {A_LOGS} as event_index",
        "case event_type when 'error' then 9 when 'signup' then 10 when 'click' then 11 when 'view' then 12 else 13 end as kind",
        f"case when event_id % 11 <> 0 then {_ctx('user_id % 150', 'event_id % 5', 'event_id % 7')} end as context",
        f"{_ticks('ts')} as ticks", "concat(event_type, ' ', props) as message",
        f"named_struct('diag_code', {code}, 'diag_file', concat('src/f', event_id % 97, '.cs'), 'diag_project_file', concat('p', user_id % 20, '.csproj'), 'diag_line', cast(event_id % 500 as int), 'diag_column', cast(event_id % 80 as int), 'command_line', concat(event_type, ' ', props)) as body",
    )


def _rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"tracewell_{name}")
    pair = lambda k, v: f"named_struct('key', '{k}', 'value', {v})"
    none = "cast(null as string)"
    item = "named_struct('item_spec', concat('o', o_orderkey, '.cs'), 'metadata', array(named_struct('key', 'Priority', 'value', o_orderpriority), named_struct('key', 'Status', 'value', o_orderstatus)))"
    body = lambda **x: "named_struct(" + ", ".join(f"'{k}', {x.get(k, d)}" for k, d in fields.items()) + ") as body"
    pairs, groups = "array<struct<key:string,value:string>>", "array<struct<item_type:string,items:array<struct<item_spec:string,metadata:array<struct<key:string,value:string>>>>>>"
    fields = {
        "of_project": none, "project_id": "cast(null as int)", "target_names": none, "property_list": f"cast(null as {pairs})", "item_list": f"cast(null as {groups})",
        "target_name": none, "task_name": none, "succeeded": "cast(null as boolean)",
    }
    big = "9223372036854775807L"
    return spark.sql(f"""
        with c as (select *, cast(c_custkey % {B_LOGS} as int) as log_no from tracewell_customer),
        o as (select c.log_no, c.c_custkey, o.* from tracewell_orders o join c on o_custkey = c_custkey),
        l as (select o.log_no, o.c_custkey, l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as task
              from tracewell_lineitem l join o on l_orderkey = o_orderkey),
        i as (select c_custkey, array_sort(collect_list(named_struct('k', o_orderkey, 'item', {item}))) as found from o group by c_custkey),
        t as (select log_no, {_ticks("min(o_orderdate)")} as lo, {_ticks("max(o_orderdate)")} as hi from o group by log_no),
        rows as (
            select log_no, 0 as phase, 0L as cust, 0L as ord, 0L as task, 0 as sub, 1 as kind, null as context, lo as ticks, {body()} from t
            union all select log_no, 2, 0L, 0L, 0L, 0, 2, null, hi, {body(succeeded="false")} from t
            union all select log_no, 1, c.c_custkey, -1L, 0L, 0, 3, {_ctx("c.c_custkey + 1", "0", "0")}, null, {body(of_project="concat('p', c.c_custkey % 40, '.csproj')", project_id="cast(c.c_custkey as int)", target_names="case when c_nationkey % 2 = 1 then 'Build' end", property_list=f"array({pair('Name', 'c_name')}, {pair('Segment', 'c_mktsegment')}, {pair('NationKey', 'cast(c_nationkey as string)')}, {pair('Name', 'c_mktsegment')})", item_list=f"array(named_struct('item_type', 'Compile', 'items', transform(coalesce(found, array()), x -> x.item)), named_struct('item_type', 'Reference', 'items', cast(array() as array<struct<item_spec:string,metadata:{pairs}>>)))")} from c left join i on c.c_custkey = i.c_custkey
            union all select log_no, 1, c_custkey, o_orderkey, 0L, 0, 5, {_ctx("c_custkey + 1", "o_orderkey + 1", "0")}, null, {body(target_name="concat('T', o_orderkey)")} from o
            union all select log_no, 1, c_custkey, l_orderkey, task, 0, 7, {_ctx("c_custkey + 1", "l_orderkey + 1", "task")}, null, {body(task_name="concat('L', l_partkey)")} from l
            union all select log_no, 1, c_custkey, l_orderkey, task, 1, 8, {_ctx("c_custkey + 1", "l_orderkey + 1", "task")}, null, {body(succeeded="l_returnflag <> 'R'")} from l where not (l_linestatus = 'O' and l_returnflag = 'A')
            union all select log_no, 1, c_custkey, o_orderkey, {big}, 0, 6, {_ctx("c_custkey + 1", "o_orderkey + 1", "0")}, null, {body(succeeded="o_orderstatus <> 'F'")} from o where o_orderstatus <> 'P'
            union all select log_no, 1, c_custkey, {big}, 0L, 0, 4, {_ctx("c_custkey + 1", "0", "0")}, null, {body(succeeded="true")} from c
        )
        select concat('b', log_no) as log_id, row_number() over (partition by log_no order by phase, cust, ord, task, sub, kind) - 1 as event_index, kind, context, ticks, cast(null as string) as message, body from rows
    """)


def _structs(column: pa.StructArray) -> list[dict | None]:
    """The column's values, without fields that are null in all rows: of a body's fields few are used in a batch."""
    fields = [(f.name, column.field(f.name)) for f in column.type]
    used = [(name, child.to_pylist()) for name, child in fields if child.null_count < len(child)]
    names = [name for name, _ in used]
    found = [dict(zip(names, values, strict=True)) for values in zip(*(v for _, v in used), strict=True)] if used else [{}] * len(column)
    return [x if valid else None for x, valid in zip(found, column.is_valid().to_pylist(), strict=True)]


def encode_events(rows: DataFrame) -> DataFrame:
    """path (the log's id) and content (its bytes) from rows log_id, event_index, kind, context, ticks, message, body; a log is written in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, log = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([log]), pa.array([writer.finished()], pa.binary())], names=["path", "content"])
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("log_id", "kind", "message", "ticks")]
            for log_id, kind, message, ticks, context, body in zip(*plain, _structs(batch.column("context")), _structs(batch.column("body")), strict=True):
                if log_id != log:
                    if writer:
                        yield done()
                    writer, log = Writer(), log_id
                writer.event(kind, {"message": message, "context": context, "timestamp": None if ticks is None else (ticks, 1)}, body)
        if writer:
            yield done()

    return rows.repartition(WRITERS, "log_id").sortWithinPartitions("log_id", "event_index").mapInArrow(run, "path string, content binary")


def _logs_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(source, '') as source", "doc_id", "coalesce(text, '') as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        log = None

        def done() -> pa.RecordBatch:
            writer = Writer()
            writer.archive([("folder/", b""), ("bad.bin", b"\xff\xfe\xff"), *((f"{log}/{i}.txt", t.encode()) for i, t in held)])
            for _, t in held:
                writer.event(11, {"message": t})
            return pa.RecordBatch.from_arrays([pa.array([f"c-{log}"]), pa.array([writer.finished()], pa.binary())], names=["path", "content"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["source"] != log:
                    if held:
                        yield done()
                    held, log = [], r["source"]
                held.append((r["doc_id"], r["text"]))
        if held:
            yield done()

    return docs.repartition(WRITERS, "source").sortWithinPartitions("source", "doc_id").mapInArrow(run, "path string, content binary")


_known: dict[tuple, DataFrame] = {}


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def corpus(spark: SparkSession, sf_dir: str, name: str, table: str = "events") -> DataFrame:
    """A table of corpus a, b or c; made and ingested once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        made = _logs_c(spark, sf_dir) if name == "c" else encode_events({"a": _rows_a, "b": _rows_b}[name](spark, sf_dir))
        path = _folder(spark)
        made.write.parquet(path)
        _known[key] = spark.read.schema(made.schema).parquet(path)
    if (*key, table) not in _known:
        rows, path = decode_logs(_known[key], table), _folder(spark)
        if table == "events":
            rows.repartition("log_id", "kind").sortWithinPartitions("log_id", "event_index").write.partitionBy("kind").parquet(path)
        else:
            rows.write.parquet(path)
        _known[*key, table] = spark.read.schema(rows.schema).parquet(path)
    return _known[*key, table]
