"""Registered queries over the corpora, and the same answers in SQL from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import events as ops
from .corpus import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

A = """
with a as (
    select 'a' || (event_id % 8) as log_id, event_id // 8 as event_index, event_id % 11 <> 0 as has_context,
        case event_type when 'error' then 9 when 'signup' then 10 when 'click' then 11 when 'view' then 12 else 13 end as kind,
        case when event_id % 11 <> 0 then cast(user_id % 150 as integer) end as project_context_id, case when event_id % 11 <> 0 then cast(event_id % 5 as integer) end as target_id,
        case when event_id % 11 <> 0 then cast(event_id % 7 as integer) end as task_id, event_type || ' ' || props as message, 621355968000000000 + epoch_us(ts) * 10 as timestamp_ticks,
        'CS' || lpad(user_id::varchar, 4, '0') as code, 'src/f' || (event_id % 97) || '.cs' as file, 'p' || (user_id % 20) || '.csproj' as project_file, cast(event_id % 500 as integer) as line, cast(event_id % 80 as integer) as col
    from events
)
"""
_LINE = "code || ' in ' || file || case when line > 0 then '(' || line || case when col > 0 then ',' || col else '' end || ')' else '' end || ': ' || message"
B = """
with c as (select *, cast(c_custkey % 40 as integer) as log_no from customer),
o as (select c.log_no, c.c_custkey, o.* from orders o join c on o_custkey = c_custkey),
l as (select o.log_no, o.c_custkey, l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as task from lineitem l join o on l_orderkey = o_orderkey),
r as (
    select log_no, 0 as phase, 0 as cust, 0 as ord, 0 as task, 0 as sub, 1 as kind from o group by log_no
    union all select log_no, 2, 0, 0, 0, 0, 2 from o group by log_no
    union all select log_no, 1, c_custkey, -1, 0, 0, 3 from c
    union all select log_no, 1, c_custkey, o_orderkey, 0, 0, 5 from o
    union all select log_no, 1, c_custkey, l_orderkey, task, 0, 7 from l
    union all select log_no, 1, c_custkey, l_orderkey, task, 1, 8 from l where not (l_linestatus = 'O' and l_returnflag = 'A')
    union all select log_no, 1, c_custkey, o_orderkey, 9223372036854775807, 0, 6 from o where o_orderstatus <> 'P'
    union all select log_no, 1, c_custkey, 9223372036854775807, 0, 0, 4 from c
),
n as (select *, row_number() over (partition by log_no order by phase, cust, ord, task, sub, kind) - 1 as event_index from r)
"""


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "a")


def query_b(name: str, oracle: str, table: str = "events") -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """A query of a table of corpus b."""

    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        query(name, oracle)(lambda s, d: f(corpus(s, d, "b", table)))

    return add


def _brief(rows: DataFrame) -> DataFrame:
    return rows.select("log_id", "event_index", "kind", "project_context_id", "target_id", "task_id")


_BRIEF = "select log_id, event_index, kind, project_context_id, target_id, task_id from a"

query_b("task_timeline", B + """
select 'b' || p.log_no as log_id, p.event_index as project_index, 'p' || (c.c_custkey % 40) || '.csproj' as project, case when o_orderkey is not null then 'T' || o_orderkey end as target,
    case when o_orderkey is null then null when o_orderstatus = 'P' then '?' when o_orderstatus <> 'F' then 'ok' else 'FAILED' end as target_status, case when l.task is not null then 'L' || l_partkey end as task,
    case when l.task is null then null when l_linestatus = 'O' and l_returnflag = 'A' then '?' when l_returnflag <> 'R' then 'ok' else 'FAILED' end as task_status, t.event_index as task_index
from c join n p on p.kind = 3 and p.cust = c.c_custkey left join o on o.c_custkey = c.c_custkey left join l on l.l_orderkey = o_orderkey left join n t on t.kind = 7 and t.ord = l.l_orderkey and t.task = l.task
""")(lambda e: ops.task_timeline(e).select("log_id", "project_index", "project", "target", "target_status", "task", "task_status", "task_index"))  # fmt: skip
query("scan_events_meta", A + "select log_id, event_index, kind, has_context, project_context_id, target_id, task_id from a")(lambda s, d: ops.meta(_a(s, d)).drop("byte_offset", "payload_len"))
query("scan_messages", A + "select log_id, event_index, message, timestamp_ticks from a")(lambda s, d: _a(s, d).select("log_id", "event_index", "message", "timestamp_ticks"))
query("scan_diagnostics", A + "select log_id, event_index, kind, code, file, project_file, line, col from a where kind in (9, 10)")(
    lambda s, d: ops.of_kind(_a(s, d), 9, 10).select("log_id", "event_index", "kind", F.col("body.diag_code").alias("code"), F.col("body.diag_file").alias("file"), F.col("body.diag_project_file").alias("project_file"), F.col("body.diag_line").alias("line"), F.col("body.diag_column").alias("col"))
)
query("count_by_kind", A + "select log_id, kind, count(*) as n from a group by all")(lambda s, d: _a(s, d).groupBy("log_id", "kind").agg(F.count("*").alias("n")))
query("total_events", A + "select log_id, count(*) as n from a group by log_id")(lambda s, d: _a(s, d).groupBy("log_id").agg(F.count("*").alias("n")))
query("filter_kind", A + _BRIEF + " where kind = 9")(lambda s, d: _brief(ops.query(_a(s, d), kind="ERROR")))
query("filter_project_context", A + _BRIEF + " where project_context_id = 7")(lambda s, d: _brief(ops.query(_a(s, d), project_context_id=7)))
query("filter_target", A + _BRIEF + " where target_id = 3")(lambda s, d: _brief(ops.query(_a(s, d), target_id=3)))
query("filter_task", A + _BRIEF + " where task_id = 4")(lambda s, d: _brief(ops.query(_a(s, d), task_id=4)))
query("filter_combined", A + _BRIEF + " where kind = 11 and project_context_id = 12 and target_id = 2")(lambda s, d: _brief(ops.query(_a(s, d), kind=11, project_context_id=12, target_id=2)))
query("filter_unknown_kind", A + _BRIEF + " where task_id = 6")(lambda s, d: _brief(ops.query(_a(s, d), kind="no such kind", task_id=6)))
query("point_lookup", A + "select log_id, event_index, kind, message from a where event_index = 42")(lambda s, d: ops.at_index(_a(s, d), 42).select("log_id", "event_index", "kind", "message"))
query("errors_limit", A + f"select log_id, event_index, 'error ' || {_LINE} as line from a where kind = 9 qualify row_number() over (partition by log_id order by event_index) <= 10")(
    lambda s, d: ops.errors(_a(s, d), 10).select("log_id", "event_index", x.diagnostic_line().alias("line"))
)
query("warnings_by_code", A + "select log_id, event_index, code from a where kind = 10 and code = 'CS0042'")(lambda s, d: ops.warnings(_a(s, d), code="cs0042").select("log_id", "event_index", F.col("body.diag_code").alias("code")))
query("warnings_by_project", A + "select log_id, event_index, project_file from a where kind = 10 and contains(project_file, 'p1') qualify row_number() over (partition by log_id order by event_index) <= 20")(
    lambda s, d: ops.warnings(_a(s, d), project="P1", limit=20).select("log_id", "event_index", F.col("body.diag_project_file").alias("project_file"))
)
query("warnings_counters", A + """
, w as (select log_id, contains(project_file, 'p1') as hit, coalesce(sum(cast(contains(project_file, 'p1') as integer)) over (partition by log_id order by event_index rows between unbounded preceding and 1 preceding), 0) as before from a where kind = 10)
select log_id, count(*) as total, count(*) filter (where hit and before < 5) as shown, count(*) filter (where not hit and before < 5) as skipped from w group by log_id
""")(lambda s, d: ops.warning_counts(_a(s, d), project="p1", limit=5))  # fmt: skip
query("events_text", A + "select log_id, event_index, kind from a where contains(message, '\"k\": 7')")(lambda s, d: ops.search(_a(s, d), '"K": 7').select("log_id", "event_index", "kind"))
query("events_text_limit", A + "select log_id, event_index, kind from a where contains(message, 'e') and kind = 12 qualify row_number() over (partition by log_id order by event_index) <= 7")(
    lambda s, d: ops.search(_a(s, d), "E", 7, kind="taskcommandline").select("log_id", "event_index", "kind")
)
query("diag_line", A + f"select log_id, event_index, case kind when 9 then 'error ' else 'warning ' end || {_LINE} as line from a where kind in (9, 10)")(lambda s, d: ops.of_kind(_a(s, d), 9, 10).select("log_id", "event_index", x.diagnostic_line().alias("line")))
query("preview", A + "select log_id, event_index, case when kind in (9, 10) then code || ': ' || message else message end as line from a")(lambda s, d: _a(s, d).select("log_id", "event_index", x.preview().alias("line")))
query("preview_bytes", """
with m as (select 'c-' || source as log_id, row_number() over (partition by source order by doc_id) - 1 as event_index, encode(text) as b, text from documents)
select log_id, event_index, case when octet_length(b) <= 120 then text else coalesce(try(decode(b[1:120])), try(decode(b[1:119])), try(decode(b[1:118])), try(decode(b[1:117]))) end as line from m
""")(lambda s, d: corpus(s, d, "c").select("log_id", "event_index", x.preview().alias("line")))  # fmt: skip
query("archive_files", "select 'c-' || source as log_id, source || '/' || doc_id || '.txt' as path, text as contents from documents")(lambda s, d: corpus(s, d, "c", "archive_files").select("log_id", "path", "contents"))
query_b("summary", B + """
, t as (select log_no, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 1000 as duration_ms from o group by log_no)
select 'b' || log_no as log_id, 'FAILED' as result, count(*) as total_events, cast(0 as bigint) as errors, cast(0 as bigint) as warnings, any_value(duration_ms) as duration_ms from n join t using (log_no) group by log_no
""")(lambda e: ops.summary(e))  # fmt: skip
query_b("duration", "with c as (select *, cast(c_custkey % 40 as integer) as log_no from customer) select 'b' || log_no as log_id, ((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 1000000) || '.' || lpad(((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 1000 % 1000)::varchar, 3, '0') as duration from orders join c on o_custkey = c_custkey group by log_no")(
    lambda e: ops.summary(e).select("log_id", x.seconds(F.col("duration_ms") * 10_000).alias("duration"))
)
query_b("distinct_projects", B + "select 'b' || n.log_no as log_id, 'p' || (cust % 40) || '.csproj' as project_file, min(event_index) as first_index from n where kind = 3 group by n.log_no, cust % 40")(lambda e: ops.distinct_projects(e))
query_b("project_tree", B + """
select 'b' || p.log_no as log_id, p.event_index as project_index, 'p' || (c.c_custkey % 40) || '.csproj' as project, case when c_nationkey % 2 = 1 then 'Build' end as requested,
    g.event_index as target_index, case when o_orderkey is not null then 'T' || o_orderkey end as target, t.event_index as task_index, case when l.task is not null then 'L' || l_partkey end as task
from c join n p on p.kind = 3 and p.cust = c.c_custkey left join o on o.c_custkey = c.c_custkey left join n g on g.kind = 5 and g.ord = o_orderkey
left join l on l.l_orderkey = o_orderkey left join n t on t.kind = 7 and t.ord = l.l_orderkey and t.task = l.task
""")(lambda e: ops.project_tree(e).select("log_id", "project_index", "project", "requested", "target_index", "target", "task_index", "task"))  # fmt: skip
query_b("tasks_per_target", B + "select 'b' || o.log_no as log_id, 'T' || o_orderkey as target, count(l.task) as tasks from o left join l on l_orderkey = o_orderkey group by o.log_no, o_orderkey")(
    lambda e: ops.project_tree(e).where("target is not null").groupBy("log_id", "target", "target_index").agg(F.count("task_index").alias("tasks")).drop("target_index")
)
query("timeline_by_context", B + """
select 'b' || o.log_no as log_id, 'p' || (o.c_custkey % 40) || '.csproj' as project, 'T' || o_orderkey as target, case when o_orderstatus = 'P' then '?' when o_orderstatus <> 'F' then 'ok' else 'FAILED' end as target_status, count(l.task) as tasks
from o left join l on l_orderkey = o_orderkey where o.c_custkey in (select min(c_custkey) from o) group by all
""")(lambda s, d: _timeline_of_first(corpus(s, d, "b"), corpus(s, d, "b", "logs")))  # fmt: skip


def _timeline_of_first(events: DataFrame, logs: DataFrame) -> DataFrame:
    first = ops.of_kind(events, 5).agg(F.min("project_context_id").alias("c")).first()["c"]
    rows = ops.task_timeline(events, project_context_id=first, logs=logs).where("target is not null")
    return rows.groupBy("log_id", "project", "target", "target_status").agg(F.count("task").alias("tasks"))


query_b("properties", B + "select 'b' || n.log_no as log_id, event_index, key, value from n join c on n.cust = c_custkey, (values (0, 'Name'), (1, 'Segment'), (2, 'NationKey'), (3, 'Name')) k(pos, key), lateral (select case pos when 0 then c_name when 2 then c_nationkey::varchar else c_mktsegment end as value) where kind = 3")(
    lambda e: ops.properties(e).select("log_id", "event_index", "key", "value")
)
query_b("properties_limit", B + "select 'b' || n.log_no as log_id, event_index, 'Name' as key, c_name as value, true as truncated from n join c on n.cust = c_custkey where kind = 3")(
    lambda e: ops.properties(e, name="name", limit=1).select("log_id", "event_index", "key", "value", "truncated")
)
query_b("properties_dup_keys", B + "select 'b' || n.log_no as log_id, event_index, 'Name' as key, cast(2 as bigint) as n from n where kind = 3")(
    lambda e: ops.properties(e).groupBy("log_id", "event_index", "key").agg(F.count("*").alias("n")).where("n > 1")
)
query_b("items", B + "select 'b' || n.log_no as log_id, event_index, 'Compile' as item_type, 'o' || o_orderkey || '.cs' as spec, o_orderpriority as priority from n join o on n.cust = o.c_custkey where kind = 3")(
    lambda e: ops.items(e).select("log_id", "event_index", "item_type", "spec", F.col("metadata")[0]["value"].alias("priority"))
)
query_b("items_limit", B + "select 'b' || n.log_no as log_id, event_index, 'o' || o_orderkey || '.cs' as spec, count(*) over (partition by n.log_no, event_index) as group_size from n join o on n.cust = o.c_custkey where kind = 3 qualify row_number() over (partition by n.log_no, event_index order by o_orderkey) <= 2")(
    lambda e: ops.items(e, item_type="compile", limit=2).select("log_id", "event_index", "spec", F.col("group_size").cast("long").alias("group_size"))
)
query_b("item_group_counts", B + "select 'b' || n.log_no as log_id, event_index, 4 as properties, 2 as groups, cast(count(o_orderkey) as integer) as items from n left join o on n.cust = o.c_custkey where kind = 3 group by n.log_no, event_index")(lambda e: ops.item_counts(e))
_CONTEXT = """
, s as (
    select log_id, event_index, 'log' as key from a
    union all select log_id, event_index, 'project:' || project_context_id from a where has_context
    union all select log_id, event_index, 'target:' || project_context_id || ':' || target_id from a where has_context
    union all select log_id, event_index, 'task:' || project_context_id || ':' || target_id || ':' || task_id from a where has_context
),
p as (select *, row_number() over (partition by log_id, key order by event_index) as place, count(*) over (partition by log_id, key) as size from s),
e as (select a.*, t.size as task_size from a left join p t on t.log_id = a.log_id and t.event_index = a.event_index and t.key like 'task:%' where kind = 9),
k as (select log_id, event_index as centre, case when not has_context then 'log' when task_id <> 0 and task_size > 1 then 'task' when target_id <> 0 then 'target' when task_id <> 0 or project_context_id <> 0 then 'project' else 'log' end as scope from e)
select k.log_id, k.centre, k.scope, n.event_index from k join p m on m.log_id = k.log_id and m.event_index = k.centre and split_part(m.key, ':', 1) = k.scope
join p n on n.log_id = k.log_id and n.key = m.key and n.place between m.place - {radius} and m.place + {radius}
"""
query("error_context", A + _CONTEXT.format(radius=3))(lambda s, d: ops.neighbourhood(_a(s, d), ops.of_kind(_a(s, d), 9), 3))
query("error_context_default", A + _CONTEXT.format(radius=10))(lambda s, d: ops.neighbourhood(_a(s, d), ops.of_kind(_a(s, d), 9)))
query("string_table", A + "select distinct log_id, value from (select log_id, message as value from a union all select log_id, code from a where kind in (9, 10) union all select log_id, file from a where kind in (9, 10) union all select log_id, project_file from a where kind in (9, 10))")(
    lambda s, d: corpus(s, d, "a", "strings").select("log_id", "value")
)
query_b("name_values", B + "select distinct 'b' || log_no as log_id, key, value from (select log_no, 'Priority' as key, o_orderpriority as value from o union all select log_no, 'Status', o_orderstatus from o union all select log_no, 'Name', c_name from c union all select log_no, 'Segment', c_mktsegment from c union all select log_no, 'NationKey', c_nationkey::varchar from c union all select log_no, 'Name', c_mktsegment from c)", "name_values")(
    lambda e: e.select("log_id", "key", "value").distinct()
)
query("logs", "select 'a' || i as log_id, 25 as file_format_version, 18 as min_reader_version from range(8) t(i)")(lambda s, d: corpus(s, d, "a", "logs").select("log_id", "file_format_version", "min_reader_version"))
