"""Filters, limits, aggregates and joins over an events table of any number of logs.

Every function takes and returns DataFrames and keeps log_id in all keys, so one plan answers for
one log or for all.  Results carry event_index; order is the caller's last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KIND_BY_NAME, contains_folded, equals_folded, folded, listed_message, status

UNKNOWN, UNNAMED = "<unknown>", "<unnamed>"


def of_kind(events: DataFrame, *kinds: int) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds)) if len(kinds) > 1 else events.where(F.col("kind") == kinds[0])


def query(events: DataFrame, kind: int | str | None = None, project_context_id: int | None = None, target_id: int | None = None, task_id: int | None = None) -> DataFrame:
    """Events that meet all given conditions. A kind name that isn't known sets no condition."""
    if isinstance(kind, str):
        kind = KIND_BY_NAME.get(folded(kind))
    for column, value in (("kind", kind), ("project_context_id", project_context_id), ("target_id", target_id), ("task_id", task_id)):
        if value is not None:
            if not -(2**31) <= value < 2**31:
                raise ValueError(f"{column} out of range: {value}")
            events = events.where(F.col(column) == value)
    return events


def at_index(events: DataFrame, index: int) -> DataFrame:
    return events.where(F.col("event_index") == index)


def meta(events: DataFrame) -> DataFrame:
    return events.select("log_id", "event_index", "kind", "byte_offset", "payload_len", "has_context", "project_context_id", "target_id", "task_id")


def first_per_log(events: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of each log by event index; a negative limit, or none, sets none.

    Rank filters on a window become per-task limits before the shuffle (group limits), so at most limit rows of a log leave a task.
    """
    if limit is None or limit < 0:
        return events
    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy("event_index")))
    return ranked.where(F.col("rank") <= limit).drop("rank")


def readable(events: DataFrame) -> DataFrame:
    return events.where(F.col("decode_error").isNull())


def errors(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The first errors; those that can't be read count for the limit and are left out then."""
    return readable(first_per_log(of_kind(events, 9), limit))


def warning_matches(code: str | None = None, project: str | None = None) -> Column:
    body, match = F.col("body"), F.lit(True)
    if code is not None:
        match &= equals_folded(F.coalesce(body["diag_code"], F.lit("")), code)
    if project is not None:
        match &= contains_folded(F.coalesce(body["diag_project_file"], F.lit("")), project)
    return match


def warnings(events: DataFrame, code: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
    return first_per_log(readable(of_kind(events, 10)).where(warning_matches(code, project)), limit)


def warning_counts(events: DataFrame, code: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Per log: total warnings, shown ones, and those filtered out before the last one shown (all, if the limit isn't reached)."""
    rows = of_kind(events, 10).select("log_id", "event_index", F.col("decode_error").isNull().alias("ok"), warning_matches(code, project).alias("match"))
    rows = rows.withColumn("hit", F.col("ok") & F.col("match"))
    before = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("log_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1))
    seen = F.lit(True) if limit is None or limit < 0 else F.coalesce(before, F.lit(0)) < limit
    rows = rows.withColumn("seen", seen)
    return rows.groupBy("log_id").agg(F.count("*").alias("total"), F.count_if(F.col("seen") & F.col("hit")).alias("shown"), F.count_if(F.col("seen") & F.col("ok") & ~F.col("match")).alias("skipped"))


def search(events: DataFrame, text: str | None = None, limit: int | None = None, extended: bool = False, **where: int | str | None) -> DataFrame:
    found = query(events, **where)
    if text is not None:
        found = found.where(contains_folded(listed_message(extended), text))
    return first_per_log(found, limit)


def summary(events: DataFrame) -> DataFrame:
    """Per log: outcome, totals and duration (ms), in one aggregation."""
    first = lambda value, kind: F.min_by(value, F.when(F.col("kind") == kind, F.col("event_index")))
    finish = F.struct(F.col("body.succeeded").alias("succeeded"), F.col("decode_error").alias("error"), F.col("timestamp_ticks").alias("ticks"))
    out = events.groupBy("log_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("kind") == 9).alias("errors"), F.count_if(F.col("kind") == 10).alias("warnings"), first(F.col("timestamp_ticks"), 1).alias("started"), first(finish, 2).alias("f"))
    result = F.when(F.col("f").isNull(), "unknown (no BuildFinished event)").when(F.col("f.error").isNotNull(), "unknown").when(F.col("f.succeeded"), "succeeded").otherwise("FAILED")
    ticks = F.col("f.ticks") - F.col("started")
    return out.select("log_id", result.alias("result"), "total_events", "errors", "warnings", ((ticks - ticks % 10_000) / 10_000).cast("long").alias("duration_ms"))


def distinct_projects(events: DataFrame) -> DataFrame:
    """Project files by first appearance: log_id, project_file, first_index."""
    files = readable(of_kind(events, 3)).select("log_id", F.col("body.of_project").alias("project_file"), "event_index").where("project_file is not null")
    return files.groupBy("log_id", "project_file").agg(F.min("event_index").alias("first_index"))


def projects(events: DataFrame, project: str | None = None) -> DataFrame:
    rows = readable(of_kind(events, 3)).withColumn("project", F.coalesce("body.of_project", F.lit(UNKNOWN)))
    return rows if project is None else rows.where(contains_folded(F.col("project"), project))


def _started(events: DataFrame, kind: int, name: str, prefix: str) -> DataFrame:
    return readable(of_kind(events, kind)).select("log_id", F.col("project_context_id").alias("ctx"), "target_id", "task_id", F.col("event_index").alias(f"{prefix}_index"), F.coalesce(F.col(f"body.{name}"), F.lit(UNNAMED)).alias(prefix))


def project_tree(events: DataFrame) -> DataFrame:
    """A row for each task of each target of each project (nulls where there is none): a project listed twice lists its targets twice."""
    ps = projects(events).select("log_id", F.col("project_context_id").alias("ctx"), F.col("event_index").alias("project_index"), "project", F.col("body.project_id").alias("project_id"), F.col("body.target_names").alias("requested"))
    ts = _started(events, 5, "target_name", "target").drop("task_id")
    tk = _started(events, 7, "task_name", "task").drop("task_id")
    return ps.join(ts, ["log_id", "ctx"], "left").join(tk, ["log_id", "ctx", "target_id"], "left")


def _first_outcome(events: DataFrame, kind: int, keys: list[str], name: str) -> DataFrame:
    outcome = F.struct(F.when(F.col("decode_error").isNull(), F.col("body.succeeded")).alias("ok"))
    done = of_kind(events, kind).withColumnRenamed("project_context_id", "ctx").where("has_context")
    return done.groupBy("log_id", *keys).agg(F.min_by(outcome, "event_index").alias("o")).select("log_id", *keys, F.col("o.ok").alias(name))


def task_timeline(events: DataFrame, project_context_id: int | None = None, project: str | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Targets and tasks of projects with the status of each one's first finish event. A context id wins over a project filter.

    With a context id each log has a row at least; a table of the logs spares a scan of all events for that.
    """
    if project_context_id is not None:
        named = readable(of_kind(events, 3)).where((F.col("project_context_id") == project_context_id) & F.col("body.of_project").isNotNull())
        label = named.groupBy("log_id").agg(F.min_by("body.of_project", "event_index").alias("label"))
        ps = (events if logs is None else logs).select("log_id").distinct().join(label, "log_id", "left").select("log_id", F.lit(project_context_id).alias("ctx"), F.lit(None).cast("long").alias("project_index"), F.coalesce("label", F.lit(f"<project_context_id={project_context_id}>")).alias("project"))
        events = events.where(F.col("project_context_id") == project_context_id)
    else:
        ps = projects(events, project).where("has_context").select("log_id", F.col("project_context_id").alias("ctx"), F.col("event_index").alias("project_index"), "project")
    ts = _started(events, 5, "target_name", "target").drop("task_id")
    tk = _started(events, 7, "task_name", "task")
    ts = ts.join(_first_outcome(events, 6, ["ctx", "target_id"], "target_ok"), ["log_id", "ctx", "target_id"], "left")
    tk = tk.join(_first_outcome(events, 8, ["ctx", "target_id", "task_id"], "task_ok"), ["log_id", "ctx", "target_id", "task_id"], "left")
    out = ps.join(ts, ["log_id", "ctx"], "left").join(tk, ["log_id", "ctx", "target_id"], "left")
    named = lambda name, ok: F.when(F.col(name).isNotNull(), status(F.col(ok)))
    return out.withColumn("target_status", named("target", "target_ok")).withColumn("task_status", named("task", "task_ok"))


def properties(events: DataFrame, project: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Properties of each project start, in list order, at most limit for each; truncated says that more match."""
    rows = projects(events, project).select("log_id", "event_index", "project", F.posexplode("body.property_list").alias("pos", "pair")).select("log_id", "event_index", "project", "pos", "pair.key", "pair.value")
    if name is not None:
        rows = rows.where(contains_folded(F.col("key"), name))
    if limit is None or limit < 0:
        return rows.withColumn("truncated", F.lit(False))
    one = Window.partitionBy("log_id", "event_index")
    rows = rows.withColumn("rank", F.row_number().over(one.orderBy("pos"))).withColumn("n", F.count("*").over(one))
    return rows.where(F.col("rank") <= limit).withColumn("truncated", F.col("n") > limit).drop("rank", "n")


def items(events: DataFrame, project: str | None = None, item_type: str | None = None, spec: str | None = None, limit: int | None = None) -> DataFrame:
    """Items of each group of each project start, at most limit for each group; group_size counts all of the group."""
    groups = projects(events, project).select("log_id", "event_index", "project", F.posexplode("body.item_list").alias("group_pos", "g"))
    if item_type is not None:
        groups = groups.where(equals_folded(F.col("g.item_type"), item_type))
    rows = groups.select("log_id", "event_index", "project", "group_pos", F.col("g.item_type").alias("item_type"), F.size("g.items").alias("group_size"), F.posexplode("g.items").alias("pos", "item"))
    rows = rows.select("*", F.coalesce("item.item_spec", F.lit("")).alias("spec"), F.col("item.metadata").alias("metadata")).drop("item")
    if spec is not None:
        rows = rows.where(contains_folded(F.col("spec"), spec))
    if limit is None or limit < 0:
        return rows
    rank = F.row_number().over(Window.partitionBy("log_id", "event_index", "group_pos").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def item_counts(events: DataFrame) -> DataFrame:
    total = F.aggregate(F.coalesce("body.item_list", F.array().cast("array<struct<item_type:string,items:array<struct<item_spec:string,metadata:array<struct<key:string,value:string>>>>>>")), F.lit(0), lambda n, g: n + F.size(g["items"]))
    return projects(events).select("log_id", "event_index", F.coalesce(F.array_size("body.property_list"), F.lit(0)).alias("properties"), F.coalesce(F.array_size("body.item_list"), F.lit(0)).alias("groups"), total.alias("items"))


def neighbourhood(events: DataFrame, centres: DataFrame, radius: int = 10) -> DataFrame:
    """Events around each centre (log_id, event_index) within its scope: positions up to radius away.

    The scope is the task, target or project of the centre's context (an id of 0 is none; a task with one event
    falls back to its target, or to its project), or the whole log without a context.  Scopes are chosen first, and
    only events of chosen ones are numbered; in a whole log an event's index is its position.  Windows of positions
    are equi-joined through the at most 2 * radius + 1 positions that each centre asks for.

    All sides grow with the centres or the events, and a scan's estimated size (its files' size by the width of few of
    many columns) is far below its true one, so all joins are merge joins: no side is ever sent to the driver.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    joined = lambda left, right, on, how="inner": left.join(right.hint("merge"), on, how)
    ids = {"task": ["project_context_id", "target_id", "task_id"], "target": ["project_context_id", "target_id"], "project": ["project_context_id"]}
    base = events.select("log_id", "event_index", "has_context", *ids["task"])
    centre = joined(base, centres.select("log_id", "event_index").distinct(), ["log_id", "event_index"], "left_semi")
    in_context = base.where("has_context")
    tasks = centre.where("has_context and task_id <> 0").select("log_id", *ids["task"]).distinct()
    sizes = joined(in_context, tasks, ["log_id", *ids["task"]], "left_semi").groupBy("log_id", *ids["task"]).agg(F.count("*").alias("task_size"))
    by_target = F.when(F.col("target_id") != 0, "target")
    chosen = (
        F.when(~F.col("has_context"), "log")
        .when((F.col("task_id") != 0) & (F.col("task_size") > 1), "task")
        .when(F.col("task_id") != 0, F.coalesce(by_target, F.lit("project")))
        .otherwise(F.coalesce(by_target, F.when(F.col("project_context_id") != 0, "project"), F.lit("log")))
    )
    picked = joined(centre, sizes, ["log_id", *ids["task"]], "left").withColumn("scope", chosen)
    around = F.explode(F.sequence(F.col("place") - radius, F.col("place") + radius)).alias("place")
    of_log = picked.where("scope = 'log'").select("log_id", "scope", F.col("event_index").alias("centre"), F.col("event_index").alias("place"))
    found = joined(of_log.select("log_id", "centre", "scope", around), base.select("log_id", F.col("event_index").alias("place")), ["log_id", "place"])
    found = found.select("log_id", "centre", "scope", F.col("place").alias("event_index"))
    # Keys of scopes, with nulls where a scope has no such id.
    own = lambda scope: F.struct(F.lit(scope).alias("scope"), *(F.col(c) if c in ids[scope] else F.lit(None).cast("int").alias(c) for c in ids["task"]))
    of_scope = F.when(F.col("scope") == "task", own("task")).when(F.col("scope") == "target", own("target")).otherwise(own("project"))
    mine = picked.where("scope <> 'log'").select("log_id", "event_index", of_scope.alias("s"))
    members = joined(in_context.select("log_id", "event_index", F.explode(F.array(*map(own, ids))).alias("s")), mine.select("log_id", "s").distinct(), ["log_id", "s"], "left_semi")
    placed = members.withColumn("place", F.row_number().over(Window.partitionBy("log_id", "s").orderBy("event_index")))
    asked = joined(placed, mine, ["log_id", "s", "event_index"], "left_semi").select("log_id", "s", F.col("event_index").alias("centre"), around)
    near = joined(placed, asked, ["log_id", "s", "place"])
    return found.unionByName(near.select("log_id", "centre", "s.scope", "event_index"))
