"""Sessions over ingested logs, the named tools with their text output, and a line-by-line JSON-RPC loop."""

from __future__ import annotations

import json
import os
import sys
from typing import TextIO

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NAMED_KINDS, diagnostic_line, folded, kind_name, preview
from ..operators import events as ops
from ..sources.ingest import read_logs


class ToolError(Exception):
    """A tool's failure, told to the caller."""


def _number(args: dict, name: str) -> int | None:
    value = args.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _text(args: dict, name: str) -> str | None:
    value = args.get(name)
    return value if isinstance(value, str) else None


class Sessions:
    """Open logs by handle; handles count from 1 and are not used again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, 0
        self.open: dict[int, tuple[str, DataFrame]] = {}

    def call(self, name: str, args: dict | None = None) -> str:
        args = args or {}
        tool = getattr(self, f"_{name}", None) if name.startswith("binlog_") else None
        if tool is None:
            raise ToolError(f"unknown tool: {name}")
        if name == "binlog_open":
            return tool(args)
        handle = _number(args, "session")
        if handle is None:
            raise ToolError("missing or invalid 'session' parameter")
        if handle not in self.open:
            raise ToolError(f"no session with handle {handle}")
        return tool(args, handle, *self.open[handle])

    def _binlog_open(self, args: dict) -> str:
        path = _text(args, "file")
        if path is None:
            raise ToolError("missing required parameter: file")
        events = read_logs(self.spark, path).persist()
        version = read_logs(self.spark, path, "logs").first()
        counts = ops.summary(events).first()
        self.last += 1
        self.open[self.last] = (path, events)
        total, errors, warnings = (counts["total_events"], counts["errors"], counts["warnings"]) if counts else (0, 0, 0)
        return f"Session: {self.last}\nFile: {path}\nFormat version: {version['file_format_version']}\nTotal events: {total}\nErrors: {errors}\nWarnings: {warnings}\n"

    def _binlog_close(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        events.unpersist()
        del self.open[handle]
        return f"Session {handle} closed."

    def _binlog_summary(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        s = ops.summary(events).first() or Row(result="unknown (no BuildFinished event)", total_events=0, errors=0, warnings=0, duration_ms=None)
        version = read_logs(self.spark, path, "logs").first()["file_format_version"]
        out = f"Build result: {s['result']}\nFile: {path}\nFormat version: {version}\nTotal events: {s['total_events']}\nErrors: {s['errors']}\nWarnings: {s['warnings']}\n"
        if s["duration_ms"] is not None:
            out += f"Duration: {s['duration_ms'] // 1000}.{s['duration_ms'] % 1000:03}s\n"
        files = ops.distinct_projects(events).orderBy("first_index").collect()
        return out + f"\nProjects ({len(files)}):\n" + "".join(f"  {r['project_file']}\n" for r in files)

    @staticmethod
    def _diagnostics(rows: DataFrame) -> str:
        out = ""
        for r in rows.orderBy("event_index").select("event_index", diagnostic_line().alias("line"), F.col("body.diag_project_file").alias("project")).collect():
            out += r["line"] + "\n" + (f"  Project: {r['project']}\n" if r["project"] is not None else "") + f"  Event index: {r['event_index']}\n\n"
        return out

    def _binlog_errors(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        limit, total = _number(args, "limit"), ops.of_kind(events, 9).count()
        if not total:
            return "No errors found."
        showing = total if limit is None or limit < 0 else min(limit, total)
        return f"Errors: {showing} of {total}\n\n" + self._diagnostics(ops.errors(events, limit))

    def _binlog_warnings(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        where = {"code": _text(args, "code"), "project": _text(args, "project"), "limit": _number(args, "limit")}
        counts = ops.warning_counts(events, **where).first()
        if not counts or not counts["shown"]:
            if counts and counts["skipped"]:
                return f"No warnings matched the filter ({counts['total']} total warnings)."
            return "No warnings found."
        head = f"{counts['shown']} shown ({counts['skipped']} filtered out, {counts['total']} total)" if counts["skipped"] else f"{counts['shown']} of {counts['total']}"
        return f"Warnings: {head}\n\n" + self._diagnostics(ops.warnings(events, **where))

    def _binlog_project_tree(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        rows = ops.project_tree(events).orderBy("log_id", "project_index", "target_index", "task_index").collect()
        if not rows:
            return "No projects found."
        tree: dict = {}
        for r in rows:
            project = tree.setdefault((r["log_id"], r["project_index"]), (r, {}))
            if r["target_index"] is not None:
                tasks = project[1].setdefault(r["target_index"], (r["target"], []))[1]
                if r["task_index"] is not None:
                    tasks.append(r["task"])
        out = f"Project tree ({len(tree)} projects):\n\n"
        for r, targets in tree.values():
            out += f"Project: {r['project']}\n  Project ID: {r['project_id']}\n" + (f"  Requested targets: {r['requested']}\n" if r["requested"] is not None else "")
            out += f"  Context: project_context_id={r['ctx']}\n" if r["ctx"] is not None else ""
            for target, tasks in targets.values():
                out += f"  Target: {target}" + (f" ({len(tasks)} tasks)" if tasks else "") + "\n" + "".join(f"    Task: {t}\n" for t in tasks)
            out += "\n"
        return out

    def _binlog_events(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        where = {n: _number(args, n) for n in ("project_context_id", "target_id", "task_id")}
        rows = ops.search(events, _text(args, "text"), _number(args, "limit"), kind=_text(args, "kind"), **where)
        shown = rows.orderBy("event_index").select("event_index", kind_name(F.col("kind")).alias("name"), preview().alias("line")).collect()
        if not shown:
            return "No events matched the filter."
        return f"Events: {len(shown)} shown\n\n" + "".join(f"[{r['event_index']}] {r['name']}: {r['line']}\n" for r in shown)

    def _index(self, args: dict, events: DataFrame) -> Row:
        index = _number(args, "index")
        if index is None or index < 0:
            raise ToolError("missing or invalid 'index' parameter")
        log = _text(args, "log")
        rows = ops.at_index(events if log is None else events.where(F.col("log_id") == log), index).limit(2).collect()
        if not rows:
            raise ToolError(f"event index {index} out of range (total events: {events.count()})")
        if len(rows) > 1:
            raise ToolError(f"several logs have an event {index}: give 'log', such as {rows[0]['log_id']}")
        return rows[0]

    def _binlog_event_detail(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        r = self._index(args, events)
        if r["decode_error"] is not None:
            raise ToolError(r["decode_error"])
        out = [f"Event index: {r['event_index']}", f"Kind: {NAMED_KINDS.get(r['kind'], 'Unknown')}", f"Byte offset: {r['byte_offset']}", f"Payload length: {r['payload_len']}"]
        if r["has_context"]:
            out += ["Context:"] + [f"  {c}: {r[c]}" for c in ("node_id", "project_context_id", "target_id", "task_id", "submission_id", "project_instance_id", "evaluation_id")]
        return "\n".join([*out, "", f"Type: {NAMED_KINDS.get(r['kind'], 'Other')}", *self._detail(r)]) + "\n"

    #: Labelled fields of kinds with a layout of their own: before and after the common ones.
    _LABELS = {
        2: [("Succeeded", "succeeded")],
        3: [("Project file", "of_project"), ("Project ID", "project_id"), ("Target names", "target_names"), ("Tools version", "tools_version")],
        4: [("Succeeded", "succeeded"), ("Project file", "of_project")],
        5: [("Target name", "target_name"), ("Project file", "of_project"), ("Target file", "target_file"), ("Parent target", "parent_target"), ("Build reason", "build_reason")],
        6: [("Succeeded", "succeeded"), ("Target name", "target_name")],
        7: [("Task name", "task_name"), ("Project file", "of_project")],
        8: [("Succeeded", "succeeded"), ("Task name", "task_name")],
    }

    def _detail(self, r: Row) -> list[str]:
        body, say = r["body"], lambda x: str(x).lower() if isinstance(x, bool) else str(x)
        out = [f"{label}: {say(body[name])}" for label, name in self._LABELS.get(r["kind"], []) if body[name] is not None]
        if r["kind"] in (9, 10):
            line, column = body["diag_line"], body["diag_column"]
            place = f"({line}{f',{column}' if column > 0 else ''})" if line > 0 else ""
            out += [f"{label}: {value}" for label, value in (("Code", body["diag_code"]), ("File", body["diag_file"] and body["diag_file"] + place), ("Project", body["diag_project_file"]), ("Subcategory", body["diag_subcategory"])) if value is not None]
        if r["message"] is not None:
            out.append(f"Message: {r['message']}")
        if r["timestamp_ticks"] is not None:
            out.append(f"Timestamp ticks: {r['timestamp_ticks']}")
        if r["has_context"]:
            out.append(f"Context: project_context_id={r['project_context_id']} target_id={r['target_id']} task_id={r['task_id']}")
        if r["kind"] == 3:
            if body["property_list"] is not None:
                out.append(f"Properties: {len(body['property_list'])} entries")
            if body["item_list"] is not None:
                out.append(f"Items: {len(body['item_list'])} groups, {sum(len(g['items']) for g in body['item_list'])} total items")
        return out

    def _binlog_properties(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        project, name, limit = _text(args, "project"), _text(args, "name"), _number(args, "limit")
        if ops.of_kind(events, 3).isEmpty():
            return "No projects found."
        with_any = ops.projects(events, project).where(F.size("body.property_list") > 0).orderBy("event_index").select("event_index", "project").collect()
        out = {r["event_index"]: f"Project: {r['project']}\n" for r in with_any}
        cut = dict.fromkeys(out, False)
        for r in ops.properties(events, project, name, limit).orderBy("event_index", "pos").collect():
            out[r["event_index"]] += f"  {r['key']} = {r['value']}\n"
            cut[r["event_index"]] = r["truncated"]
        if limit == 0:  # no row says that more match
            cut = dict.fromkeys((r["event_index"] for r in ops.properties(events, project, name).select("event_index").distinct().collect()), True)
        if not out:
            return "No properties found matching the filter."
        return "".join(text + (f"  ... (truncated at {limit})\n" if cut.get(i) else "") + "\n" for i, text in out.items())

    def _binlog_items(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        project, kind, spec, limit = _text(args, "project"), _text(args, "item_type"), _text(args, "spec"), _number(args, "limit")
        if ops.of_kind(events, 3).isEmpty():
            return "No projects found."
        rows = ops.projects(events, project).where(F.size("body.item_list") > 0).orderBy("event_index").select("event_index", "project", "body.item_list").collect()
        out = ""
        # One item more than is shown tells that more match.
        matching = ops.items(events, project, kind, spec, None if limit is None or limit < 0 else limit + 1).orderBy("event_index", "group_pos", "pos").collect()
        by_group: dict = {}
        for r in matching:
            by_group.setdefault((r["event_index"], r["group_pos"]), []).append(r)
        for p in rows:
            groups = [(k, g) for k, g in enumerate(p["item_list"]) if kind is None or folded(g["item_type"]) == folded(kind)]
            if not groups:
                continue
            out += f"Project: {p['project']}\n"
            for k, g in groups:
                out += f"  [{g['item_type']} ({len(g['items'])} items)]\n"
                found = by_group.get((p["event_index"], k), [])
                shown = found if limit is None or limit < 0 else found[:limit]
                for r in shown:
                    out += f"    {r['spec']}\n" + "".join(f"      {m['key']} = {m['value']}\n" for m in r["metadata"] or [])
                if len(shown) < len(found):
                    out += f"    ... (truncated at {len(shown)})\n"
            out += "\n"
        return out or "No items found matching the filter."

    def _binlog_error_context(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        r, radius = self._index(args, events), _number(args, "radius")
        radius = 10 if radius is None else radius
        if radius < 0:
            raise ToolError("'radius' must not be negative")
        mine = events.where(F.col("log_id") == r["log_id"])
        near = ops.neighbourhood(mine, ops.at_index(mine, r["event_index"]), radius).select("event_index", "scope")
        rows = mine.join(F.broadcast(near), "event_index").orderBy("event_index")  # at most 2 * radius + 1 rows
        rows = rows.select("event_index", "scope", kind_name(F.col("kind")).alias("name"), preview().alias("line")).collect()
        ids = [f"{c}={r[c]}" for c in ("project_context_id", "target_id", "task_id")]
        named = {"project": ids[:1], "target": ids[:2], "task": ids}
        scope = rows[0]["scope"]
        out = f"Context scope: {scope} ({', '.join(named[scope])})\n" if scope in named else "Context scope: index neighborhood\n"
        out += f"Showing events around index {r['event_index']}:\n\n"
        for x in rows:
            out += f"{'>>>' if x['event_index'] == r['event_index'] else '   '} [{x['event_index']}] {x['name']}: {x['line']}\n"
        return out

    def _binlog_task_timeline(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        rows = ops.task_timeline(events, _number(args, "project_context_id"), _text(args, "project")).orderBy("project_index", "target_index", "task_index").collect()
        if not rows:
            return "No projects matched the filter."
        out, project, target = "", None, None
        for r in rows:
            if project != (r["project_index"], r["ctx"]):
                out += ("\n" if project else "") + f"Project: {r['project']} (context_id={r['ctx']})\n" + ("  (no targets)\n" if r["target"] is None else "")
                project, target = (r["project_index"], r["ctx"]), None
            if r["target"] is not None and target != r["target_index"]:
                out += f"  Target: {r['target']} [{r['target_status']}]\n"
                target = r["target_index"]
            if r["task"] is not None:
                out += f"    Task: {r['task']} [{r['task_status']}]\n"
        return out + "\n"

    def _binlog_feedback(self, args: dict, handle: int, path: str, events: DataFrame) -> str:
        file, text = _text(args, "file"), _text(args, "text")
        if file is None or text is None:
            raise ToolError(f"missing required parameter: {'file' if file is None else 'text'}")
        line = {"session": handle, "binlog": path, "text": text}
        if (cause := _text(args, "root_cause")) is not None:
            line["root_cause"] = cause
        if isinstance(args.get("event_indices"), list):
            line["event_indices"] = [i for i in args["event_indices"] if isinstance(i, int) and not isinstance(i, bool)]
        with open(file, "a", encoding="utf-8") as out:
            out.write(json.dumps(line, sort_keys=True, ensure_ascii=False) + "\n")
        return f"Feedback appended to {os.fspath(file)}"


#: What each tool does and its arguments: JSON type and meaning; a trailing * marks those that must be given.
TOOLS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "open": ("Open a build log and get a session for the other tools, with counts of events, errors and warnings.", {"file*": ("string", "path of the log")}),
    "close": ("End a session and free what it holds.", {}),
    "summary": ("Outcome, counts, duration and projects of the build.", {}),
    "errors": ("Errors with code, place, message and project.", {"limit": ("integer", "most errors to list; all if absent")}),
    "warnings": ("Warnings with code, place, message and project.", {"code": ("string", "only this code, in either case"), "project": ("string", "only project files with this text in their path"), "limit": ("integer", "most warnings to list")}),
    "project_tree": ("Projects with their targets and tasks.", {}),
    "events": ("Events that meet all conditions, a line for each.", {"kind": ("string", "name of the kind"), "project_context_id": ("integer", "project context"), "target_id": ("integer", "target"), "task_id": ("integer", "task"), "text": ("string", "only messages with this text, in either case"), "limit": ("integer", "most events to list")}),
    "event_detail": ("All fields of one event.", {"index*": ("integer", "index of the event"), "log": ("string", "id of the log, where a session has several")}),
    "properties": ("Properties of started projects.", {"project": ("string", "text in the project's path"), "name": ("string", "text in the property's name"), "limit": ("integer", "most properties for each project")}),
    "items": ("Items of started projects with their metadata.", {"project": ("string", "text in the project's path"), "item_type": ("string", "type of the group"), "spec": ("string", "text in the item"), "limit": ("integer", "most items for each group")}),
    "error_context": ("Events around one event in its task, target, project or log.", {"index*": ("integer", "index of the event"), "log": ("string", "id of the log, where a session has several"), "radius": ("integer", "events on each side; 10 if absent")}),
    "task_timeline": ("Targets and tasks in order, with their outcome.", {"project_context_id": ("integer", "only this project context"), "project": ("string", "text in the project's path; not used beside a context")}),
    "feedback": ("Append a note on the build to a file, as a line of JSON.", {"file*": ("string", "path of the notes"), "text*": ("string", "the note"), "root_cause": ("string", "cause of the failure"), "event_indices": ("array", "events that the note is about")}),
}


def descriptors() -> list[dict]:
    """The tools as a client needs them: names, descriptions and JSON schemas of the arguments."""
    out = []
    for name, (does, own) in TOOLS.items():
        args = own if name == "open" else {"session*": ("integer", "session from binlog_open"), **own}
        properties = {a.rstrip("*"): {"type": kind, "description": means, **({"items": {"type": "integer"}} if kind == "array" else {})} for a, (kind, means) in args.items()}
        schema = {"type": "object", "properties": properties, "required": [a.rstrip("*") for a in args if a.endswith("*")]}
        hints = {"readOnlyHint": name not in ("close", "feedback"), "destructiveHint": False}
        out.append({"name": f"binlog_{name}", "description": does, "inputSchema": schema, "annotations": hints})
    return out


def answer(sessions: Sessions, line: str) -> dict | None:
    """The reply to one JSON-RPC message; none to notifications."""
    fail = lambda i, code, text: {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}}
    try:
        message = json.loads(line)
        method, number = message["method"], message.get("id")
        message["jsonrpc"]
    except (ValueError, KeyError, TypeError) as e:
        return fail(None, -32700, f"parse error: {e}")
    if number is None:
        return None
    done = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if method == "initialize":
        return done({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tracewell", "version": "0.1.0"}})
    if method == "tools/list":
        return done({"tools": descriptors()})
    if method in ("ping", "shutdown"):
        return done({} if method == "ping" else None)
    if method != "tools/call":
        return fail(number, -32601, f"method not found: {method}")
    params = message.get("params")
    if not isinstance(params, dict) or not isinstance(params.get("name"), str):
        return fail(number, -32602, "missing params")
    try:
        text, bad = sessions.call(params["name"], params.get("arguments")), False
    except Exception as e:  # a tool's failure is an answer
        text, bad = f"error: {e}", True
    return done({"content": [{"type": "text", "text": text}], **({"isError": True} if bad else {})})


def serve(spark: SparkSession, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    sessions = Sessions(spark)
    for line in lines:
        if line.strip() and (reply := answer(sessions, line)) is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
