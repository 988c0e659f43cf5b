import json

import pytest

from tracewell.operators import events as ops
from tracewell.plans.tools import Sessions, ToolError, answer
from tracewell.sources.codec import Writer
from tracewell.sources.ingest import BuildLogSource, read_logs
from tracewell.streaming.logs import ingest_arriving

START, END = 621355968000000000, 621355968000000000 + 12_345_678


def ctx(project, target=0, task=0):
    return {"node_id": 1, "project_context_id": project, "target_id": target, "task_id": task}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    w = Writer()
    w.event(1, {"message": "Build started.", "timestamp": (START, 1)})
    props = [{"key": "Name", "value": "one"}, {"key": "NAME2", "value": "two"}, {"key": "Other", "value": ""}]
    groups = [{"item_type": "Compile", "items": [{"item_spec": "a.cs", "metadata": [{"key": "k", "value": "v"}]}, {"item_spec": "b.cs", "metadata": None}]}, {"item_type": "None", "items": []}]
    w.event(3, {"context": ctx(5)}, {"of_project": "app.csproj", "project_id": 7, "target_names": "Build", "property_list": props, "item_list": groups})
    w.event(5, {"context": ctx(5, 2)}, {"target_name": "Compile"})
    w.event(7, {"context": ctx(5, 2, 3)}, {"task_name": "Csc"})
    w.event(9, {"context": ctx(5, 2, 3), "message": "bad thing"}, {"diag_code": "CS1", "diag_file": "a.cs", "diag_line": 3, "diag_column": 4, "diag_project_file": "app.csproj"})
    w.event(10, {"message": "careful"}, {"diag_code": "CS2"})
    w.event(8, {"context": ctx(5, 2, 3)}, {"task_name": "Csc", "succeeded": False})
    w.event(6, {"context": ctx(5, 2)}, {"target_name": "Compile", "succeeded": True})
    w.event(30, {"message": "hidden"}, {})
    w.event(2, {"timestamp": (END, 1)}, {"succeeded": False})
    path = tmp_path_factory.mktemp("logs")
    (path / "one.binlog").write_bytes(w.finished())
    return path


@pytest.fixture(scope="module")
def tools(spark, folder):
    sessions = Sessions(spark)
    text = sessions.call("binlog_open", {"file": str(folder / "one.binlog")})
    assert text.endswith("Format version: 25\nTotal events: 10\nErrors: 1\nWarnings: 1\n") and text.startswith("Session: 1\n")
    return lambda tool, /, **args: sessions.call(f"binlog_{tool}", {"session": 1, **args})


def test_summary(tools):
    text = tools("summary")
    assert text.startswith("Build result: FAILED\n") and "Duration: 1.234s\n" in text and text.endswith("Projects (1):\n  app.csproj\n")


def test_diagnostics(tools):
    assert tools("errors") == "Errors: 1 of 1\n\nerror CS1 in a.cs(3,4): bad thing\n  Project: app.csproj\n  Event index: 4\n\n"
    assert tools("errors", limit=0) == "Errors: 0 of 1\n\n"
    assert tools("warnings", code="cs2") == "Warnings: 1 of 1\n\nwarning CS2 in <unknown>: careful\n  Event index: 5\n\n"
    assert tools("warnings", limit=0) == "No warnings found."


def test_tree_and_timeline(tools):
    assert tools("project_tree") == "Project tree (1 projects):\n\nProject: app.csproj\n  Project ID: 7\n  Requested targets: Build\n  Context: project_context_id=5\n  Target: Compile (1 tasks)\n    Task: Csc\n\n"
    line = "Project: app.csproj (context_id=5)\n  Target: Compile [ok]\n    Task: Csc [FAILED]\n\n"
    assert tools("task_timeline") == line and tools("task_timeline", project_context_id=5, project="none") == line
    assert tools("task_timeline", project="none") == "No projects matched the filter."


def test_events_and_detail(tools):
    assert tools("events", text="BAD") == "Events: 1 shown\n\n[4] Error: CS1: bad thing\n"
    assert tools("events", text="hidden") == "No events matched the filter."
    assert "[1] ProjectStarted: project=app.csproj targets=Build\n" in tools("events", kind="no kind")
    detail = tools("event_detail", index=4)
    assert "Kind: Error\n" in detail and "\nType: Error\nCode: CS1\nFile: a.cs(3,4)\nProject: app.csproj\nMessage: bad thing\nContext: project_context_id=5 target_id=2 task_id=3\n" in detail
    assert "Properties: 3 entries\nItems: 2 groups, 2 total items\n" in tools("event_detail", index=1)
    with pytest.raises(ToolError, match="out of range"):
        tools("event_detail", index=10)


def test_properties_and_items(tools):
    assert tools("properties", name="name", limit=1) == "Project: app.csproj\n  Name = one\n  ... (truncated at 1)\n\n"
    assert tools("properties", name="zzz") == "Project: app.csproj\n\n"
    assert tools("items", item_type="compile", spec="B.") == "Project: app.csproj\n  [Compile (2 items)]\n    b.cs\n\n"
    assert tools("items", item_type="compile", limit=1) == "Project: app.csproj\n  [Compile (2 items)]\n    a.cs\n      k = v\n    ... (truncated at 1)\n\n"
    assert tools("items", item_type="zzz") == "No items found matching the filter."


def test_error_context(tools):
    assert tools("error_context", index=4, radius=1) == "Context scope: task (project_context_id=5, target_id=2, task_id=3)\nShowing events around index 4:\n\n    [3] TaskStarted: task=Csc\n>>> [4] Error: CS1: bad thing\n    [6] TaskFinished: \n"
    with pytest.raises(ToolError):
        tools("error_context", index=4, radius=-1)


def test_logs_of_equal_names(spark, tmp_path):
    """A build tool's default name in two folders: two logs in tables, source, stream and tools; one that breaks off stops nothing that skips it."""
    for name, n in (("a", 2), ("b", 3)):
        w = Writer()
        for k in range(n):
            w.event(9, {"message": f"{name}{k}"}, {"diag_code": name})
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "msbuild.binlog").write_bytes(w.finished())
    root = str(tmp_path / "in")
    want = [("a/msbuild.binlog", 0), ("a/msbuild.binlog", 1), ("b/msbuild.binlog", 0), ("b/msbuild.binlog", 1), ("b/msbuild.binlog", 2)]
    found = lambda frame: sorted(map(tuple, frame.select("log_id", "event_index").collect()))
    events = read_logs(spark, root)
    assert found(events) == want and found(ops.errors(events, 1)) == [("a/msbuild.binlog", 0), ("b/msbuild.binlog", 0)]
    assert sorted(map(tuple, ops.summary(events).select("log_id", "total_events").collect())) == [("a/msbuild.binlog", 2), ("b/msbuild.binlog", 3)]
    spark.dataSource.register(BuildLogSource)
    assert found(spark.read.format("buildlog").load(root)) == want
    sessions = Sessions(spark)
    sessions.call("binlog_open", {"file": root})
    with pytest.raises(ToolError, match="several logs"):
        sessions.call("binlog_error_context", {"session": 1, "index": 1})
    text = sessions.call("binlog_error_context", {"session": 1, "index": 1, "log": "a/msbuild.binlog"})
    assert text == "Context scope: index neighborhood\nShowing events around index 1:\n\n    [0] Error: a: a0\n>>> [1] Error: a: a1\n"
    (tmp_path / "in" / "c.binlog").write_bytes((tmp_path / "in" / "a" / "msbuild.binlog").read_bytes()[:30])
    assert found(read_logs(spark, root, skip_bad=True)) == want
    assert [r["log_id"] for r in read_logs(spark, root, "failures", skip_bad=True).collect()] == ["c.binlog"]
    ingest_arriving(spark, root, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert found(spark.read.parquet(str(tmp_path / "out"))) == want


def test_feedback(tools, tmp_path):
    assert tools("feedback", file=str(tmp_path / "f0"), text="t") == f"Feedback appended to {tmp_path / 'f0'}"
    with pytest.raises(ToolError, match="missing required parameter: text"):
        tools("feedback", file="x")
    tools("feedback", file=str(tmp_path / "f"), text="t", event_indices=[1, "x", 2])
    assert json.loads((tmp_path / "f").read_text())["event_indices"] == [1, 2]


def test_rpc(spark, folder):
    sessions = Sessions(spark)
    ask = lambda **m: answer(sessions, json.dumps({"jsonrpc": "2.0", **m}))
    assert answer(sessions, "{")["error"]["code"] == -32700
    assert ask(method="ping") is None and ask(method="zzz", id=1)["error"]["code"] == -32601 and ask(method="tools/call", id=1)["error"]["code"] == -32602
    assert ask(method="tools/call", id=2, params={"name": "binlog_summary", "arguments": {"session": 9}})["result"]["isError"]
    listed = ask(method="tools/list", id=4)["result"]["tools"]
    assert [t["name"] for t in listed] == [n[1:] for n in vars(Sessions) if n.startswith("_binlog_")]
    assert {t["name"]: t["inputSchema"]["required"] for t in listed}["binlog_event_detail"] == ["session", "index"]
    opened = ask(method="tools/call", id=3, params={"name": "binlog_open", "arguments": {"file": str(folder)}})
    assert "Total events: 10" in opened["result"]["content"][0]["text"]
    assert sessions.call("binlog_close", {"session": 1}) == "Session 1 closed."


def test_source_and_stream_agree_with_batch(spark, folder, tmp_path):
    spark.dataSource.register(BuildLogSource)
    batch = read_logs(spark, str(folder)).select("log_id", "event_index", "kind", "message").collect()
    assert sorted(batch) == sorted(spark.read.format("buildlog").load(str(folder)).select("log_id", "event_index", "kind", "message").collect())
    ingest_arriving(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(batch) == sorted(spark.read.parquet(str(tmp_path / "out")).select("log_id", "event_index", "kind", "message").collect())
