"""The binary log format: record kinds, flag bits and payload layouts as data.

Decoder and encoder both interpret these tables, so a layout is stated once.
"""

from __future__ import annotations

#: Record kinds (fixed values of the format).
KINDS = {
    1: "BuildStarted", 2: "BuildFinished", 3: "ProjectStarted", 4: "ProjectFinished", 5: "TargetStarted", 6: "TargetFinished",
    7: "TaskStarted", 8: "TaskFinished", 9: "Error", 10: "Warning", 11: "Message", 12: "TaskCommandLine", 13: "CriticalBuildMessage",
    14: "ProjectEvaluationStarted", 15: "ProjectEvaluationFinished", 16: "ProjectImported", 17: "ProjectImportArchive", 18: "TargetSkipped",
    19: "PropertyReassignment", 20: "UninitializedPropertyRead", 21: "EnvironmentVariableRead", 22: "PropertyInitialValueSet",
    23: "NameValueList", 24: "String", 25: "TaskParameter", 26: "ResponseFileUsed", 27: "AssemblyLoad", 28: "BuildCheckMessage",
    29: "BuildCheckWarning", 30: "BuildCheckError", 31: "BuildCheckTracing", 32: "BuildCheckAcquisition", 33: "BuildSubmissionStarted", 34: "BuildCanceled",
}
END_OF_FILE, ARCHIVE, NAME_VALUES, STRING = 0, 17, 23, 24
AUXILIARY = (ARCHIVE, NAME_VALUES, STRING)
FIRST_ID = 10  # of dictionary entries; 0 is null, string 1 is empty
MIN_VERSION = 18

CONTEXT_FIELDS = ["node_id", "project_context_id", "target_id", "task_id", "submission_id", "project_instance_id", "evaluation_id"]

#: Common prefix in order of reading: flag bit, column, wire type.
PREFIX = [
    (0x0004, "message", "str"), (0x0001, "context", "ctx"), (0x0010, "thread_id", "int"), (0x0002, "help_keyword", "str"), (0x0008, "sender_name", "str"),
    (0x0020, "timestamp", "time"), (0x10000, "extended", "ext"), (0x0040, "subcategory", "str"), (0x0080, "code", "str"), (0x0100, "file", "str"),
    (0x0200, "project_file", "str"), (0x0400, "line_number", "int"), (0x0800, "column_number", "int"), (0x1000, "end_line_number", "int"),
    (0x2000, "end_column_number", "int"), (0x4000, "arguments", "strs"), (0x8000, "importance", "int"),
]

_DIAGNOSTIC = [("diag_subcategory", "str"), ("diag_code", "str"), ("diag_file", "str"), ("diag_project_file", "str"), ("diag_line", "int"), ("diag_column", "int"), ("diag_end_line", "int"), ("diag_end_column", "int")]

#: Fields after the prefix, in order: name, wire type and, where it is not in all versions, the first one that has it.
LAYOUTS: dict[int, list[tuple]] = {
    1: [("environment", "dict")],
    2: [("succeeded", "bool")],
    3: [("parent_context", "ctx?"), ("of_project", "str"), ("project_id", "int"), ("target_names", "str"), ("tools_version", "str"), ("global_properties", "dict"), ("property_list", "dict"), ("item_list", "groups")],
    4: [("of_project", "str"), ("succeeded", "bool")],
    5: [("target_name", "str"), ("of_project", "str"), ("target_file", "str"), ("parent_target", "str"), ("build_reason", "int")],
    6: [("succeeded", "bool"), ("of_project", "str"), ("target_file", "str"), ("target_name", "str"), ("items", "items")],
    7: [("task_name", "str"), ("of_project", "str"), ("task_file", "str"), ("task_assembly", "str", 20)],
    8: [("succeeded", "bool"), ("task_name", "str"), ("of_project", "str"), ("task_file", "str")],
    9: _DIAGNOSTIC,
    10: _DIAGNOSTIC,
    11: [],
    12: [("command_line", "str"), ("task_name", "str")],
    13: [],
    14: [("of_project", "str")],
    15: [("of_project", "str"), ("global_properties", "dict"), ("property_list", "dict"), ("item_list", "groups"), ("profile", "profile?")],
    16: [("import_ignored", "bool"), ("imported_project", "str"), ("unexpanded_project", "str")],
    18: [("target_file", "str"), ("target_name", "str"), ("parent_target", "str"), ("condition", "str"), ("evaluated_condition", "str"), ("originally_succeeded", "bool"), ("build_reason", "int"), ("skip_reason", "int"), ("original_context", "ctx?")],
    19: [("property_name", "str"), ("previous_value", "str"), ("new_value", "str"), ("location", "str")],
    20: [("property_name", "str")],
    21: [("property_name", "str"), ("read_line", "int", 22), ("read_column", "int", 22), ("read_file", "str", 22)],
    22: [("property_name", "str"), ("new_value", "str"), ("location", "str")],
    25: [("parameter_kind", "int"), ("item_type", "str"), ("items", "items"), ("parameter_name", "str", 21), ("property_name", "str", 21)],
    26: [("path", "str")],
    27: [("load_context", "int"), ("loading_initiator", "str"), ("assembly_name", "str"), ("path", "str"), ("mvid", "guid"), ("app_domain", "str")],
    28: [],
    29: _DIAGNOSTIC,
    30: _DIAGNOSTIC,
    31: [("tracing", "dict")],
    32: [("path", "raw"), ("of_project", "raw")],
    33: [("global_properties", "dict"), ("entry_projects", "list"), ("target_list", "list"), ("submission_flags", "int"), ("of_submission", "int")],
    34: [],
}

_PAIR = "array<struct<key:string,value:string>>"
_ITEM = f"array<struct<item_spec:string,metadata:{_PAIR}>>"
_CTX = "struct<" + ",".join(f"{c}:int" for c in CONTEXT_FIELDS) + ">"
_PROFILE = "array<struct<element_name:string,description:string,evaluation_description:string,file:string,kind:int,evaluation_pass:int,line:int,id:bigint,parent_id:bigint,hits:int,exclusive_ticks:bigint,inclusive_ticks:bigint>>"
SPARK_TYPES = {
    "bool": "boolean", "int": "int", "str": "string", "raw": "string", "dict": _PAIR, "items": _ITEM, "groups": f"array<struct<item_type:string,items:{_ITEM}>>",
    "list": "array<string>", "strs": "array<string>", "guid": "binary", "ctx?": _CTX, "profile?": _PROFILE,
}
BODY = {name: SPARK_TYPES[kind] for fields in LAYOUTS.values() for name, kind, *_ in fields}

EVENT_SCHEMA = ", ".join(
    ["log_id string", "event_index bigint", "kind int", "byte_offset bigint", "payload_len bigint", "has_context boolean"]
    + [f"{c} int" for c in CONTEXT_FIELDS]
    + ["flags int", "message string", "thread_id int", "help_keyword string", "sender_name string", "timestamp_ticks bigint", "timestamp_kind int"]
    + ["extended struct<extended_type:string,extended_metadata_index:int,extended_data:string>", "subcategory string", "code string", "file string", "project_file string"]
    + ["line_number int", "column_number int", "end_line_number int", "end_column_number int", "arguments array<string>", "importance int", "decode_error string"]
    + ["body struct<" + ",".join(f"{n}:{t}" for n, t in BODY.items()) + ">"]
)
SCHEMAS = {
    "events": EVENT_SCHEMA,
    "failures": "log_id string, path string, error string",
    "logs": "log_id string, path string, file_format_version int, min_reader_version int",
    "strings": "log_id string, string_id int, value string",
    "name_values": "log_id string, nvl_id int, pos int, key string, value string",
    "archives": "log_id string, archive_no int, content binary",
    "archive_files": "log_id string, archive_no int, entry_no int, path string, contents string",
}
