"""Payloads of each kind as bytes, field by field in the order of the format, so that no layout is tested by a writer that shares it.

String k of a log has id k and reads "s<k>"; name-value list 10 is {s10: s11}, list 11 is {s12: s13}.
"""

import gzip
import struct

import pytest

from tracewell.sources.codec import CONTEXT_FIELDS, Log
from tracewell.sources.layout import LAYOUTS

LIST_10, LIST_11 = [{"key": "s10", "value": "s11"}], [{"key": "s12", "value": "s13"}]
CONTEXT = dict(zip(CONTEXT_FIELDS, range(1, 8), strict=True))
ITEMS = [{"item_spec": "s14", "metadata": LIST_10}, {"item_spec": "s15", "metadata": None}]
DIAGNOSTIC = dict(diag_subcategory="s10", diag_code="s11", diag_file="s12", diag_project_file="s13", diag_line=1, diag_column=2, diag_end_line=3, diag_end_column=4)
PROFILE = dict(element_name="s10", description="s11", evaluation_description="s12", file="s13", kind=1, evaluation_pass=2, line=3, id=4, parent_id=5, hits=6, exclusive_ticks=7, inclusive_ticks=8)
ROOT = dict(element_name=None, description="", evaluation_description=None, file=None, kind=0, evaluation_pass=0, line=None, id=-1, parent_id=None, hits=0, exclusive_ticks=0, inclusive_ticks=0)
EIGHT = "0{}00000000000000"  # a 64-bit number under ten

CASES = [
    (1, 18, "0A", dict(environment=LIST_10)),
    (2, 18, "01", dict(succeeded=True)),
    (3, 18, "01 01020304050607 0A 05 0B 0C 0A 0B 0D 02 0E 0A 0F 00 00", dict(parent_context=CONTEXT, of_project="s10", project_id=5, target_names="s11", tools_version="s12", global_properties=LIST_10, property_list=LIST_11, item_list=[{"item_type": "s13", "items": ITEMS}])),
    (3, 18, "00 0A FFFFFFFF0F 00 01 00 00 00", dict(parent_context=None, of_project="s10", project_id=-1, target_names=None, tools_version="", global_properties=None, property_list=None, item_list=None)),
    (4, 18, "0A 01", dict(of_project="s10", succeeded=True)),
    (5, 18, "0A 0B 0C 0D 02", dict(target_name="s10", of_project="s11", target_file="s12", parent_target="s13", build_reason=2)),
    (6, 18, "01 0A 0B 0C 02 0E 0A 0F 00", dict(succeeded=True, of_project="s10", target_file="s11", target_name="s12", items=ITEMS)),
    (7, 19, "0A 0B 0C", dict(task_name="s10", of_project="s11", task_file="s12")),
    (7, 20, "0A 0B 0C 0D", dict(task_name="s10", of_project="s11", task_file="s12", task_assembly="s13")),
    (8, 18, "01 0A 0B 0C", dict(succeeded=True, task_name="s10", of_project="s11", task_file="s12")),
    (9, 18, "0A 0B 0C 0D 01 02 03 04", DIAGNOSTIC),
    (10, 18, "0A 0B 0C 0D 01 02 03 04", DIAGNOSTIC),
    (11, 18, "", None),
    (12, 18, "0A 0B", dict(command_line="s10", task_name="s11")),
    (13, 18, "", None),
    (14, 18, "0A", dict(of_project="s10")),
    (15, 18, "0A 0A 0B 0D 02 0E 0A 0F 00 00 00", dict(of_project="s10", global_properties=LIST_10, property_list=LIST_11, item_list=[{"item_type": "s13", "items": ITEMS}], profile=None)),
    (15, 18, "0A 00 00 00 01 02 0A 0B 0C 0D 01 02 01 03" + EIGHT.format(4) + "01" + EIGHT.format(5) + "06" + EIGHT.format(7) + EIGHT.format(8) + "00 01 00 00 00 00 00" + "FF" * 8 + "00 00" + "00" * 16, dict(of_project="s10", global_properties=None, property_list=None, item_list=None, profile=[PROFILE, ROOT])),
    (16, 18, "01 0A 0B", dict(import_ignored=True, imported_project="s10", unexpanded_project="s11")),
    (18, 18, "0A 0B 0C 0D 0E 01 02 03 01 01020304050607", dict(target_file="s10", target_name="s11", parent_target="s12", condition="s13", evaluated_condition="s14", originally_succeeded=True, build_reason=2, skip_reason=3, original_context=CONTEXT)),
    (19, 18, "0A 0B 0C 0D", dict(property_name="s10", previous_value="s11", new_value="s12", location="s13")),
    (20, 18, "0A", dict(property_name="s10")),
    (21, 21, "0A", dict(property_name="s10")),
    (21, 22, "0A 01 02 0B", dict(property_name="s10", read_line=1, read_column=2, read_file="s11")),
    (22, 18, "0A 0B 0C", dict(property_name="s10", new_value="s11", location="s12")),
    (25, 20, "03 0A 02 0E 0A 0F 00", dict(parameter_kind=3, item_type="s10", items=ITEMS)),
    (25, 21, "03 0A 02 0E 0A 0F 00 0B 0C", dict(parameter_kind=3, item_type="s10", items=ITEMS, parameter_name="s11", property_name="s12")),
    (26, 18, "0A", dict(path="s10")),
    (27, 18, "02 0A 0B 0C 000102030405060708090A0B0C0D0E0F 0D", dict(load_context=2, loading_initiator="s10", assembly_name="s11", path="s12", mvid=bytes(range(16)), app_domain="s13")),
    (28, 18, "", None),
    (29, 18, "0A 0B 0C 0D 01 02 03 04", DIAGNOSTIC),
    (30, 18, "0A 0B 0C 0D 01 02 03 04", DIAGNOSTIC),
    (31, 18, "0A", dict(tracing=LIST_10)),
    (32, 18, "03 C3A962 01 70", dict(path="éb", of_project="p")),
    (33, 18, "0A 02 0A 0B 01 0C 03 04", dict(global_properties=LIST_10, entry_projects=["s10", "s11"], target_list=["s12"], submission_flags=3, of_submission=4)),
    (34, 18, "", None),
]


def log_with(kind: int, version: int, payload: bytes) -> Log:
    records = [(24, f"s{k}".encode()) for k in range(10, 20)] + [(23, bytes([1, 10, 11])), (23, bytes([1, 12, 13])), (kind, payload)]
    return Log(gzip.compress(struct.pack("<ii", version, 18) + b"".join(bytes([k, len(p)]) + p if len(p) < 128 else bytes([k, len(p) & 127 | 128, len(p) >> 7]) + p for k, p in records) + b"\0"))


@pytest.mark.parametrize(("kind", "version", "fields", "body"), CASES)
def test_fields_of_each_kind(kind, version, fields, body):
    row = next(log_with(kind, version, b"\0" + bytes.fromhex(fields)).events(strict=True))
    assert row["kind"] == kind and row["body"] == body and not row["has_context"]
    if fields:  # the last byte belongs to the last field
        broken = next(log_with(kind, version, b"\0" + bytes.fromhex(fields)[:-1]).events())
        assert broken["decode_error"].startswith("LogError") and "body" not in broken


def test_every_kind_has_bytes():
    assert {kind for kind, *_ in CASES} == set(LAYOUTS)


def test_all_prefix_fields():
    """All flags at once: each field stands where the format has it, and numbers whose flags are off are 0."""
    flags = bytes.fromhex("FFFF07")  # 0x1FFFF
    fields = "0A 01020304050607 08 0B 0C 00E1F50500000000 01 0D 09 0E 0F 10 11 12 0B 0C 0D 0E 02 0A 00 02"
    row = next(log_with(11, 18, flags + bytes.fromhex(fields)).events(strict=True))
    expected = dict(message="s10", **CONTEXT, thread_id=8, help_keyword="s11", sender_name="s12", timestamp_ticks=100_000_000, timestamp_kind=1, subcategory="s15", code="s16", file="s17", project_file="s18")
    expected["extended"] = {"extended_type": "s13", "extended_metadata_index": 9, "extended_data": "s14"}
    expected |= dict(line_number=11, column_number=12, end_line_number=13, end_column_number=14, arguments=["s10", None], importance=2)
    assert {k: row[k] for k in expected} == expected and row["has_context"] and row["flags"] == 0x1FFFF
    bare = next(log_with(11, 18, b"\0").events(strict=True))
    assert bare["thread_id"] == bare["line_number"] == bare["importance"] == 0 and bare.get("message") is None


def test_offsets_and_lengths():
    """Where a record begins in the inflated stream, and its payload's bytes: 8 of header, 10 strings of 5, two lists of 5."""
    row = next(log_with(20, 18, b"\0\x0a").events())
    assert (row["byte_offset"], row["payload_len"]) == (8 + 10 * 5 + 2 * 5, 2)
