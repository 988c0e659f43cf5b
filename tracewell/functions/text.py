"""Column expressions of the queries; all are built from Spark's own functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.layout import AUXILIARY, KINDS

#: Kinds of the original set; later ones have no name and no message text in listings.
NAMED_KINDS = {k: n for k, n in KINDS.items() if k <= 27 and k not in AUXILIARY}
#: Kind names that filters understand, without regard to case (two have a second spelling).
KIND_BY_NAME = {n.lower(): k for k, n in NAMED_KINDS.items()} | {"projectedevaluationstarted": 14, "projectedevaluationfinished": 15}
PREVIEW_BYTES = 120


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def folded(text: str) -> str:
    return "".join(x.lower() if x in string.ascii_uppercase else x for x in text)


def contains_folded(c: Column, needle: str) -> Column:
    """Whether c has the needle, letters A to Z in either case; an empty needle is everywhere."""
    return F.contains(ascii_lower(c), F.lit(folded(needle)))


def equals_folded(c: Column, text: str) -> Column:
    return ascii_lower(c) == F.lit(folded(text))


def byte_truncated(c: Column, most: int = PREVIEW_BYTES) -> Column:
    """At most so many UTF-8 bytes, cut at a character."""
    raw = c.cast("binary")
    shorter = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(c) <= most, c).otherwise(shorter)


def kind_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in NAMED_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(names, kind), F.lit("Unknown"))


def listed_message(extended: bool = False) -> Column:
    """An event's message for search and preview: empty for kinds after 27 (unless extended) and for events that can't be read."""
    known = F.col("decode_error").isNull() if extended else F.col("decode_error").isNull() & (F.col("kind") <= 27)
    return F.when(known, F.coalesce("message", F.lit(""))).otherwise("")


def preview(extended: bool = False) -> Column:
    """One line on an event."""
    body = F.col("body")
    targets = F.coalesce(body["target_names"], F.lit(""))
    project = F.concat(F.lit("project="), F.coalesce(body["of_project"], F.lit("?")), F.when(targets == "", "").otherwise(F.concat(F.lit(" targets="), targets)))
    diagnostic = F.concat(F.coalesce(body["diag_code"], F.lit("???")), F.lit(": "), byte_truncated(F.coalesce("message", F.lit(""))))
    return (
        F.when(F.col("decode_error").isNotNull(), "(read error)")
        .when(F.col("kind") == 3, project)
        .when(F.col("kind") == 5, F.concat(F.lit("target="), F.coalesce(body["target_name"], F.lit("?"))))
        .when(F.col("kind") == 7, F.concat(F.lit("task="), F.coalesce(body["task_name"], F.lit("?"))))
        .when(F.col("kind").isin(9, 10), diagnostic)
        .otherwise(byte_truncated(listed_message(extended)))
    )


def diagnostic_line() -> Column:
    """SEVERITY CODE in FILE(LINE,COLUMN): MESSAGE of an error or warning."""
    body = F.col("body")
    place = F.when(body["diag_line"] > 0, F.concat(F.lit("("), body["diag_line"], F.when(body["diag_column"] > 0, F.concat(F.lit(","), body["diag_column"])).otherwise(""), F.lit(")"))).otherwise("")
    severity = F.when(F.col("kind") == 9, "error").otherwise("warning")
    return F.concat(severity, F.lit(" "), F.coalesce(body["diag_code"], F.lit("???")), F.lit(" in "), F.coalesce(body["diag_file"], F.lit("<unknown>")), place, F.lit(": "), F.coalesce("message", F.lit("")))


def status(succeeded: Column) -> Column:
    return F.when(succeeded, "ok").when(~succeeded, "FAILED").otherwise("?")


def seconds(ticks: Column) -> Column:
    """Whole seconds and three digits of ticks of 100 ns, cut towards zero."""
    ms = (ticks - ticks % 10_000) / 10_000
    ms = ms.cast("long")
    whole = ((ms - ms % 1000) / 1000).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
