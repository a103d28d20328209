"""Message templates and what is shown of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What varies between messages of one kind: long hex runs and numbers. A fixed pattern.
VARYING = r"[0-9a-fA-F]{8,}|[0-9]+(?:\.[0-9]+)?"


def message_template(message: Column) -> Column:
    return F.regexp_replace(message, VARYING, "<*>")


def longest_literal(template: Column) -> Column:
    """The longest trimmed piece between the wildcards of a template; the later of equally long ones."""
    pieces = F.transform(F.split(template, r"<\*>"), lambda piece, at: F.struct(F.length(F.trim(piece)).alias("n"), at.alias("at"), F.trim(piece).alias("piece")))
    return F.array_max(pieces)["piece"]


def issue_id(service: Column, kind: Column, template: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", service, kind, template), 256), 1, 12)


def severity_of(number: Column) -> Column:
    """The level of an OTel severity number."""
    out = F.when(number >= 21, "FATAL")
    for least, name in ((17, "ERROR"), (13, "WARN"), (9, "INFO"), (5, "DEBUG"), (1, "TRACE")):
        out = out.when(number >= least, name)
    return out.otherwise("")


def labels_text(labels: Column) -> Column:
    """k=v,k=v in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
