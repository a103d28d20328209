"""Search predicates and grouping keys over logs and spans, from structured terms (key, value, negated)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = tuple[str, str, bool]

#: Keys that mean a level (of logs) or a status (of spans), and the spans' status names. Fixed values.
LEVEL_KEYS = ("level", "status", "severity")
STATUSES = {"error": "Error", "ok": "Ok", "unset": "Unset"}


def service_is(value: str) -> Column:
    return F.col("service_name") == value


def trace_is(value: str) -> Column:
    return F.col("trace_id") == value


def level_in(values: Iterable[str]) -> Column:
    return F.upper("severity_text").isin([v.upper() for v in values])


def status_in(values: Iterable[str]) -> Column:
    """Spans whose status is among ``values`` (error, ok, unset)."""
    if unknown := [v for v in values if v.lower() not in STATUSES]:
        raise ValueError(f"unknown span status {unknown[0]!r}")
    return F.col("status_code").isin([STATUSES[v.lower()] for v in values])


def attribute(key: str) -> Column:
    """The record's own attribute, else its resource's; null if neither has it."""
    return F.coalesce(F.col("attributes")[key], F.col("resource_attributes")[key])


def attribute_is(key: str, value: str) -> Column:
    return attribute(key) == value


def text_has(value: str, title: str) -> Column:
    """Case-insensitive substring of the title or of the record's attribute values joined by spaces."""
    sought = F.lit(value.lower())
    return F.contains(F.lower(title), sought) | F.contains(F.lower(F.array_join(F.map_values("attributes"), " ")), sought)


def _term(term: Term, title: str, spans: bool) -> Column:
    key, value, negated = term
    known = key.lower()
    if known == "":
        out = text_has(value, title)
    elif known == "service":
        out = service_is(value)
    elif known == "trace_id":
        out = trace_is(value)
    elif known in LEVEL_KEYS:
        values = [v.strip() for v in value.split(",")]
        if "" in values:
            raise ValueError(f"empty level in {value!r}")
        out = status_in(values) if spans else level_in(values)
    else:
        out = attribute_is(key, value)
    return ~out if negated else out


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def log_filter(terms: Iterable[Term]) -> Column:
    """All terms must hold. A negated attribute term also drops rows that lack the attribute."""
    return all_of(_term(t, "body", False) for t in terms)


def span_filter(terms: Iterable[Term]) -> Column:
    return all_of(_term(t, "name", True) for t in terms)


def attributes_match(filters: dict[str, str]) -> Column:
    return all_of(attribute_is(k, v) for k, v in sorted(filters.items()))


def severity() -> Column:
    """The normalised level of a log."""
    return F.coalesce(F.nullif(F.upper("severity_text"), F.lit("")), F.lit("UNSET"))


def log_is_error() -> Column:
    return F.upper("severity_text").isin("ERROR", "FATAL")


def span_is_error() -> Column:
    return F.col("status_code") == "Error"


def is_entry() -> Column:
    """Spans by which requests enter a service."""
    return F.col("kind").isin("Server", "Consumer") | (F.col("parent_span_id") == "")


def group_key(key: str, logs: bool = True) -> Column:
    if logs and key == "level":
        return severity()
    return F.coalesce(attribute(key), F.lit(""))
