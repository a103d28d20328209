"""Flattening of nested telemetry payloads (resource, scope, record) to one row per record."""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import severity_of
from ..schema import UNKNOWN_SERVICE

#: A typed value is kept as JSON text until it is shown.
_ATTRIBUTES = "array<struct<key:string,value:string>>"
_MAP = T.MapType(T.StringType(), T.StringType())
_RESOURCE = f"resource:struct<attributes:{_ATTRIBUTES}>"
_SCOPE = "scope:struct<name:string>"
#: Names of enum numbers, and the level that each four severity numbers begin with. Fixed values.
KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
STATUS_CODES = ("Unset", "Ok", "Error")
TEMPORALITIES = ("Unspecified", "Delta", "Cumulative")
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LOGS = (
    f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<{_SCOPE},logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,"
    f"severityNumber:string,severityText:string,body:string,traceId:string,spanId:string,attributes:{_ATTRIBUTES}>>>>>>"
)
SPANS = (
    f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<{_SCOPE},spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,"
    f"kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRIBUTES},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES}>>>>>>>>"
)
_POINTS = (
    f"array<struct<attributes:{_ATTRIBUTES},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string,"
    "count:string,sum:double,min:double,max:double,explicitBounds:array<double>,bucketCounts:array<string>>>"
)
_OF_KIND = f"struct<dataPoints:{_POINTS},aggregationTemporality:string,isMonotonic:boolean>"
METRICS = (
    f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<{_SCOPE},metrics:array<struct<name:string,unit:string,gauge:{_OF_KIND},sum:{_OF_KIND},"
    f"histogram:{_OF_KIND},exponentialHistogram:{_OF_KIND},summary:{_OF_KIND}>>>>>>"
)


#: What JSON escapes in a string, and the signs that HTML knows.
_ESCAPED = {n: f"\\u{n:04X}" for n in range(32)} | {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"} | {ord(c): f"\\u{ord(c):04x}" for c in "&<>"}
_SPECIAL = {"NaN": "nan", "INF": "infinity", "+INF": "infinity", "Infinity": "infinity", "+Infinity": "infinity", "-INF": "-infinity", "-Infinity": "-infinity"}


def _number(x: float) -> str:
    """A double as JSON has it: no fraction if there is none, an exponent only below 1e-6 and from 1e21 on."""
    if x != x or x in (np.inf, -np.inf):
        return "nan" if x != x else "infinity" if x > 0 else "-infinity"
    if 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(repr(x)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    digits, _, power = repr(x).partition("e")
    return f"{digits}e{int(power):+d}" if x else "0"


def _plain(value: object) -> str | None:
    """A field that should hold text: what is none is kept as JSON."""
    if value is None or type(value) is str:
        return value
    return str(value) if type(value) is int else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _shown(value: object, within: bool) -> str | None:
    """A parsed typed value as text, ``within`` lists and maps as JSON; None if it is of no kind."""
    if not isinstance(value, dict):
        return None
    for kind in ("stringValue", "bytesValue", "intValue"):
        if (text := _plain(value.get(kind))) is not None:
            return f'"{text.translate(_ESCAPED)}"' if within and kind != "intValue" else text
    double, truth = value.get("doubleValue"), value.get("boolValue")
    if isinstance(double, int | float) and not isinstance(double, bool):
        return _number(float(double))
    if isinstance(double, str) and double in _SPECIAL:
        return _SPECIAL[double]
    if isinstance(truth, bool):
        return "true" if truth else "false"
    listed, mapped = value.get("arrayValue"), value.get("kvlistValue")
    items = lambda body: body["values"] if isinstance(body.get("values"), list) else []
    if isinstance(listed, dict):
        return "[" + ",".join(_shown(x, True) or "null" for x in items(listed)) + "]"
    if isinstance(mapped, dict):
        last = {_plain(e.get("key")) or "": e.get("value") for e in items(mapped) if isinstance(e, dict)}
        return "{" + ",".join(f'"{k.translate(_ESCAPED)}":{_shown(last[k], True) or "null"}' for k in sorted(last)) + "}"
    return None


def _value_text(raw: str | None) -> str:
    try:
        return (_shown(json.loads(raw), False) or "").encode("utf-8", "replace").decode() if raw else ""
    except (ValueError, OverflowError, RecursionError):  # no JSON, or beyond what can be read
        return ""


def _texts(raw: pa.Array) -> pa.Array:
    """Typed values as text; equal ones of a batch are read once."""
    of = raw.dictionary_encode()
    return pc.fill_null(pa.array(map(_value_text, of.dictionary.to_pylist()), pa.string()).take(of.indices), "")


def _maps(lists: pa.Array) -> pa.Array:
    """Lists of attributes as maps: entries without a key go, of those of one key the last stays in its place."""
    entries, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    keys = pc.struct_field(entries, "key")
    codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    named = np.flatnonzero(codes >= 0)[::-1]
    _, first = np.unique(parents[named] * (len(entries) + 1) + codes[named], return_index=True)
    kept = np.sort(named[first])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[kept], minlength=len(lists)))])
    taken = pa.array(kept, pa.int64())
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys.take(taken), _texts(pc.struct_field(entries, "value").take(taken)))


@F.arrow_udf(T.StringType())
def _text_of(raw: pa.Array) -> pa.Array:
    return _texts(raw)


@F.arrow_udf(_MAP)
def _map_of(attributes: pa.Array) -> pa.Array:
    return _maps(attributes)


@F.arrow_udf(T.ArrayType(_MAP))
def _maps_of(lists: pa.Array) -> pa.Array:
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), _maps(lists.flatten()))


def any_value(raw: Column) -> Column:
    """A typed value (JSON text such as ``{"intValue": "5"}``) as text: scalars as they are, bytes in base64, lists and maps as JSON.

    Keys of maps come in order. Null, a value of no kind, and what is no JSON is empty. Like ``attrs_to_map`` this has no place in a lambda.
    """
    return _text_of(raw)


def attrs_to_map(attributes: Column) -> Column:
    """A list of attributes (key, typed value as JSON text) as a map of strings; of a repeated key the last value holds. Null is an empty map."""
    return _map_of(attributes.cast(_ATTRIBUTES))


def _enum(text: Column, prefix: str, names: tuple[str, ...]) -> Column:
    """The name of an enum value that is given as number, as prefixed name, or as name; absent is the first, an unknown one is empty."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("0")), f"(?i)^{prefix}", ""))
    out = F.when(plain == "0", names[0])
    for number, name in enumerate(names):
        out = out.when(plain.isin(str(number), name.lower()), name)
    return out.otherwise("")


def _severity_number(text: Column) -> Column:
    """A severity given as number or as name, which may end in its step (2 to 4) within the level."""
    name = F.upper(F.regexp_replace(text, "(?i)^SEVERITY_NUMBER_", ""))
    out = F.when(text.rlike("^[0-9]+$"), text.cast("int"))
    for k, level in enumerate(SEVERITIES):
        out = out.when(name.rlike(f"^{level}[2-4]?$"), F.lit(4 * k + 1) + F.coalesce(F.nullif(F.regexp_extract(name, "[2-4]$", 0), F.lit("")).cast("int") - 1, F.lit(0)))
    return F.coalesce(out, F.lit(0))


def _id(text: Column) -> Column:
    """A trace or span id in lower case; one of zeros alone is absent."""
    return F.when(F.coalesce(text, F.lit("")).rlike("^0*$"), "").otherwise(F.lower(text))


def _time(text: Column) -> Column:
    return F.coalesce(text.cast("long"), F.lit(0).cast("long"))


def _records(payloads: DataFrame, schema: str, top: str, scopes: str, records: str, column: str, *keep: str) -> DataFrame:
    """One row per record ``r`` with its ``scope_name``, ``resource_attributes`` and ``service_name``."""
    rows = payloads.select(F.from_json(column, schema).alias("p"), *keep).select(F.explode(f"p.{top}").alias("top"), *keep)
    resource = attrs_to_map(F.col("top.resource.attributes"))
    rows = rows.select(resource.alias("resource_attributes"), F.explode(f"top.{scopes}").alias("s"), *keep)
    service = F.coalesce(F.nullif(F.col("resource_attributes")["service.name"], F.lit("")), F.lit(UNKNOWN_SERVICE))
    return rows.select("resource_attributes", service.alias("service_name"), F.coalesce("s.scope.name", F.lit("")).alias("scope_name"), F.explode(f"s.{records}").alias("r"), *keep)


def flatten_logs(payloads: DataFrame, received_col: str = "received", column: str = "payload") -> DataFrame:
    """The logs of JSON payloads. A log's time is its timestamp, else when it was observed, else when it was received."""
    rows = _records(payloads, LOGS, "resourceLogs", "scopeLogs", "logRecords", column, received_col)
    seen = F.nullif(_time(F.col("r.observedTimeUnixNano")), F.lit(0))
    number = _severity_number(F.col("r.severityNumber"))
    return rows.select(
        F.coalesce(F.nullif(_time(F.col("r.timeUnixNano")), F.lit(0)), seen, F.col(received_col)).alias("time_unix_nano"),
        F.coalesce(seen, F.col(received_col)).alias("observed_time_unix_nano"), "service_name", number.alias("severity_number"),
        F.coalesce(F.nullif(F.col("r.severityText"), F.lit("")), severity_of(number)).alias("severity_text"), any_value(F.col("r.body")).alias("body"),
        _id(F.col("r.traceId")).alias("trace_id"), _id(F.col("r.spanId")).alias("span_id"), "scope_name", attrs_to_map(F.col("r.attributes")).alias("attributes"),
        "resource_attributes",
    )


def flatten_spans(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The spans of JSON payloads; a negative length is 0."""
    rows = _records(payloads, SPANS, "resourceSpans", "scopeSpans", "spans", column)
    begin, end = _time(F.col("r.startTimeUnixNano")), _time(F.col("r.endTimeUnixNano"))
    maps = _maps_of(F.transform("r.events", lambda e: e["attributes"]))
    event = lambda e, m: F.struct(_time(e["timeUnixNano"]).alias("time_unix_nano"), e["name"].alias("name"), m.alias("attributes"))
    none = F.array().cast("array<struct<time_unix_nano:bigint,name:string,attributes:map<string,string>>>")
    return rows.select(
        _id(F.col("r.traceId")).alias("trace_id"), _id(F.col("r.spanId")).alias("span_id"), _id(F.col("r.parentSpanId")).alias("parent_span_id"), F.coalesce("r.name", F.lit("")).alias("name"),
        _enum(F.col("r.kind"), "SPAN_KIND_", KINDS).alias("kind"), begin.alias("start_time_unix_nano"), end.alias("end_time_unix_nano"),
        F.greatest(end - begin, F.lit(0)).alias("duration_nano"), _enum(F.col("r.status.code"), "STATUS_CODE_", STATUS_CODES).alias("status_code"),
        F.coalesce("r.status.message", F.lit("")).alias("status_message"), "service_name", "scope_name", attrs_to_map(F.col("r.attributes")).alias("attributes"),
        "resource_attributes", F.coalesce(F.zip_with("r.events", maps, event), none).alias("events"),
    )


def flatten_metric_points(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per data point of any of the five kinds, in one pass. Series ids are hashes of name, type and both maps, whatever their order."""
    rows = _records(payloads, METRICS, "resourceMetrics", "scopeMetrics", "metrics", column)
    kinds = {"gauge": "Gauge", "sum": "Sum", "histogram": "Histogram", "exponentialHistogram": "ExponentialHistogram", "summary": "Summary"}
    of = lambda field, kind: F.transform(f"r.{field}.dataPoints", lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("d")))
    points = F.flatten(F.array_compact(F.array(*(of(field, kind) for field, kind in kinds.items()))))
    temporality = F.coalesce("r.sum.aggregationTemporality", "r.histogram.aggregationTemporality", "r.exponentialHistogram.aggregationTemporality")
    rows = rows.select(
        F.coalesce("r.name", F.lit("")).alias("metric_name"), F.coalesce("r.unit", F.lit("")).alias("unit"), temporality.alias("given"), F.coalesce("r.sum.isMonotonic", F.lit(False)).alias("grows"),
        "service_name", "scope_name", "resource_attributes", F.explode(points).alias("point"),
    )
    rows = rows.select("*", F.col("point.kind").alias("type"), F.col("point.d").alias("d")).withColumn("attributes", attrs_to_map(F.col("d.attributes")))
    kind = F.col("type")
    number, buckets, extremes = kind.isin("Gauge", "Sum"), kind == "Histogram", kind.isin("Histogram", "ExponentialHistogram")
    entries = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    none = lambda t: F.array().cast(f"array<{t}>")
    return rows.select(
        "metric_name", "type", "unit", F.when(extremes | (kind == "Sum"), _enum(F.col("given"), "AGGREGATION_TEMPORALITY_", TEMPORALITIES)).otherwise("").alias("temporality"),
        ((kind == "Sum") & F.col("grows")).alias("is_monotonic"), F.xxhash64("metric_name", "type", entries("attributes"), entries("resource_attributes")).alias("series_id"),
        "service_name", "scope_name", "attributes", "resource_attributes", _time(F.col("d.startTimeUnixNano")).alias("start_time_unix_nano"), _time(F.col("d.timeUnixNano")).alias("time_unix_nano"),
        F.when(number, F.coalesce(F.col("d.asDouble"), F.col("d.asInt").cast("double"), F.lit(0.0))).alias("value"),
        F.when(~number, _time(F.col("d.count"))).alias("count"), F.when(~number, F.coalesce("d.sum", F.lit(0.0))).alias("sum"),
        F.when(extremes, F.col("d.min")).alias("min"), F.when(extremes, F.col("d.max")).alias("max"),
        F.coalesce(F.when(buckets, F.col("d.explicitBounds")), none("double")).alias("explicit_bounds"),
        F.coalesce(F.when(buckets, F.transform("d.bucketCounts", _time)), none("bigint")).alias("bucket_counts"),
    )
