"""The schemas of the three signals and of the alert tables. Missing columns of older files read as null."""

from __future__ import annotations

LOGS_DDL = (
    "time_unix_nano bigint, observed_time_unix_nano bigint, service_name string, severity_number int, severity_text string, body string, "
    "trace_id string, span_id string, scope_name string, attributes map<string,string>, resource_attributes map<string,string>"
)
SPANS_DDL = (
    "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time_unix_nano bigint, end_time_unix_nano bigint, "
    "duration_nano bigint, status_code string, status_message string, service_name string, scope_name string, attributes map<string,string>, "
    "resource_attributes map<string,string>, events array<struct<time_unix_nano:bigint,name:string,attributes:map<string,string>>>"
)
POINTS_DDL = (
    "metric_name string, type string, unit string, temporality string, is_monotonic boolean, series_id bigint, service_name string, scope_name string, "
    "attributes map<string,string>, resource_attributes map<string,string>, start_time_unix_nano bigint, time_unix_nano bigint, value double, "
    "count bigint, sum double, min double, max double, explicit_bounds array<double>, bucket_counts array<bigint>"
)
#: By signal, which is also the name of its folder.
SCHEMAS = {"logs": LOGS_DDL, "spans": SPANS_DDL, "metric_points": POINTS_DDL}

#: The time by which a row is partitioned and selected, and the order within a file, by signal.
TIME = {"logs": "time_unix_nano", "spans": "start_time_unix_nano", "metric_points": "time_unix_nano"}
SORTED_BY = {
    "logs": ["service_name", "time_unix_nano"],
    "spans": ["trace_id", "start_time_unix_nano"],
    "metric_points": ["metric_name", "series_id", "time_unix_nano"],
}

RULES_DDL = (
    "id string, name string, kind string, metric string, agg string, filters map<string,string>, terms array<struct<key:string,value:string,negated:boolean>>, "
    "group_by array<string>, op string, threshold double, window_seconds int, for_seconds int, channels array<string>, enabled boolean"
)
STATES_DDL = "rule_id string, `group` string, labels map<string,string>, status string, since bigint, value double"
EVENTS_DDL = "rule_id string, rule_name string, labels map<string,string>, status string, value double, at bigint"

NANOS = 1_000_000_000
HOUR = 3600 * NANOS
UNKNOWN_SERVICE = "unknown_service"
