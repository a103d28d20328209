"""Queries over the stored layout, payloads and streams. What they store is derived from the given tables, in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.predicates import group_key
from ..operators import alerts, logs, metrics
from ..operators.iteration import shared_folder
from ..schema import RULES_DDL
from ..sources import derived, landing, payloads, scan, series, storage, text_index
from ..streaming import jobs
from .alert_queries import ISLANDS, alert_ticks
from .metric_queries import FILTERED, GROWN, GUARDED, RATE, STEP, histogram_sql, percentile_sql, rate_sql
from .registry import D10, D20, DAY, FEB, HOUR, JAN, Y97, query
from .span_queries import ORIGIN, UP
from .views import LOGS, POINTS, SPANS

_ROW = "service_name, t AS time_unix_nano, span_id, body"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark.range(1))}/signals-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, logs: DataFrame) -> str:
    root = _folder(spark)
    storage.write_signal(logs, "logs", root)
    return root


@query("scan_logs", f"WITH {LOGS} SELECT {_ROW} FROM logs")
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, derived.logs(spark, sf_dir))
    return scan.read_signal(spark, root, "logs").select("service_name", "time_unix_nano", "span_id", "body")


@query("scan_time_pruned", f"WITH {LOGS} SELECT {_ROW} FROM logs WHERE t >= {D10 + 1} AND t < {D10 + 30 * HOUR // 4}")
def scan_time_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, derived.logs(spark, sf_dir))
    return scan.scan(spark, root, "logs", D10 + 1, D10 + 30 * HOUR // 4).select("service_name", "time_unix_nano", "span_id", "body")


@query("scan_with_landing", f"WITH {LOGS} SELECT service_name, count(*) AS logs FROM logs GROUP BY service_name")
def scan_with_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, of which two have been stored and one has not; one comes again after it has been stored."""
    logs, root, time = derived.logs(spark, sf_dir), _folder(spark), F.col("time_unix_nano")
    batches = [logs.filter(time < D10), logs.filter((time >= D10) & (time < D20)), logs.filter(time >= D20)]
    for n in (0, 1):
        landing.land(batches[n], "logs", root, n)
    landing.promote(spark, root, "logs")
    for n in (1, 2):
        landing.land(batches[n], "logs", root, n)
    both = landing.current(spark, root, "logs")
    return both.groupBy("service_name").agg(F.count(F.lit(1)).alias("logs"))


@query("write_partitioned", f"""WITH {LOGS} SELECT CAST(t // {DAY} AS INTEGER) AS day, CAST(t // {HOUR} % 24 AS INTEGER) AS hour, count(*) AS logs FROM logs GROUP BY 1, 2""")
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.read_signal(spark, _stored(spark, derived.logs(spark, sf_dir)), "logs")
    return rows.groupBy(F.unix_date("date").alias("day"), "hour").agg(F.count(F.lit(1)).alias("logs"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hours of logs that were written in two batches."""
    logs, root = derived.logs(spark, sf_dir), _folder(spark)
    storage.write_signal(logs.filter(F.col("span_id").cast("long") % 2 == 0), "logs", root)
    storage.write_signal(logs.filter(F.col("span_id").cast("long") % 2 == 1), "logs", root)
    return storage.stored_files(spark, root, "logs").select(F.unix_date("date").alias("day"), "hour", "signal", "hour_end", "files")


_HOURS = f"hours AS (SELECT t // {HOUR} AS h, count(DISTINCT CAST(span_id AS BIGINT) % 2) AS files FROM logs GROUP BY 1)"
_FILE = f"SELECT CAST(h // 24 AS INTEGER) AS day, CAST(h % 24 AS INTEGER) AS hour, 'logs' AS signal, (h + 1) * {HOUR} AS hour_end, files FROM hours"


@query("compaction_candidates", f"WITH {LOGS}, {_HOURS} {_FILE} WHERE files > 1 AND (h + 1) * {HOUR} + {storage.GRACE} <= {D20 + HOUR // 60}")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.compaction_candidates(_files(spark, sf_dir), D20 + HOUR // 60)


@query("retention_expired", f"WITH {LOGS}, {_HOURS} {_FILE} WHERE (h + 1) * {HOUR} <= {D20 - storage.RETENTION}")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.expired_partitions(_files(spark, sf_dir), D20)


@query("retention_deletes", f"WITH {LOGS}, kept AS (SELECT t // {HOUR} AS h FROM logs WHERE (t // {HOUR} + 1) * {HOUR} > {D20 - storage.RETENTION}) SELECT CAST(h // 24 AS INTEGER) AS day, count(*) AS logs FROM kept GROUP BY 1")
def retention_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, derived.logs(spark, sf_dir))
    storage.expire(spark, root, "logs", D20)
    return scan.read_signal(spark, root, "logs").groupBy(F.unix_date("date").alias("day")).agg(F.count(F.lit(1)).alias("logs"))


@query("retention_by_signal", f"WITH {LOGS}, {_HOURS} {_FILE} WHERE (h + 1) * {HOUR} <= {D20 - 2 * DAY}")
def retention_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.expired_partitions(_files(spark, sf_dir), D20, {"logs": 2 * DAY, "spans": 0})


@query("compacted", f"WITH {LOGS} SELECT CAST(t // {DAY} AS INTEGER) AS day, CAST(t // {HOUR} % 24 AS INTEGER) AS hour, count(*) AS logs, 1 AS files FROM logs GROUP BY 1, 2")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, root = derived.logs(spark, sf_dir), _folder(spark)
    for part in (0, 1):
        storage.write_signal(logs.filter(F.col("span_id").cast("long") % 2 == part), "logs", root)
    storage.compact_hours(spark, root, "logs", FEB + DAY)
    rows = scan.read_signal(spark, root, "logs")
    files = F.count_distinct("_metadata.file_path").cast("int").alias("files")
    return rows.groupBy(F.unix_date("date").alias("day"), "hour").agg(F.count(F.lit(1)).alias("logs"), files)


@query("search_logs_signed", f"""WITH {LOGS} SELECT t AS time_unix_nano, span_id, body FROM logs
    WHERE t >= {JAN} AND t < {FEB} AND level = 'ERROR' AND (contains(lower(body), 'user 7 value') OR contains(lower(concat_ws(' ', event_type, k)), 'user 7 value'))
    ORDER BY t DESC, span_id, body LIMIT 100""")
def search_logs_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search of stored logs that opens those files alone whose signatures have the text's trigrams."""
    root, terms = _folder(spark), [("", "User 7 value", False), ("level", "error", False)]
    storage.write_signal(derived.logs(spark, sf_dir), "logs", root, signed=True)
    return logs.search_logs(text_index.scan_text(spark, root, "logs", terms, JAN, FEB), terms, JAN, FEB).select("time_unix_nano", "span_id", "body")


@query("signal_counts", f"""WITH {SPANS}, {LOGS}, {POINTS} SELECT 'logs' AS signal, count(*) AS items FROM logs UNION ALL SELECT 'spans', count(*) FROM spans UNION ALL
    SELECT 'metric_points', (SELECT count(*) FROM ev) * 3 + (SELECT count(*) FROM sizes) * 3""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.signal_counts(derived.logs(spark, sf_dir), derived.spans(spark, sf_dir), derived.metric_points(spark, sf_dir))


def _value(**kinds: Column) -> Column:
    """A typed value of the kind whose column is not null."""
    return F.struct(*(c.alias(k) for k, c in kinds.items()))


def _text(value: Column) -> Column:
    return _value(stringValue=value)


def _attributes(*columns: str | Column) -> Column:
    """Payload attributes of maps, in the form of typed lists."""
    entry = lambda e: F.struct(e["key"].alias("key"), _text(e["value"]).alias("value"))
    return F.flatten(F.array(*(F.transform(F.map_entries(c), entry) for c in columns)))


def _payload(rows: DataFrame, keys: list[Column], kind: str, records: str, record: Column, *more: Column) -> DataFrame:
    """Nested payloads as JSON: a resource and a scope around the records of each group of ``keys``, which bound a payload's size.

    Strings of a # and digits become numbers, as exporters write enums.
    """
    resource = F.transform_values("resource_attributes", lambda k, v: F.when((k == "service.name") & (v == "svc-4"), "").otherwise(v))
    numbered = lambda text: F.regexp_replace(text, '"#([0-9]+)"', "$1")
    of = F.to_json(F.struct(_attributes(resource).alias("attributes"))).alias("resource")
    if not more:  # records are text before they are grouped
        named = [F.col(k) if isinstance(k, str) else k for k in keys]
        grouped = rows.select(of, F.struct(*named).alias("keys"), numbered(F.to_json(record)).alias("record")).groupBy("resource", "keys").agg(F.collect_list("record").alias("records"))
        begin, end = F.concat(F.lit(f'{{"resource{kind}":[{{"resource":'), "resource", F.lit(f',"scope{kind}":[{{"scope":{{"name":"derived"}},"{records}":[')), F.lit("]}]}]}")
        return grouped.select("keys.*", F.concat(begin, F.array_join("records", ","), end).alias("payload"))
    grouped = rows.groupBy(_attributes(resource).alias("resource"), *keys).agg(F.collect_list(record).alias(records))
    scope = F.array(F.struct(F.struct(F.lit("derived").alias("name")).alias("scope"), *more))
    tree = F.struct(F.array(F.struct(F.struct(F.col("resource").alias("attributes")).alias("resource"), scope.alias(f"scope{kind}"))).alias(f"resource{kind}"))
    return grouped.withColumn("payload", numbered(F.to_json(tree)))


def _numbered() -> Column:
    return F.col("span_id").cast("long")


#: Records in a payload at most.
RECORDS = 500


def _body() -> Column:
    """The body of a log as a typed value: text, whole number, fraction, truth, list or map by turns."""
    turn = lambda k: _numbered() % 6 == k
    half = _value(doubleValue=_numbered().cast("double") / 2)
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    inner = F.struct(F.array(pair("z", _value(intValue=F.col("span_id")).withField("stringValue", F.lit(None).cast("string"))), pair("a", _value(intValue=F.lit(None).cast("string")).withField("stringValue", F.lit("<x>")))).alias("values"))
    return _value(
        stringValue=F.when(turn(0), F.col("body")), intValue=F.when(turn(1), F.col("span_id")), doubleValue=F.when(turn(2), _numbered().cast("double") / 4),
        boolValue=F.when(turn(3), F.col("trace_id") == ""), arrayValue=F.when(turn(4), F.struct(F.array(half, half).alias("values"))), kvlistValue=F.when(turn(5), inner),
    )


def log_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived logs as nested payloads of a resource; every third log has only an observed time and a number for its level."""
    odd = _numbered() % 3 == 0
    level = F.when(odd & (F.col("severity_number") == 17), "SEVERITY_NUMBER_ERROR").otherwise(F.concat(F.lit("#"), F.col("severity_number").cast("string")))
    record = F.struct(
        F.when(~odd, F.col("time_unix_nano").cast("string")).alias("timeUnixNano"), F.col("time_unix_nano").cast("string").alias("observedTimeUnixNano"),
        level.alias("severityNumber"), F.when(~odd, F.col("severity_text")).alias("severityText"), _body().alias("body"),
        F.coalesce(F.nullif("trace_id", F.lit("")), F.lit("0000")).alias("traceId"), F.col("span_id").alias("spanId"), _attributes("attributes").alias("attributes"),
    )
    keys = [F.expr(f"time_unix_nano div {HOUR}L").alias("hour"), F.expr(f"cast(span_id as bigint) div {RECORDS}L").alias("part")]
    return _payload(derived.logs(spark, sf_dir), keys, "Logs", "logRecords", record).select("payload", (F.col("hour") * HOUR).alias("received"))


_SHOWN_BODY = """CASE CAST(span_id AS BIGINT) % 6 WHEN 0 THEN body WHEN 1 THEN span_id
        WHEN 2 THEN CAST(CAST(span_id AS BIGINT) // 4 AS VARCHAR) || CASE CAST(span_id AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END
        WHEN 3 THEN CASE WHEN trace_id = '' THEN 'true' ELSE 'false' END
        WHEN 4 THEN '[' || CAST(CAST(span_id AS BIGINT) // 2 AS VARCHAR) || ',' || CAST(CAST(span_id AS BIGINT) // 2 AS VARCHAR) || ']'
        ELSE '{"a":"\\u003cx\\u003e","z":' || span_id || '}' END"""
_FLAT_LOGS = f"""WITH {LOGS} SELECT t AS time_unix_nano, CASE WHEN service_name = 'svc-4' THEN 'unknown_service' ELSE service_name END AS service_name, severity_number, {_SHOWN_BODY} AS body,
    CASE WHEN trim(trace_id, '0') = '' THEN '' ELSE trace_id END AS trace_id, CASE WHEN CAST(span_id AS BIGINT) = 0 THEN '' ELSE span_id END AS span_id,
    CASE WHEN CAST(span_id AS BIGINT) % 3 = 0 OR severity_text = '' THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE '' END
         ELSE severity_text END AS severity_text, event_type, coalesce(k, '') AS k, env FROM logs"""


def _flat(logs: DataFrame) -> DataFrame:
    return logs.select(
        "time_unix_nano", "service_name", "severity_number", "body", "trace_id", "span_id", "severity_text", F.col("attributes")["event.type"].alias("event_type"),
        F.coalesce(F.col("attributes")["k"], F.lit("")).alias("k"), F.col("resource_attributes")["deployment.environment.name"].alias("env"),
    )


@query("flatten_logs", _FLAT_LOGS)
def flatten_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(payloads.flatten_logs(log_payloads(spark, sf_dir)))


def _named_or_numbered(names: tuple[str, ...], prefix: str, value: Column) -> Column:
    """An enum value as exporters write it: by its number in even traces, by its prefixed name in odd ones."""
    even = F.col("trace_id").cast("long") % 2 == 0
    out = F.lit(None).cast("string")
    for number, name in enumerate(names):
        out = F.when(value == name, F.when(even, f"#{number}").otherwise(f"{prefix}{name.upper()}")).otherwise(out)
    return out


@query("flatten_spans", f"""WITH {SPANS} SELECT CASE WHEN trim(trace_id, '0') = '' THEN '' ELSE trace_id END AS trace_id, CASE WHEN trim(span_id, '0') = '' THEN '' ELSE span_id END AS span_id,
    CASE WHEN trim(parent_span_id, '0') = '' THEN '' ELSE parent_span_id END AS parent_span_id, name, kind, t AS start_time_unix_nano,
    CASE WHEN CAST(trace_id AS BIGINT) % 7 = 0 THEN 0 ELSE d END AS duration_nano, status_code, status_message, service_name, version,
    '[' || CAST(d AS VARCHAR) || ',"' || v1 || '",null]' AS listed FROM spans""")
def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("trace_id").cast("long") % 7 == 0, F.col("start_time_unix_nano") - 1).otherwise(F.col("end_time_unix_nano"))
    null = F.lit(None).cast("string")
    values = [_value(intValue=F.col("duration_nano").cast("string"), stringValue=null), _value(intValue=null, stringValue=F.coalesce(*(F.col("attributes")[k] for k in ("order.status", "line.status")))), _value(intValue=null, stringValue=null)]
    listed = F.struct(F.lit("listed").alias("key"), _value(stringValue=null, arrayValue=F.struct(F.array(*values).alias("values"))).alias("value"))
    own = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), _value(stringValue=e["value"], arrayValue=F.lit(None).cast("struct<values:array<struct<intValue:string,stringValue:string>>>")).alias("value")))
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name",
        _named_or_numbered(payloads.KINDS, "SPAN_KIND_", F.col("kind")).alias("kind"),
        F.col("start_time_unix_nano").cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"),
        F.struct(_named_or_numbered(payloads.STATUS_CODES, "STATUS_CODE_", F.col("status_code")).alias("code"), F.col("status_message").alias("message")).alias("status"),
        F.concat(own, F.array(listed)).alias("attributes"),
    )
    parts = [F.expr(f"cast(trace_id as bigint) div {RECORDS // 10}L").alias("part")]  # under ten spans a trace
    flat = payloads.flatten_spans(_payload(derived.spans(spark, sf_dir), parts, "Spans", "spans", record))
    version, listed = F.col("resource_attributes")["service.version"].alias("version"), F.col("attributes")["listed"].alias("listed")
    return flat.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time_unix_nano", "duration_nano", "status_code", "status_message", "service_name", version, listed)


_COUNTED = "t, NULL AS value, n AS \"count\", CAST(cents AS DOUBLE) AS \"sum\", event_type AS series"
_POINT_SERVICE = "CASE WHEN service_name = 'svc-4' THEN 'unknown_service' ELSE service_name END"


@query("flatten_metric_points", f"""WITH {POINTS}, flat AS (
    SELECT 'event.value' AS metric_name, 'Gauge' AS type, '' AS temporality, FALSE AS is_monotonic, {_POINT_SERVICE} AS service_name, t AS time_unix_nano, value,
        NULL AS "count", NULL AS "sum", CAST(user_id AS VARCHAR) AS series, '' AS buckets, '' AS bounds FROM ev UNION ALL
    SELECT 'event.cents', 'Sum', 'Cumulative', TRUE, {_POINT_SERVICE}, t, CAST(total AS DOUBLE), NULL, NULL, CAST(user_id AS VARCHAR), '', '' FROM cum UNION ALL
    SELECT 'event.cents.delta', 'Sum', 'Delta', TRUE, {_POINT_SERVICE}, t, CAST(cents AS DOUBLE), NULL, NULL, CAST(user_id AS VARCHAR), '', '' FROM ev UNION ALL
    SELECT 'event.size', 'Histogram', 'Cumulative', FALSE, 'svc-events', {_COUNTED}, concat_ws(',', c0, c1, c2, c3, c4, c5, c6, c7), '1,5,10,25,50,100,250' FROM sizes UNION ALL
    SELECT 'event.size.exp', 'ExponentialHistogram', 'Cumulative', FALSE, 'svc-events', {_COUNTED}, '', '' FROM sizes UNION ALL
    SELECT 'event.size.summary', 'Summary', '', FALSE, 'svc-events', {_COUNTED}, '', '' FROM sizes)
    SELECT metric_name, type, temporality, is_monotonic, service_name, time_unix_nano, value, CAST("count" AS BIGINT) AS "count", "sum", series, buckets, bounds FROM flat""")
def flatten_metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir)
    kind = F.col("type")
    whole = F.when(kind == "Sum", F.col("value").cast("long").cast("string"))
    texts = lambda c: F.transform(c, lambda x: x.cast("string"))
    point = F.struct(
        _attributes("attributes").alias("attributes"), F.col("start_time_unix_nano").cast("string").alias("startTimeUnixNano"), F.col("time_unix_nano").cast("string").alias("timeUnixNano"),
        F.when(kind == "Gauge", F.col("value")).alias("asDouble"), whole.alias("asInt"), F.col("count").cast("string").alias("count"), "sum",
        F.when(kind == "Histogram", F.col("explicit_bounds")).alias("explicitBounds"), F.when(kind == "Histogram", texts("bucket_counts")).alias("bucketCounts"),
    )
    name = F.when(F.col("temporality") == "Delta", "#1").when(F.col("metric_name") == "event.size.exp", "AGGREGATION_TEMPORALITY_CUMULATIVE").otherwise("#2")
    bodies = [
        F.when(kind == k, F.struct("dataPoints", *([name.alias("aggregationTemporality")] if k not in ("Gauge", "Summary") else []), *([F.col("is_monotonic").alias("isMonotonic")] if k == "Sum" else []))).alias(field)
        for field, k in (("gauge", "Gauge"), ("sum", "Sum"), ("histogram", "Histogram"), ("exponentialHistogram", "ExponentialHistogram"), ("summary", "Summary"))
    ]
    metric = F.array(F.struct(F.col("metric_name").alias("name"), F.lit("1").alias("unit"), *bodies)).alias("metrics")
    keys = ["metric_name", "type", "temporality", "is_monotonic", F.expr(f"time_unix_nano div {HOUR}L").alias("hour"), F.pmod("series_id", F.lit(64)).alias("part")]
    flat = payloads.flatten_metric_points(_payload(points, keys, "Metrics", "dataPoints", point, metric))
    series = F.coalesce(F.col("attributes")["user.id"], F.col("attributes")["event.type"]).alias("series")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return flat.select(
        "metric_name", "type", "temporality", "is_monotonic", "service_name", "time_unix_nano", "value", "count", "sum", series,
        joined("bucket_counts").alias("buckets"), joined("explicit_bounds").alias("bounds"),
    )


@query("attrs_to_map", f"""WITH {LOGS} SELECT span_id, event_type || '2' AS event_type, coalesce(k, '') AS k, span_id AS whole, CAST(CAST(span_id AS BIGINT) // 2 AS VARCHAR) || CASE CAST(span_id AS BIGINT) % 2 WHEN 0 THEN '' ELSE '.5' END AS half,
    CASE WHEN trace_id = '' THEN 'true' ELSE 'false' END AS truth, '["' || event_type || '",' || span_id || ',{{"in":["' || env || '"]}}]' AS listed, 'AAE=' AS bytes, '' AS none FROM logs""")
def attrs_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    text = lambda c: F.to_json(_text(c))
    inside = F.concat(F.lit('{"kvlistValue":{"values":[{"key":"in","value":{"arrayValue":{"values":['), text(F.col("resource_attributes")["deployment.environment.name"]), F.lit("]}}}]}}"))
    listed = F.concat(F.lit('{"arrayValue":{"values":['), text(F.col("attributes")["event.type"]), F.lit(","), F.to_json(_value(intValue=F.col("span_id"))), F.lit(","), inside, F.lit("]}}"))
    typed = lambda suffix: F.transform(
        F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), text(F.when(e["key"] == "event.type", F.concat(e["value"], F.lit(suffix))).otherwise(e["value"])).alias("value"))
    )
    kinds = F.array(
        pair("whole", F.to_json(_value(intValue=_numbered()))), pair("half", F.to_json(_value(doubleValue=_numbered().cast("double") / 2))), pair("truth", F.to_json(_value(boolValue=F.col("trace_id") == ""))),
        pair("listed", listed), pair("bytes", F.to_json(_value(bytesValue=F.lit("AAE=")))), pair("none", F.lit("{}")),
    )
    rows = derived.logs(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # a file's few row groups are few tasks, and values take time
    made = rows.select("span_id", payloads.attrs_to_map(F.concat(typed("1"), typed("2"), kinds)).alias("m"))
    whole = [F.col("m")[k].alias(k) for k in ("whole", "half", "truth", "listed", "bytes", "none")]
    return made.select("span_id", F.col("m")["event.type"].alias("event_type"), F.coalesce(F.col("m")["k"], F.lit("")).alias("k"), *whole)


@query("stream_land", _FLAT_LOGS)
def stream_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    log_payloads(spark, sf_dir).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("payload string, received bigint").parquet(f"{root}/in")
    jobs.land_logs(stream, f"{root}/v1/logs", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return _flat(scan.read_signal(spark, root, "logs"))


def _fed(df: DataFrame, time: str, root: str, turns: int, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """``df`` by turns of time, written one after the other; after each of them the stream goes on from its checkpoint until it has taken it.

    ``df`` is worked out once, and every turn is written by as many tasks as its rows need.
    """
    spark = df.sparkSession
    df.write.parquet(f"{root}/all")
    rows = spark.read.parquet(f"{root}/all")
    low, high = rows.agg(F.min(time), F.max(time)).first()
    step = (high - low) // turns + 1 if low is not None else 1
    for turn in range(turns):
        rows.filter(F.expr(f"({time} - {low or 0}L) div {step}L = {turn}")).write.mode("append").parquet(f"{root}/in")
        with _rocksdb(spark):
            start(spark.readStream.schema(rows.schema).parquet(f"{root}/in")).awaitTermination()


def _written(df: DataFrame, time: str, root: str, turns: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream ``job`` has written when its input, ``df`` by turns of time, is at an end."""
    schemas = []

    def start(stream: DataFrame) -> StreamingQuery:
        out = job(stream)
        schemas.append(out.schema)
        return out.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{root}/out")

    _fed(df, time, root, turns, start)
    return df.sparkSession.read.schema(schemas[0]).parquet(f"{root}/out")


@query("stream_log_counts", f"""WITH {LOGS}, failed AS (SELECT * FROM logs WHERE severity_text = 'ERROR'),
    ends AS (SELECT service_name, (t // {6 * HOUR} + i) * {6 * HOUR} AS e FROM failed, (VALUES (1), (2), (3), (4)) AS v(i))
    SELECT CAST(e // 1000000000 AS BIGINT) AS window_end, service_name, count(*) AS logs FROM ends
    WHERE e // 1000000 <= (SELECT max(t) FROM failed) // 1000000 - 300000 GROUP BY 1, 2""")
def stream_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are over, the grace included, are written once and leave the state."""
    root = _folder(spark)
    rows = derived.logs(spark, sf_dir).select("time_unix_nano", "service_name", "severity_text", "body", "attributes", "resource_attributes")
    out = _written(rows, "time_unix_nano", root, 4, lambda stream: jobs.window_counts(stream, [("level", "error", False)], "24 hours", "6 hours"))
    return out.select(F.unix_timestamp("window_end").alias("window_end"), "service_name", "logs")


@query("stream_service_map", f"""WITH {SPANS} SELECT p.service_name AS from_service, c.service_name AS to_service, count(*) AS requests, count(*) FILTER (c.status_code = 'Error') AS errors
    FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.parent_span_id <> '' AND p.service_name <> c.service_name GROUP BY 1, 2""")
def stream_service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    rows = derived.spans(spark, sf_dir).select("trace_id", "span_id", "parent_span_id", "service_name", "status_code", "start_time_unix_nano")
    _fed(rows, "start_time_unix_nano", root, 3, lambda stream: jobs.land_edges(stream, f"{root}/edges", f"{root}/checkpoint", {"availableNow": True}))
    edges = spark.read.schema("from_service string, to_service string, hour timestamp, requests bigint, errors bigint, batch int").parquet(f"{root}/edges")
    return edges.groupBy("from_service", "to_service").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))


_LIVE = f"""WITH {LOGS}, {ISLANDS}, over AS (
        SELECT f.grp, f.fired_at, f.last + {6 * HOUR} AS resolved_at, n.value AS value, l.value AS last_value, (SELECT max(tick) FROM ticks) AS newest
        FROM fired f JOIN ticks l ON l.grp = f.grp AND l.tick = f.last LEFT JOIN ticks n ON n.grp = f.grp AND n.tick = f.last + {6 * HOUR} WHERE f.fired_at IS NOT NULL
    )
    SELECT 'by-service' AS rule_id, o.grp AS "group", 'firing' AS event, o.fired_at AS "at", t.value FROM over o JOIN ticks t ON t.grp = o.grp AND t.tick = o.fired_at UNION ALL
    SELECT 'by-service', grp, 'resolved', resolved_at, coalesce(value, last_value) FROM over WHERE value IS NOT NULL OR newest - {5 * HOUR // 60} >= resolved_at"""


@query("stream_alert_states", _LIVE)
def stream_alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    ticks = alert_ticks(spark, sf_dir).select("rule_id", "group", "tick", "value", (F.col("value") >= 5).alias("breached"), F.lit(12 * HOUR).cast("long").alias("hold"))
    return _written(ticks, "tick", root, 3, lambda stream: jobs.alert_events(stream, 6 * HOUR))


#: State on disk, which state in Python needs, with one limit to the memory of all state stores of an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store of the streams that begin here."""
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _shaken(df: DataFrame, time: str, late: int) -> DataFrame:
    """``df`` with ``comes``: each row comes up to ``late`` ns late, by a hash."""
    return df.withColumn("comes", F.col(time) + F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))), F.lit(late)))


#: Rules that follow the logs: some with groups and some without, held for a time or not, above and below, and one that nothing matches.
LIVE_RULES = [
    ("failing", "Errors of a service", "logs", "", "", {}, [("level", "error", False)], ["service.name"], ">", 3.0, 43200, 0, [], True),
    ("failing-on", "Errors of a service that go on", "logs", "", "", {}, [("level", "error", False), ("deployment.environment.name", "prod", True)], ["service.name", "level"], ">=", 2.0, 86400, 43200, [], True),
    ("buying", "Purchases and errors", "logs", "", "", {}, [("level", "warn,error", False)], [], ">", 110.0, 172800, 21600, [], True),
    ("one-key", "Hardly any of a key", "logs", "", "", {}, [("k", "v3", False)], [], "<", 2.0, 21600, 0, [], True),
    ("quiet", "No such log", "logs", "", "", {}, [("", "no such text", False)], [], "<", 1.0, 10800, 64800, [], True),
    ("none", "Never", "logs", "", "", {}, [("", "no such text", False)], ["level"], "<", 1.0, 10800, 0, [], True),
    ("off", "Switched off", "logs", "", "", {}, [], [], ">", 0.0, 3600, 0, [], False),
]
_EVERY, _SLOT, _LATE = 6 * HOUR, 3 * HOUR, 12 * HOUR


def _ticks_of(rule: str, group: str, matches: str, op: str, threshold: float, window: int, hold: int, always: bool) -> str:
    """Values of a rule at all ticks."""
    columns = f"tick, CAST({threshold} AS DOUBLE) AS threshold, '{op}' AS op, {hold * 10**9} AS hold"
    near = f"t >= tick - {window * 10**9} AND t < tick AND {matches}"
    if always:
        return f"SELECT '{rule}' AS rule_id, '' AS grp, CAST(count(t) AS DOUBLE) AS value, {columns} FROM ticks LEFT JOIN logs ON {near} GROUP BY tick"
    return f"SELECT '{rule}' AS rule_id, {group} AS grp, CAST(count(*) AS DOUBLE) AS value, {columns} FROM ticks JOIN logs ON {near} GROUP BY ALL"


_RULE_EVENTS = f"""WITH {LOGS}, ends AS (SELECT min(t) // {_SLOT} * {_SLOT} + {_SLOT} AS low, max(t) // {_SLOT} * {_SLOT} - {_LATE} AS high FROM logs),
    ticks AS (SELECT unnest(range((low + {_EVERY - 1}) // {_EVERY}, high // {_EVERY} + 1)) * {_EVERY} AS tick FROM ends),
    vals AS (
        {_ticks_of("failing", "'service.name=' || service_name", "level = 'ERROR'", ">", 3, 43200, 0, False)} UNION ALL
        {_ticks_of("failing-on", "'level=' || level || ',service.name=' || service_name", "level = 'ERROR' AND env <> 'prod'", ">=", 2, 86400, 43200, False)} UNION ALL
        {_ticks_of("buying", "", "level IN ('WARN', 'ERROR')", ">", 110, 172800, 21600, True)} UNION ALL
        {_ticks_of("one-key", "", "k = 'v3'", "<", 2, 21600, 0, True)} UNION ALL {_ticks_of("quiet", "", "FALSE", "<", 1, 10800, 64800, True)}
    ), high AS (SELECT *, CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold ELSE value < threshold END AS is_high FROM vals),
    marked AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY rule_id, grp ORDER BY tick) = {_EVERY} THEN 0 ELSE 1 END AS b FROM high WHERE is_high),
    numbered AS (SELECT *, sum(b) OVER (PARTITION BY rule_id, grp ORDER BY tick) AS island FROM marked),
    begun AS (SELECT *, min(tick) OVER (PARTITION BY rule_id, grp, island) AS begin FROM numbered),
    fired AS (SELECT rule_id, grp, island, min(tick) FILTER (tick - begin >= hold) AS fired_at, max(tick) AS last FROM begun GROUP BY ALL)
    SELECT f.rule_id, f.grp AS "group", 'firing' AS event, fired_at AS "at", v.value FROM fired f JOIN vals v ON v.rule_id = f.rule_id AND v.grp = f.grp AND v.tick = fired_at UNION ALL
    SELECT f.rule_id, f.grp, 'resolved', f.last + {_EVERY}, coalesce(n.value, l.value) FROM fired f JOIN vals l ON l.rule_id = f.rule_id AND l.grp = f.grp AND l.tick = f.last
    LEFT JOIN vals n ON n.rule_id = f.rule_id AND n.grp = f.grp AND n.tick = f.last + {_EVERY} WHERE fired_at IS NOT NULL AND f.last < (SELECT max(tick) FROM ticks)"""


@query("stream_rule_events", _RULE_EVENTS)
def stream_rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that come out of order go in, events of all rules come out."""
    root, known = _folder(spark), spark.createDataFrame(LIVE_RULES, RULES_DDL)
    rows = derived.logs(spark, sf_dir).select("time_unix_nano", "service_name", "severity_text", "body", "trace_id", "attributes", "resource_attributes")
    return _written(_shaken(rows, "time_unix_nano", _LATE), "comes", root, 5, lambda stream: jobs.rule_events(stream.drop("comes"), known, _EVERY, _LATE))


@query("alert_rule_history", _RULE_EVENTS)
def alert_rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events from all logs at once: values of all rules at all ticks, and their back-test."""
    known, rows = spark.createDataFrame(LIVE_RULES, RULES_DDL), derived.logs(spark, sf_dir)
    low, high = rows.agg(F.min("time_unix_nano"), F.max("time_unix_nano")).first()
    low, high = (low or 0) // _SLOT * _SLOT + _SLOT, (high or 0) // _SLOT * _SLOT - _LATE
    ticks = alerts.log_rule_ticks(rows, known, _EVERY, low, high)
    return alerts.backtest_events(alerts.alert_backtest(known, ticks, _EVERY), ticks, _EVERY)


def _increments(spark: SparkSession, sf_dir: str, metric: str, key: str) -> DataFrame:
    """What a stream of the points of a cumulative metric, which come out of order, has written of their increments; ``g0`` is the grouping key."""
    root = _folder(spark)
    rows = derived.metric_points(spark, sf_dir).filter(F.col("metric_name") == metric).withColumn("g0", group_key(key, logs=False))
    rows = rows.drop("attributes", "resource_attributes", "min", "max")
    return _written(_shaken(rows, "time_unix_nano", _LATE), "comes", root, 4, lambda stream: jobs.live_increments(stream.drop("comes"), ["series_id", "g0"], "12 hours", "60 days"))


@query("stream_counter_rate", f"WITH {POINTS}, {rate_sql('sum', GROWN, JAN, D20, 12 * HOUR)}")
def stream_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = _increments(spark, sf_dir, "event.cents", "service.name").withColumn("increment", F.col("value"))
    return metrics.rate_series(grown, JAN, D20, 12 * HOUR, "sum", ["service.name"]).withColumn("value", F.round("value", 6))


@query("stream_histogram_p95", f"WITH {POINTS}, {histogram_sql(JAN, D20, DAY)}, {percentile_sql(95, JAN, DAY)}")
def stream_histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = _increments(spark, sf_dir, "event.size", "event.type")
    return metrics.distribution_series(grown, JAN, D20, DAY, "p95", ["event.type"]).withColumn("value", F.round("value", 6))


def _by_series(spark: SparkSession, sf_dir: str, metric: str) -> str:
    """A folder with the points of a metric that came in two batches, by ids of their series."""
    root, points = _folder(spark), derived.metric_points(spark, sf_dir).filter(F.col("metric_name") == metric)
    for part in (F.col("time_unix_nano") < D20, F.col("time_unix_nano") >= D20):
        series.write_points(points.filter(part), root)
    return root


@query("metric_filtered_by_series", FILTERED)
def metric_filtered_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that is resolved on the dictionary of series."""
    points = series.read_points(spark, _by_series(spark, sf_dir, "event.value"), ["event.value"], JAN - metrics.LOOKBACK, FEB, {"user.id": "7"})
    return metrics.query_metric(points, "event.value", JAN, FEB, "max", ["service.name"], None, STEP)


@query("metric_rate_by_series", RATE)
def metric_rate_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = series.read_points(spark, _by_series(spark, sf_dir, "event.cents"), ["event.cents"], D10 - metrics.LOOKBACK, D20)
    return metrics.query_metric(points, "event.cents", D10, D20, None, ["service.name"], None, STEP).withColumn("value", F.round("value", 6))


@query("stream_cardinality_guard", GUARDED)
def stream_cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that come out of order, marked by the first twenty series that a stream has told of."""
    root, points = _folder(spark), derived.metric_points(spark, sf_dir).filter("metric_name = 'event.value'")
    rows = _shaken(points.select("metric_name", "series_id", "time_unix_nano", "value"), "time_unix_nano", _LATE)
    kept = jobs.admitted(_written(rows, "comes", root, 4, lambda stream: jobs.first_series(stream.drop("comes"), 20, "12 hours")), 20)
    return metrics.overflowing(points, kept).groupBy("series").agg(F.count(F.lit(1)).alias("points"))


def _live_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of the traces of all spans, each of which comes up to twelve hours late: a trace is quiet after two, so many are told of again and again."""
    root = _folder(spark)
    rows = derived.spans(spark, sf_dir).drop("attributes", "resource_attributes", "events")
    return jobs.latest_traces(_written(_shaken(rows, "start_time_unix_nano", _LATE), "comes", root, 3, lambda stream: jobs.live_traces(stream, "2 hours", "2 days", "1 day", "comes")))


#: Traces that begin before this are over when the stream ends.
_OVER = Y97


@query("stream_traces", f"""WITH {SPANS} SELECT * FROM (SELECT trace_id, coalesce(arg_min(service_name, (t, span_id)) FILTER (parent_span_id = ''), arg_min(service_name, (t, span_id))) AS root_service,
    coalesce(arg_min(name, (t, span_id)) FILTER (parent_span_id = ''), arg_min(name, (t, span_id))) AS root_name, min(t) AS start, max(t + d) - min(t) AS duration, count(*) AS spans,
    count(*) FILTER (status_code = 'Error') AS errors, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM spans GROUP BY trace_id) WHERE start < {_OVER}""")
def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _live_traces(spark, sf_dir).filter(F.col("start") < _OVER)
    return told.select("trace_id", "root_service", "root_name", "start", "duration", "spans", "errors", F.array_join("services", ",").alias("services"))


@query("stream_error_origins", f"WITH RECURSIVE {SPANS}, scope AS (SELECT * FROM spans), {UP}, begun AS (SELECT trace_id FROM spans GROUP BY trace_id HAVING min(t) < {_OVER}) SELECT trace_id, span_id, service_name, name FROM scope WHERE {ORIGIN} AND trace_id IN (FROM begun)")
def stream_error_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _live_traces(spark, sf_dir).filter(F.col("start") < _OVER)
    return told.select("trace_id", F.explode("origins").alias("o")).select("trace_id", "o.span_id", "o.service_name", "o.name")
