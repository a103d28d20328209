"""Operators on small inputs with known results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenlake.functions.text import longest_literal, message_template
from lumenlake.functions.time import nice_step
from lumenlake.operators import alerts, insights, logs, metrics, services, traces
from lumenlake.schema import LOGS_DDL, NANOS, POINTS_DDL, RULES_DDL, SPANS_DDL, STATES_DDL
from lumenlake.sources import payloads, scan, storage
from lumenlake.streaming import jobs

T0 = 1_791_378_000 * NANOS  # an hour of October 2026
MIN, MS = 60 * NANOS, 1_000_000
HOUR = 60 * MIN


def span(trace, sid, parent, service, name, start, ms, status="Unset", message="", version="1"):
    return (trace, sid, parent, name, "Server", start, start + ms * MS, ms * MS, status, message, service, "", {"http.route": name}, {"service.name": service, "service.version": version}, [])


@pytest.fixture(scope="module")
def shop(spark):
    spans = [
        span("t1", "1", "", "frontend", "GET /checkout", T0 + 10 * MIN, 200),
        span("t1", "2", "1", "payment", "POST /pay", T0 + 10 * MIN + 20 * MS, 150, "Error"),
        span("t2", "3", "", "frontend", "GET /home", T0 + 20 * MIN, 10),
    ]
    rows = [
        (T0 + 10 * MIN, T0, "frontend", 9, "INFO", "checkout started", "t1", "1", "", {"order.id": "42"}, {"service.name": "frontend"}),
        (T0 + 10 * MIN + NANOS, T0, "payment", 17, "ERROR", "card declined", "t1", "2", "", {"order.id": "42"}, {"service.name": "payment"}),
    ]
    return spark.createDataFrame(spans, SPANS_DDL), spark.createDataFrame(rows, LOGS_DDL)


def point(metric, kind, series, t, value=None, start=0, temporality="", monotonic=False, attrs=None, count=None, total=None, bounds=(), buckets=()):
    return (metric, kind, "1", temporality, monotonic, series, "s", "", attrs or {}, {"service.name": "s"}, start, t * NANOS, value, count, total, None, None, list(bounds), list(buckets))


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_services_and_map(shop):
    spans, _ = shop
    found = {r["service_name"]: r for r in services.services(spans, T0, T0 + HOUR).collect()}
    assert (found["frontend"]["requests"], found["frontend"]["errors"]) == (2, 0)
    assert found["payment"]["error_rate"] == 1 and 0 < found["frontend"]["p95_ms"] <= 200
    assert values(services.service_map(spans, T0, T0 + HOUR)) == [("frontend", "payment", 1, 1)]
    timeline = services.service_timeline(spans, "frontend", T0, T0 + HOUR, 10 * MIN).collect()
    assert [(r["bucket_start"], r["requests"]) for r in timeline] == [(T0 + 10 * MIN, 1), (T0 + 20 * MIN, 1)]
    assert services.service_operations(spans, "frontend", T0, T0 + HOUR).count() == 2


def test_compare_among_many_values(spark):
    """Every record has ids of its own: few pairs leave the tasks, and the result is that of counting all pairs."""
    rows = spark.range(0, 20_000, numPartitions=4).select(
        (F.lit(T0) + F.col("id")).alias("time_unix_nano"), F.when(F.col("id") % 5 == 0, "ERROR").otherwise("INFO").alias("severity_text"), F.lit("b").alias("body"), F.lit("s").alias("service_name"), F.lit("").alias("trace_id"),
        F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("k=1"), F.concat(F.lit("x="), (F.col("id") % 997).cast("string")), F.lit("code"), F.when(F.col("id") % 15 == 0, "7").otherwise((F.col("id") % 2000).cast("string"))).alias("attributes"),
        F.create_map(F.lit("service.name"), F.lit("s"), F.lit("host"), (F.col("id") % 5 * 100 + F.col("id") % 3).cast("string")).alias("resource_attributes"),
    )
    chosen = rows.withColumn("chosen", F.col("severity_text") == "ERROR")
    names, selection, baseline = insights.frequent_pairs(chosen, "logs")
    assert (selection, baseline) == (4000, 16000) and len(names) < 12
    all_pairs = insights.compare_counts(chosen, "logs").filter("selected >= 0.2 * 4000")
    assert {f"{len(r['key'])}:{r['key']}={r['value']}" for r in all_pairs.collect()} <= set(names)
    found = insights.compare(rows, "logs", T0, T0 + HOUR, errors=True).collect()
    assert [(r["key"], r["value"], r["selected"], r["others"]) for r in found] == [("host", "0", 1334, 0), ("host", "1", 1333, 0), ("host", "2", 1333, 0), ("code", "7", 1334, 10)]
    few = insights.frequent_pairs(chosen, "logs", items=64)  # too small at first
    assert set(few[0]) >= {f"{len(r['key'])}:{r['key']}={r['value']}" for r in all_pairs.collect()}
    plan = insights.compare(rows, "logs", T0, T0 + HOUR, errors=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_log_search(shop):
    _, rows = shop
    search = lambda *terms, low=T0, high=T0 + HOUR: [r["body"] for r in logs.search_logs(rows, terms, low, high).collect()]
    assert search() == ["card declined", "checkout started"]
    assert search(("level", "error", False)) == ["card declined"]
    assert len(search(("", "42", False))) == 2
    assert search(high=T0 + 5 * MIN) == []
    assert search(("missing", "x", True)) == []  # a negated term drops rows without the attribute
    assert values(logs.log_histogram(rows, [], T0, T0 + HOUR, 10 * MIN)) == [(T0 + 10 * MIN, "ERROR", 1), (T0 + 10 * MIN, "INFO", 1)]
    assert logs.count_logs(rows, [], T0, T0 + MIN).first()["logs"] == 0
    assert [r["level"] for r in logs.count_logs(rows, [], T0, T0 + HOUR, ["level"]).collect()] == ["ERROR", "INFO"]
    assert logs.log_facet(rows, [], T0, T0 + HOUR, ["service.name"], 1).count() == 1


def test_trace_search(shop):
    spans, _ = shop
    search = lambda **more: traces.search_traces(spans, T0, T0 + HOUR, **more).collect()
    assert [r["trace_id"] for r in search()] == ["t2", "t1"]
    first = search(errors_only=True)[0]
    assert (first["root_service"], first["root_name"], first["spans"], first["errors"], first["duration"]) == ("frontend", "GET /checkout", 2, 1, 200 * MS)
    assert first["services"] == ["frontend", "payment"]
    for more in ({"service": "payment"}, {"terms": [("http.route", "POST /pay", False)]}, {"min_duration_ns": 100 * MS}):
        assert [r["trace_id"] for r in search(**more)] == ["t1"]
    assert [r["span_id"] for r in traces.trace(spans, "t1").collect()] == ["1", "2"]


def test_compare(shop):
    spans, rows = shop
    found = insights.compare(spans, "spans", T0, T0 + HOUR, errors=True).collect()
    top = found[0]
    assert (top["key"], top["value"], top["share"], top["base_share"], top["selection"], top["baseline"]) == ("service.name", "payment", 1.0, 0.0, 1, 2)
    window = insights.compare(spans, "spans", T0, T0 + HOUR, window=(T0 + 19 * MIN, T0 + 21 * MIN)).first()
    assert (window["selection"], window["key"], window["value"]) == (1, "http.route", "GET /home")
    assert insights.compare(rows, "logs", T0, T0 + HOUR, errors=True).first()["value"] == "payment"


def test_issues(shop):
    spans, rows = shop
    found = {r["kind"]: r for r in insights.issues(rows, spans, T0, T0 + HOUR, 6).collect()}
    assert (found["log"]["template"], found["log"]["service_name"], found["log"]["example_trace_id"]) == ("card declined", "payment", "t1")
    assert (found["span"]["template"], found["span"]["count"], found["span"]["previous"], found["span"]["status"]) == ("POST /pay", 1, 0, "ongoing")


@pytest.mark.parametrize(("statuses", "origin"), [("EEE", "3"), ("EEUE", "4")])
def test_error_origin(spark, statuses, origin):
    chain = [span("t", str(n + 1), str(n) if n else "", f"s{n}", f"call {'wxyz'[n]}", T0 + n, 1, "Error" if s == "E" else "Unset") for n, s in enumerate(statuses)]
    healthy = span("h", "9", "", "s", "ok", T0 - 30 * MIN, 1)
    df = spark.createDataFrame([*chain, healthy], SPANS_DDL)
    assert [r["span_id"] for r in traces.error_origins(df).collect()] == [origin]
    found = insights.span_issues(df, T0, T0 + HOUR).collect()
    assert [(r["template"], r["status"]) for r in found] == [(f"call {'wxyz'[int(origin) - 1]}", "new")]


def test_parent_cycle_ends(spark):
    loop = [span("t", "1", "2", "a", "x", T0, 1, "Error"), span("t", "2", "1", "a", "y", T0 + 1, 1)]
    df = spark.createDataFrame(loop, SPANS_DDL)
    assert sorted(r["ancestor"] for r in traces.error_ancestors(df).collect()) == ["1", "2"]
    assert traces.waterfall(df).count() == 0


def test_deployments(spark):
    rows = [span("a", "1", "", "cart", "x", T0 - 3 * HOUR, 1, version="7"), span("b", "1", "", "cart", "x", T0 + 20 * MIN, 1, version="8"), span("c", "1", "", "new", "x", T0 + 15 * MIN, 1, version="1")]
    found = services.deployments(spark.createDataFrame(rows, SPANS_DDL), T0, T0 + HOUR).collect()
    assert [(r["service_name"], r["version"], r["previous"], r["at"]) for r in found] == [("cart", "8", "7", T0 + 20 * MIN)]


def test_template(spark):
    df = spark.createDataFrame([("job 77 of deadbeef01 stopped at step 4.25 of 9",)], "m string").select(message_template(F.col("m")).alias("t"))
    assert df.first()["t"] == "job <*> of <*> stopped at step <*> of <*>"
    assert df.select(longest_literal(F.col("t"))).first()[0] == "stopped at step"


def test_nice_step():
    assert nice_step(HOUR, 60) == MIN and nice_step(1000 * 24 * HOUR, 60) == 24 * HOUR


def test_gauge(spark):
    rows = [point("g", "Gauge", 1, 1, 10.0, attrs={"k": "a"}), point("g", "Gauge", 1, 5, 20.0, attrs={"k": "a"}), point("g", "Gauge", 2, 3, 40.0, attrs={"k": "a"})]
    rows += [point("g", "Gauge", 1, 12, 7.0, attrs={"k": "a"}), point("g", "Gauge", 3, 2, 1.0, attrs={"k": "b"}), point("g", "Gauge", 1, 25, 1.0, attrs={"k": "a"})]
    df = spark.createDataFrame(rows, POINTS_DDL)
    run = lambda agg: values(metrics.query_metric(df, "g", 0, 20 * NANOS, agg, ["k"], None, 10 * NANOS))
    assert run(None) == [("a", 0, 30.0), ("a", 10 * NANOS, 7.0), ("b", 0, 1.0)]
    assert run("sum")[0] == ("a", 0, 60.0) and run("max")[0] == ("a", 0, 40.0)
    assert metrics.query_metric(df, "absent", 0, 20 * NANOS).count() == 0


def test_counters(spark):
    rows = [point("c", "Sum", 1, t, float(v), 0, "Cumulative", True) for t, v in ((1, 100), (5, 150), (11, 20), (15, 60))]
    rows += [point("d", "Sum", 1, 1, 30.0, 0, "Delta", True), point("d", "Sum", 2, 2, 70.0, 0, "Delta", True)]
    df = spark.createDataFrame(rows, POINTS_DDL)
    assert values(metrics.query_metric(df, "c", 0, 20 * NANOS, step_ns=10 * NANOS)) == [(0, 5.0), (10 * NANOS, 6.0)]
    assert values(metrics.query_metric(df, "d", 0, 10 * NANOS, step_ns=10 * NANOS)) == [(0, 10.0)]


def test_histogram(spark):
    make = lambda t, count, total, buckets: point("h", "Histogram", 1, t, start=0, temporality="Cumulative", count=count, total=total, bounds=(0.1, 0.5, 1.0), buckets=buckets)
    df = spark.createDataFrame([make(1, 10, 1.0, [10, 0, 0, 0]), make(5, 110, 31.0, [10, 50, 40, 10])], POINTS_DDL)
    for agg, wanted in (("count", 10.0), ("avg", 0.3), ("p50", 0.5), ("p90", 1.0), ("p99", 1.0)):
        assert metrics.query_metric(df, "h", 0, 10 * NANOS, agg, step_ns=10 * NANOS).first()["value"] == pytest.approx(wanted)
    assert metrics.query_metric(df, "h", 0, 10 * NANOS, "p100", step_ns=10 * NANOS).count() == 0
    small = spark.createDataFrame([(1, [1.0, 2.0], [0, 10, 0]), (2, [1.0], [0, 0]), (3, [1.0], [1]), (4, [-1.0, 2.0], [3, 0, 0])], "g int, bounds array<double>, counts array<bigint>")
    assert values(metrics.bucket_quantile(small, ["g"], 0.5)) == [(1, 1.5), (4, -1.0)]


def test_alert_machine(spark):
    def rules(hold, op=">"):
        return spark.createDataFrame([("r", "R", "logs", "", "", {}, [], [], op, 5.0, 60, hold, [], True)], RULES_DDL)

    def tick(rule, states, now, **by_group):
        rows = spark.createDataFrame([("r", g, float(v)) for g, v in by_group.items()], "rule_id string, `group` string, value double")
        return {r["group"]: r for r in alerts.alert_transition(rule, states, rows, now).collect()}

    def states(rows):
        return spark.createDataFrame([("r", g, {}, r["status"], r["since"], r["value"]) for g, r in rows.items() if r["status"]], STATES_DDL)

    none = spark.createDataFrame([], STATES_DDL)
    first = tick(rules(0), none, 10, api=9, web=1)
    assert (first["api"]["status"], first["api"]["event"], first["api"]["event_value"], first["web"]["status"]) == ("firing", "firing", 9.0, "ok")
    second = tick(rules(0), states(first), 20, api=12, web=1)
    assert (second["api"]["status"], second["api"]["event"], second["api"]["since"], second["api"]["value"]) == ("firing", None, 10, 12.0)
    third = tick(rules(0), states(second), 30, api=2)
    assert (third["api"]["status"], third["api"]["event"], third["api"]["event_value"]) == ("ok", "resolved", 2.0)
    gone = tick(rules(0), states(first), 20, web=1)
    assert (gone["api"]["status"], gone["api"]["event"]) == (None, "resolved")
    a = tick(rules(120), none, 0, api=9)
    b = tick(rules(120), states(a), 60 * NANOS, api=9)
    c = tick(rules(120), states(b), 120 * NANOS, api=9)
    assert [x["api"]["status"] for x in (a, b, c)] == ["pending", "pending", "firing"] and b["api"]["since"] == 0 and c["api"]["event"] == "firing"
    assert tick(rules(120), states(a), 60 * NANOS, api=1)["api"]["event"] is None
    history = spark.createDataFrame([("r", "api", t * 60 * NANOS, 9.0) for t in (0, 1, 2)] + [("r", "api", 3 * 60 * NANOS, 1.0)], "rule_id string, `group` string, tick bigint, value double")
    assert values(alerts.alert_backtest(rules(120), history, 60 * NANOS)) == [("r", "api", 120 * NANOS, 180 * NANOS)]
    status = alerts.rule_status(rules(0), states(first)).first()
    assert (status["status"], status["firing"]) == ("firing", 1)


def test_health(spark):
    now = spark.createDataFrame([("inventory", 0.0, 100.0), ("checkout", 0.11, 100.0), ("payment", 0.0, 840.0), ("frontend", 0.02, 100.0), ("fresh", 0.0, 5000.0), ("fast", 0.0, 30.0)], "service_name string, error_rate double, p95_ms double")
    before = spark.createDataFrame([("inventory", 100.0), ("checkout", 100.0), ("payment", 300.0), ("frontend", 100.0), ("fast", 10.0)], "service_name string, p95_ms double")
    found = [(r["service_name"], r["status"]) for r in services.service_health(now, before).collect()]
    assert found[:3] == [("checkout", "critical"), ("payment", "critical"), ("frontend", "warning")] and {s for _, s in found[3:]} == {"ok"}


def test_waterfall(spark):
    row = lambda sid, parent, low, high: ("t", sid, parent, sid, "Server", low, high, high - low, "Unset", "", "s", "", {}, {}, [])
    df = spark.createDataFrame([row("child2", "root", 60, 100), row("root", "", 0, 100), row("grandchild", "child1", 20, 30), row("child1", "root", 10, 50)], SPANS_DDL)
    found = traces.waterfall(df).orderBy("place").collect()
    assert [(r["span_id"], r["depth"]) for r in found] == [("root", 0), ("child1", 1), ("grandchild", 2), ("child2", 1)]
    assert (found[1]["offset"], found[1]["width"], found[1]["has_children"]) == (0.1, 0.4, True)
    orphans = spark.createDataFrame([row("o", "missing", 5, 10), row("r", "", 0, 10)], SPANS_DDL)
    assert [(r["span_id"], r["depth"]) for r in traces.waterfall(orphans).orderBy("place").collect()] == [("r", 0), ("o", 0)]
    assert traces.waterfall(spark.createDataFrame([row("z", "", 5, 5)], SPANS_DDL)).first()["width"] == 0.002


def test_payload_rules(spark):
    text = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityNumber":14,"observedTimeUnixNano":"7","body":{"stringValue":"{\\"k\\":\\"v\\"}"}},{"traceId":"000","spanId":"AB"}]}]}]}'
    rows = payloads.flatten_logs(spark.createDataFrame([(text, 99)], "payload string, received bigint")).collect()
    assert [(r["time_unix_nano"], r["severity_text"], r["service_name"], r["trace_id"], r["span_id"]) for r in rows] == [(7, "WARN", "unknown_service", "", ""), (99, "", "unknown_service", "", "ab")]


def test_storage(spark, tmp_path, shop):
    _, rows = shop
    for _ in range(3):
        storage.write_signal(rows, "logs", str(tmp_path))
    files = storage.stored_files(spark, str(tmp_path), "logs")
    assert [r["files"] for r in files.collect()] == [3]
    assert storage.compaction_candidates(files, T0 + HOUR + 4 * MIN).count() == 0  # within the grace
    storage.compact_hours(spark, str(tmp_path), "logs", T0 + HOUR + 6 * MIN)
    assert [r["files"] for r in storage.stored_files(spark, str(tmp_path), "logs").collect()] == [1]
    assert scan.scan(spark, str(tmp_path), "logs", T0, T0 + HOUR).count() == 6
    files = storage.stored_files(spark, str(tmp_path), "logs")
    assert storage.expired_partitions(files, T0 + 9 * 24 * HOUR).count() == 1 and storage.expired_partitions(files, T0 + 9 * 24 * HOUR, 0).count() == 0
    plain = spark.read.parquet(f"{tmp_path}/v1/logs")  # any reader of the public layout sees the rows
    assert plain.count() == 6
    plan = scan.scan(spark, str(tmp_path), "logs", T0, T0 + HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(time_unix_nano" in plan


def test_empty_inputs(spark):
    spans, rows, points = (spark.createDataFrame([], d) for d in (SPANS_DDL, LOGS_DDL, POINTS_DDL))
    low, high = T0, T0 + HOUR
    for df in (
        services.services(spans, low, high), services.service_map(spans, low, high), logs.search_logs(rows, [], low, high), logs.log_histogram(rows, [], low, high),
        traces.search_traces(spans, low, high), metrics.metric_catalog(points, low, high), metrics.query_metric(points, "x", low, high), insights.issues(rows, spans, low, high),
        insights.compare(spans, "spans", low, high, errors=True), services.deployments(spans, low, high), traces.waterfall(spans), traces.error_origins(spans),
    ):
        assert df.count() == 0


def test_live_alert_states(spark, tmp_path):
    """Batches by turns: a breach that lasts, a value that falls, a group that goes in between or for good, and ticks that come again or too late."""
    rows = [[("api", t, v) for t, v in enumerate((9, 9, 9))] + [("web", 0, 1), ("web", 1, 7), ("gone", 0, 8), ("gap", 0, 8)]]
    rows += [[("api", 3, 1), ("api", 2, 1), ("api", 4, 9), ("web", 2, 9), ("web", 3, 9), ("gap", 3, 8)], [("web", 9, 9), ("api", 1, 9)]]
    schema = "rule_id string, `group` string, tick bigint, value double, breached boolean, hold bigint"
    for batch in rows:
        known = [("r", g, 600 * (t + 10) * NANOS, float(v), v > 5, 1200 * NANOS if g == "api" else 0) for g, t, v in batch]
        spark.createDataFrame(known, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events = jobs.alert_events(stream, 600 * NANOS).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c")
    events.trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    spark.conf.set(provider, before)
    found = values(spark.read.parquet(f"{tmp_path}/out").select("group", "event", (F.col("at") / (600 * NANOS) - 10).cast("int"), "value"))
    assert found == [
        ("api", "firing", 2, 9.0), ("api", "resolved", 3, 1.0), ("gap", "firing", 0, 8.0), ("gap", "firing", 3, 8.0), ("gap", "resolved", 1, 8.0), ("gap", "resolved", 4, 8.0),
        ("gone", "firing", 0, 8.0), ("gone", "resolved", 1, 8.0), ("web", "firing", 1, 7.0), ("web", "firing", 9, 9.0), ("web", "resolved", 4, 9.0),
    ]


def test_typed_values(spark):
    """Every kind of value as text, enums by number and name, and an empty service name."""
    kinds = {
        '{"stringValue":"a"}': "a", '{"stringValue":""}': "", '{"intValue":"5"}': "5", '{"intValue":5}': "5", '{"doubleValue":2.0}': "2", '{"doubleValue":1.25e-5}': "0.0000125", '{"doubleValue":1e-7}': "1e-7",
        '{"doubleValue":1e21}': "1e+21", '{"doubleValue":12345678.5}': "12345678.5", '{"boolValue":false}': "false", '{"bytesValue":"AAE="}': "AAE=", "{}": "", '{"arrayValue":{}}': "[]", '{"kvlistValue":{"values":[]}}': "{}",
        '{"kvlistValue":{"values":[{"key":"b","value":{"intValue":"1"}},{"key":"a","value":{"arrayValue":{"values":[{"stringValue":"x\\"<"},{"boolValue":true},{}]}}}]}}': '{"a":["x\\"\\u003c",true,null],"b":1}',
    }
    df = spark.createDataFrame([(k, v) for k, v in kinds.items()], "raw string, wanted string").withColumn("got", payloads.any_value(F.col("raw")))
    assert [(r["raw"], r["got"]) for r in df.collect()] == [*kinds.items()]
    assert spark.range(1).select(payloads.any_value(F.lit(None).cast("string")).alias("x")).first()["x"] == ""
    span = lambda kind, code: f'{{"kind":{kind},"status":{{"code":{code}}}}}'
    text = f'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":""}}}}]}},"scopeSpans":[{{"spans":[{span(2, 2)},{span(chr(34) + "SPAN_KIND_CONSUMER" + chr(34), chr(34) + "STATUS_CODE_OK" + chr(34))},{{}}]}}]}}]}}'
    found = payloads.flatten_spans(spark.createDataFrame([(text,)], "payload string")).collect()
    assert [(r["service_name"], r["kind"], r["status_code"], r["name"]) for r in found] == [("unknown_service", "Server", "Error", ""), ("unknown_service", "Consumer", "Ok", ""), ("unknown_service", "Unspecified", "Unset", "")]


def test_layout_in_other_time_zones_and_readers(spark, tmp_path, shop):
    """Hours are UTC whatever the session's zone; another reader of Parquet finds the same rows."""
    _, rows = shop
    zone, before = "spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set(zone, "America/New_York")
        storage.write_signal(rows, "logs", str(tmp_path))
        spark.conf.set(zone, "Asia/Tokyo")
        assert scan.scan(spark, str(tmp_path), "logs", T0, T0 + HOUR).count() == rows.count() == 2
        assert [(r["hour"], r["hour_end"]) for r in storage.stored_files(spark, str(tmp_path), "logs").collect()] == [(13, T0 + HOUR)]
    finally:
        spark.conf.set(zone, before)
    other = duckdb.sql(f"SELECT count(*), min(hour), min(date), min(time_unix_nano) FROM read_parquet('{tmp_path}/v1/logs/*/*/*.parquet', hive_partitioning = true)").fetchall()[0]
    assert other[0] == 2 and int(other[1]) == 13 and str(other[2]) == "2026-10-07" and other[3] == rows.agg(F.min("time_unix_nano")).first()[0]


def test_a_busy_hour_is_compacted_and_expires(spark, tmp_path, monkeypatch):
    """An hour of many bytes becomes several files; nothing else of it stays; hours beyond the retention go."""
    rows = spark.range(4000).select((F.lit(T0) + F.col("id") * 1000).alias("time_unix_nano"), F.lit("hot").alias("service_name"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    rows = rows.unionByName(spark.range(1).select(F.lit(T0 + 3 * HOUR).alias("time_unix_nano"), F.lit("cold").alias("service_name"), F.lit("").alias("body")))
    for part in (0, 1):
        storage.write_signal(rows.filter(F.expr("time_unix_nano div 1000 % 2") == part), "logs", str(tmp_path))
    monkeypatch.setattr(storage, "FILE_BYTES", 30_000)
    done = storage.compact_hours(spark, str(tmp_path), "logs", T0 + 24 * HOUR)
    assert [(r["hour"], r["files"]) for r in done.collect()] == [(13, 2)]
    left = {r["hour"]: r["files"] for r in storage.stored_files(spark, str(tmp_path), "logs").collect()}
    assert left[16] == 1 and 1 < left[13] < 9 and scan.read_signal(spark, str(tmp_path), "logs").select("body").distinct().count() == 4001
    assert not [*tmp_path.glob("staging-*")]
    gone = storage.expire(spark, str(tmp_path), "logs", T0 + 7 * 24 * HOUR + 2 * HOUR)
    assert [r["hour"] for r in gone.collect()] == [13] and scan.read_signal(spark, str(tmp_path), "logs").count() == 1


def test_waterfall_of_long_chains_and_wide_trees(spark):
    """A chain of 20,000 spans, a span of many children, several roots, an orphan and a cycle."""
    made = [span("chain", str(n), str(n - 1) if n else "", "s", "c", T0 + n, 1) for n in range(20_000)]
    made += [span("wide", str(n), "0" if n else "", "s", "w", T0 + (n * 7919) % 3001, 1) for n in range(3_000)]
    made += [span("mixed", a, b, "s", "m", T0 + k, 1) for k, (a, b) in enumerate([("a", ""), ("b", "a"), ("x", "y"), ("y", "x"), ("o", "gone"), ("z", "x"), ("c", "a"), ("d", "b"), ("e", "")])]
    found = {}
    for r in traces.waterfall(spark.createDataFrame(made, SPANS_DDL).repartition(4)).collect():
        found.setdefault(r["trace_id"], []).append((r["place"], r["span_id"], r["depth"]))
    assert sorted(found["chain"]) == [(n + 1, str(n), n) for n in range(20_000)]
    children = sorted(range(1, 3000), key=lambda n: ((n * 7919) % 3001, str(n)))
    assert sorted(found["wide"]) == [(1, "0", 0), *((k + 2, str(n), 1) for k, n in enumerate(children))]
    assert sorted(found["mixed"]) == [(1, "a", 0), (2, "b", 1), (3, "d", 2), (4, "c", 1), (5, "o", 0), (6, "e", 0)]
