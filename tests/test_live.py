"""Rules and increments live, held against the batch operators on the same rows."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import alerts, metrics, traces
from lumenlake.schema import LOGS_DDL, NANOS, POINTS_DDL, RULES_DDL, SPANS_DDL
from lumenlake.streaming import jobs

T0, MIN = 1_791_378_000 * NANOS, 60 * NANOS


@contextlib.contextmanager
def rocksdb(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(provider, before)


def run(spark, path, batches, schema, job):
    """The rows that a stream of ``batches``, one after the other, has written at its end."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with rocksdb(spark):
        out = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def log(seconds, service, level="ERROR", body="b", **attributes):
    t = T0 + int(seconds * NANOS)
    return (t, t, service, 17, level, body, "", "", "", {k: str(v) for k, v in attributes.items()}, {"service.name": service})


def rule(name, terms, group_by, op, threshold, window, hold, enabled=True):
    return (name, name, "logs", "", "", {}, terms, group_by, op, float(threshold), window, hold, [], enabled)


RULES = [
    rule("by", [("level", "error,fatal", False)], ["service.name"], ">=", 3, 120, 0),
    rule("held", [("service", "api", False), ("code", "5", True)], ["code"], ">", 0, 60, 120),
    rule("few", [("level", "error", False)], [], "<", 2, 60, 60),
    rule("silent", [("", "never said", False)], [], "<=", 0, 60, 0),
    rule("off", [], [], ">=", 0, 60, 0, False),
    rule("odd", [("level", "error", False)], [], "!=", 0, 60, 0),
]


def test_live_rules_equal_the_back_test(spark, tmp_path):
    """Groups that come, stay silent and come back, rules of all kinds, rows that come late within the grace."""
    dice = random.Random(4)
    rows = [log(dice.uniform(0, 3000), dice.choice(["api", "web"]), dice.choice(["ERROR", "INFO", "FATAL"]), code=dice.choice([4, 5])) for _ in range(160)]
    rows += [log(4000 + 20 * k, "db") for k in range(12)] + [log(5000, "api", "INFO"), log(5001, "last", "INFO")]
    late = sorted(rows, key=lambda r: r[0] + dice.uniform(0, 240) * NANOS)
    late[-1], newest = max(rows), late[-1]
    late.insert(0, newest) if newest not in late else None
    batches = [late[k : k + 40] for k in range(0, len(late), 40)]
    known = spark.createDataFrame(RULES, RULES_DDL)
    got = run(spark, tmp_path, batches, LOGS_DDL, lambda logs: jobs.rule_events(logs, known, 30 * NANOS, 300 * NANOS))
    every, slot = 30 * NANOS, alerts.tick_slot(known, 30 * NANOS)
    assert slot == 30 * NANOS
    low, high = min(rows)[0] // slot * slot + slot, max(rows)[0] // slot * slot - 300 * NANOS
    ticks = alerts.log_rule_ticks(spark.createDataFrame(late, LOGS_DDL), known, every, low, high)
    wanted = alerts.backtest_events(alerts.alert_backtest(known, ticks, every), ticks, every)
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(got) == as_rows(wanted)
    kinds = {(r[0], r[2]) for r in as_rows(got)}
    assert {("by", "firing"), ("by", "resolved"), ("held", "firing"), ("few", "firing"), ("few", "resolved"), ("silent", "firing")} <= kinds and not {"off", "odd"} & {k for k, _ in kinds}


def test_ticks_equal_one_evaluation_each(spark):
    """The values of all ticks at once are those of the operator that evaluates one."""
    dice = random.Random(5)
    rows = spark.createDataFrame([log(dice.uniform(0, 900), dice.choice(["api", "web"]), dice.choice(["ERROR", "INFO"]), code=dice.choice([4, 5])) for _ in range(80)], LOGS_DDL)
    known = spark.createDataFrame([*RULES, rule("wide", [], ["service.name", "level"], ">", 0, 90, 0)], RULES_DDL)
    every = 45 * NANOS
    low = (T0 // every + 3) * every
    ticks = alerts.log_rule_ticks(rows, known, every, low, low + 4 * every).collect()
    for now in (low, low + every, low + 4 * every):
        one = sorted((r["rule_id"], r["group"], r["value"]) for r in alerts.log_rule_values(rows, known, now).collect())
        assert one == sorted((r["rule_id"], r["group"], r["value"]) for r in ticks if r["tick"] == now)


@pytest.mark.parametrize("at_once", [0, 10_000])
def test_rules_meet_logs_by_keys(spark, monkeypatch, at_once):
    """By trace, attribute (with a = in its name), service or level, and by text alone; broadcast or not."""
    monkeypatch.setattr(alerts, "AT_ONCE", at_once)
    rows = [log(1, "api", **{"a=b": "x"}), log(2, "api", "info", body="Said It"), log(3, "web", "WARN", code=7)]
    rows[0] = (*rows[0][:6], "t1", *rows[0][7:])
    rules = [
        rule("trace", [("trace_id", "t1", False)], [], ">", 0, 60, 0), rule("attribute", [("a=b", "x", False), ("service", "api", False)], [], ">", 0, 60, 0),
        rule("resource", [("service.name", "web", False)], [], ">", 0, 60, 0), rule("levels", [("severity", " info , warn,INFO", False)], ["level"], ">", 0, 60, 0),
        rule("text", [("", "said", False), ("level", "error", True)], [], ">", 0, 60, 0), rule("not", [("code", "8", True)], [], ">", 0, 60, 0), rule("all", [], [], ">", 0, 60, 0),
    ]
    found = alerts.log_rule_values(spark.createDataFrame(rows, LOGS_DDL), spark.createDataFrame(rules, RULES_DDL), T0 + 60 * NANOS)
    assert sorted(map(tuple, found.collect())) == [
        ("all", "", 3.0), ("attribute", "", 1.0), ("levels", "level=INFO", 1.0), ("levels", "level=WARN", 1.0), ("not", "", 1.0), ("resource", "", 1.0), ("text", "", 1.0), ("trace", "", 1.0),
    ]


def point(kind, series, t, start, value=None, count=None, total=None, bounds=None, buckets=None):
    return ("m", kind, "1", "Cumulative", kind == "Sum", series, "s", "", {}, {"service.name": "s"}, start, t * NANOS + T0, value, count, total, None, None, bounds, buckets)


def series(dice, number):
    """A counter and a histogram that now and then begin anew, with or without another start, and change their buckets."""
    start, value, counts, out = 0, 0.0, [0, 0, 0], []
    for k in range(40):
        if dice.random() < 0.1:
            start, value, counts = (start if dice.random() < 0.5 else k), 0.0, [0] * dice.choice([2, 3])
        value += dice.randint(0, 9)
        counts = [c + dice.randint(0, 3) for c in counts]
        t = k * 15 + number
        out.append(point("Sum", number, t, start, value))
        out.append(point("Histogram", 100 + number, t, start, None, sum(counts), float(sum(counts)) * 2, [float(b) for b in range(len(counts) - 1)], counts))
    return out


def test_live_increments_equal_those_of_tables(spark, tmp_path):
    dice = random.Random(6)
    points = [p for n in range(5) for p in series(dice, n)]
    end = point("Sum", 999, 2000, 0, 1.0)  # moves the watermark past all others
    late = sorted(points, key=lambda p: p[11] + dice.uniform(0, 280) * NANOS)
    batches = [*(late[k : k + 90] for k in range(0, len(late), 90)), [end], [point("Sum", 0, 3, 0, 5.0)]]  # the last one comes too late
    got = run(spark, tmp_path, batches, POINTS_DDL, lambda rows: jobs.live_increments(rows, ["series_id"], "5 minutes"))
    table = spark.createDataFrame(points, POINTS_DDL)
    counters = metrics.counter_increments(table.filter("type = 'Sum'")).filter("before is not null")
    shown = lambda df, *cs: sorted((tuple(r) for r in df.select("series_id", "time_unix_nano", *cs).collect()), key=repr)
    assert shown(got.filter("series_id < 100"), "value") == shown(counters, F.col("increment").alias("value"))
    histograms = metrics.distribution_increments(table.filter("type = 'Histogram'"))
    assert shown(got.filter("series_id >= 100 and series_id < 999"), "count", "sum", "bucket_counts") == shown(histograms, "count", "sum", "bucket_counts")
    assert got.filter("series_id = 999").count() == 0


def test_a_series_that_was_silent_for_long_begins_anew(spark, tmp_path):
    minute = lambda m, value: [point("Sum", 1, 60 * m, 0, value), point("Sum", 2, 60 * m, 0, float(m))]
    batches = [minute(0, 1.0), minute(1, 3.0), [point("Sum", 2, 60 * m, 0, float(m)) for m in range(2, 90)], minute(100, 9.0), minute(101, 10.0), [point("Sum", 2, 9000, 0, 500.0)]]
    got = run(spark, tmp_path, batches, POINTS_DDL, lambda rows: jobs.live_increments(rows, ["series_id", "service_name"], "5 minutes", "30 minutes"))
    assert [(r["value"], r["service_name"]) for r in got.filter("series_id = 1").orderBy("time_unix_nano").collect()] == [(2.0, "s"), (1.0, "s")]


def span(trace, name, parent, at, status="Unset", length=1, service="a"):
    start = T0 + int(at * NANOS)
    return (trace, name, parent, f"n{name}", "Server", start, start + length * NANOS, length * NANOS, status, f"m{name}", service, "", {}, {}, [], start)


def test_live_traces(spark, tmp_path):
    """Told of when quiet, again when a span comes late, anew when it had been forgotten; origins through spans of any status, missing ones and cycles."""
    arrived = lambda s, at: (*s[:-1], T0 + int(at * NANOS))
    first = [span("t1", "1", "", 0, length=9), span("t1", "2", "1", 1, "Error", service="b"), span("t1", "3", "2", 2), span("t1", "4", "3", 3, "Error"), span("t2", "1", "9", 5, "Error")]
    first += [span("t3", "1", "2", 4, "Error"), span("t3", "2", "1", 4), span("t3", "3", "2", 5, "Error"), span("t1", "1", "", 0, length=9)]
    late = [arrived(span("t1", "5", "4", 4, "Error", service="c"), 150), arrived(span("t2", "9", "", 1), 160), span("t4", "1", "", 170)]
    again = [arrived(span("t2", "7", "9", 6), 5000), span("end", "1", "", 20_000)]
    tick = lambda at: [[span("tick", str(at + k), "", at + k)] for k in (0, 1)]  # noqa: E731  (a watermark holds from the next batch on)
    batches = [first, *tick(100), late, *tick(400), *tick(2000), again]
    out = run(spark, tmp_path, batches, f"{SPANS_DDL}, received bigint", lambda s: jobs.live_traces(s, "30 seconds", "10 minutes", "10 seconds", "received"))
    told = {(r["trace_id"], r["revision"], r["spans"]): r for r in out.filter("trace_id not in ('tick', 'end')").collect()}
    assert sorted(told) == [("t1", 1, 4), ("t1", 2, 5), ("t2", 1, 1), ("t2", 2, 2), ("t3", 1, 3), ("t4", 1, 1)]
    assert out.filter("trace_id = 't2' and revision = 1").count() == 2  # forgotten, and begun anew
    origins = lambda *key: sorted(o["span_id"] for o in told[key]["origins"])
    assert origins("t1", 1, 4) == ["4"] and origins("t1", 2, 5) == ["5"] and origins("t3", 1, 3) == ["3"]
    assert (told["t1", 2, 5]["root_name"], told["t1", 2, 5]["duration"], told["t1", 2, 5]["errors"], told["t1", 2, 5]["services"]) == ("n1", 9 * NANOS, 3, ["a", "b", "c"])
    assert told["t2", 2, 2]["root_name"] == "n9"
    latest = {r["trace_id"]: r["spans"] for r in jobs.latest_traces(out).collect()}
    assert latest["t1"] == 5 and latest["t2"] == 2
    rows = spark.createDataFrame([s[:-1] for s in {(x[0], x[1]): x for x in first + late[:1]}.values() if s[0] in ("t1", "t3")], SPANS_DDL)
    batch = sorted((r["trace_id"], r["span_id"]) for r in traces.error_origins(rows).collect())
    assert batch == [("t1", "5"), ("t3", "3")]


def point(metric, series, seconds):
    return (metric, "Gauge", "", "", False, series, "s", "", {}, {}, 0, T0 + int(seconds * NANOS), 1.0, None, None, None, None, None, None)


@pytest.mark.parametrize("limit", [1, 3, 40, 500])
def test_first_series_as_the_guard_knows_them(spark, tmp_path, limit):
    rng = random.Random(limit)
    rows = [point(rng.choice(["a", "a", "b"]), rng.randrange(120), 60 * rng.randrange(90) + 1e-3 * rng.randrange(3)) for _ in range(1500)]
    rows += [point("one", 7, 30), point(None, 7, 30), point("a", None, 30)]
    rows.sort(key=lambda p: p[11] + rng.randrange(20 * MIN))  # up to twenty minutes late
    batches = [*(rows[n : n + 300] for n in range(0, len(rows), 300)), [point("end", 0, 86400)], [point("end", 0, 86401)]]
    told = run(spark, tmp_path, batches, POINTS_DDL, lambda df: jobs.first_series(df, limit, "30 minutes"))
    parts = told.groupBy("metric_name", "salt").count().agg(F.max("count")).first()[0]
    assert parts <= limit and told.count() == told.select("metric_name", "series_id").distinct().count()
    points = spark.createDataFrame([r for b in batches for r in b if r[0] != "end" and r[0] is not None and r[5] is not None], POINTS_DDL)
    shown = lambda df: sorted(map(tuple, df.filter("series <> '__overflow__'").select("metric_name", "series").distinct().collect()))
    kept = jobs.admitted(told.filter("metric_name <> 'end'"), limit)
    assert shown(metrics.overflowing(points, kept)) == shown(metrics.cardinality_guard(points, limit))


def test_a_late_first_point_counts_from_when_it_came(spark, tmp_path):
    batches = [[point("a", 1, 7200), point("a", 2, 7300)], [point("a", 3, 90000)], [point("a", 4, 60), point("a", 4, 90001)], [point("a", 9, 300000)], [point("a", 9, 300001)]]
    told = run(spark, tmp_path, batches, POINTS_DDL, lambda df: jobs.first_series(df, 5, "1 minute"))
    assert [r[0] for r in told.orderBy("first").select("series_id").collect()] == [1, 2, 4, 3]
