"""Increments of many series live, held against the batch operators on the same rows."""

import contextlib
import random

from pyspark.sql import functions as F

from lumenlake.operators import metrics
from lumenlake.schema import NANOS, POINTS_DDL
from lumenlake.streaming import jobs

T0 = 1_791_378_000 * NANOS


@contextlib.contextmanager
def rocksdb(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(provider, before)


def run(spark, path, batches, job):
    """What a stream of ``batches``, one after the other, has written at its end, and the most rows that its state had."""
    for batch in batches:
        spark.createDataFrame(batch, POINTS_DDL).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with rocksdb(spark):
        out = job(spark.readStream.schema(POINTS_DDL).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).format("parquet").start(f"{path}/out")
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out"), max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)


def point(kind, series, t, start, value=None, count=None, total=None, bounds=None, buckets=None, metric="m"):
    return (metric, kind, "1", "Cumulative", kind == "Sum", series, "s", "", {}, {"service.name": "s"}, start, t * NANOS + T0, value, count, total, None, None, bounds, buckets)


def series(dice, number, points=40):
    """A counter and a histogram that now and then begin anew, with or without another start, change their buckets, and have points of one time."""
    start, value, counts, out = 0, 0.0, [0, 0, 0], []
    for k in range(points):
        if dice.random() < 0.1:
            start, value, counts = (start if dice.random() < 0.5 else k), 0.0, [0] * dice.choice([2, 3])
        value += dice.randint(0, 9)
        counts = [c + dice.randint(0, 3) for c in counts]
        t = k // 2 * 30 + number if dice.random() < 0.2 else k * 15 + number
        out.append(point("Sum", number, t, start, None if dice.random() < 0.05 else float("nan") if dice.random() < 0.05 else value))
        out.append(point("Histogram", 100 + number, t, start, None, sum(counts), None if dice.random() < 0.05 else float(sum(counts)) * 2, [float(b) for b in range(len(counts) - 1)], counts))
    return out


def shown(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select("series_id", "time_unix_nano", *columns).collect())


def test_increments_equal_those_of_tables(spark, tmp_path, monkeypatch):
    """In any order within the grace, over many batches and pieces, with absent values, values that are no number, and points of one time."""
    monkeypatch.setattr(jobs, "PIECE", 37)
    dice = random.Random(6)
    points = [p for n in range(8) for p in series(dice, n)]
    late = sorted(points, key=lambda p: p[11] + dice.uniform(0, 280) * NANOS)
    batches = [*(late[k : k + 120] for k in range(0, len(late), 120)), [point("Sum", 999, 2000, 0, 1.0)], [point("Sum", 0, 3, 0, 5.0)]]  # the last one comes too late
    got, _ = run(spark, tmp_path, batches, lambda rows: jobs.live_increments(rows, ["series_id"], "5 minutes"))
    assert [c for c, _ in got.dtypes] == ["series_id", "start_time_unix_nano", "time_unix_nano", "value", "count", "sum", "explicit_bounds", "bucket_counts"]
    table = spark.createDataFrame(points, POINTS_DDL)
    counters = metrics.counter_increments(table.filter("type = 'Sum'")).filter("before is not null")
    assert shown(got.filter("series_id < 100"), "value") == shown(counters, F.col("increment").alias("value"))
    histograms = metrics.distribution_increments(table.filter("type = 'Histogram'"))
    assert shown(got.filter("series_id >= 100 and series_id < 999"), "count", "sum", "bucket_counts") == shown(histograms, "count", "sum", "bucket_counts")
    assert got.filter("series_id = 999").count() == 0


def test_a_silent_series_begins_anew(spark, tmp_path):
    minute = lambda m, value: [point("Sum", 1, 60 * m, 0, value), point("Sum", 2, 60 * m, 0, float(m))]
    batches = [minute(0, 1.0), minute(1, 3.0), [point("Sum", 2, 60 * m, 0, float(m)) for m in range(2, 90)], minute(100, 9.0), minute(101, 10.0), [point("Sum", 2, 9000, 0, 500.0)]]
    got, _ = run(spark, tmp_path, batches, lambda rows: jobs.live_increments(rows, ["series_id", "service_name"], "5 minutes", "30 minutes"))
    assert [(r["value"], r["service_name"]) for r in got.filter("series_id = 1").orderBy("time_unix_nano").collect()] == [(2.0, "s"), (1.0, "s")]


def test_state_goes_with_parts_and_not_with_series(spark, tmp_path):
    """2,500 series take no more rows of state than their parts do; each used to have a state and timers of its own."""
    batches = [[point("Sum", n, t, 0, float(n * t)) for n in range(2500)] for t in (1, 2, 3)] + [[point("Sum", 0, 4000, 0, 0.0)]]
    got, rows = run(spark, tmp_path, batches, lambda points: jobs.live_increments(points, ["series_id"], "5 minutes"))
    assert got.count() == 5000 and got.filter("value <> series_id").count() == 0
    assert rows <= 10 * jobs.PARTS, rows  # 513 here; 5,001 when each series had a state


def test_whole_numbers_beside_absent_ones(spark, tmp_path):
    """Ids and counts above 2^53 stay what they are beside null ones in one batch."""
    big = 2**60 + 1
    made = [(big, 0), (big + 1, 0), (None, 0)]
    batches = [[p for s, at in made for p in (point("Sum", s, t, 0, float(t)), point("Histogram", s, t, 0, None, big + t * (1 + at), 1.0, [1.0], [t, t], metric="h"))] for t in (1, 2)]
    batches.append([point("Sum", 5, 4000, 0, 0.0)])
    got, _ = run(spark, tmp_path, batches, lambda points: jobs.live_increments(points, ["metric_name", "series_id"], "5 minutes"))
    assert sorted(((r["series_id"], r["value"], r["count"], r["bucket_counts"]) for r in got.collect()), key=repr) == sorted(
        [x for s, _ in made for x in ((s, 1.0, None, None), (s, None, 1, [1, 1]))], key=repr
    )
