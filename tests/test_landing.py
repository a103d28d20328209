"""Rows are seen once, wherever a job stops."""

import pytest
from pyspark.sql import functions as F

from lumenlake.schema import HOUR, LOGS_DDL, NANOS
from lumenlake.sources import folders, landing, scan, storage

T0 = 1_791_378_000 * NANOS


def batch(spark, low, high):
    """Logs of two hours, a number each."""
    rows = spark.range(low, high, numPartitions=2)
    t = (F.lit(T0) + (F.col("id") % 2) * HOUR + F.col("id")).alias("time_unix_nano")
    return rows.select(t, F.concat(F.lit("s"), F.col("id") % 3).alias("service_name"), F.col("id").cast("string").alias("body")).select(
        *(c if c in ("time_unix_nano", "service_name", "body") else F.lit(None).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in LOGS_DDL.split(", ")))
    )


def seen(spark, root):
    return sorted(int(r["body"]) for r in landing.current(spark, root, "logs").select("body").collect())


class Stopped(Exception):
    pass


def stop_at(monkeypatch, step):
    """Let the ``step``-th change of a file system be the last one."""
    left = [step]
    for name in ("move", "rename", "delete", "write_text"):

        def counted(*args, of=getattr(folders, name)):
            if left[0] == 0:
                raise Stopped
            left[0] -= 1
            return of(*args)

        monkeypatch.setattr(folders, name, counted)
    return left


def test_land_promote_and_read(spark, tmp_path):
    root = str(tmp_path)
    assert landing.land(batch(spark, 0, 10), "logs", root, 0) and not landing.land(batch(spark, 0, 10), "logs", root, 0)
    assert landing.land(batch(spark, 10, 15), "logs", root, 1) and seen(spark, root) == [*range(15)]
    assert landing.promote(spark, root, "logs") == ["0", "1"] and landing.promote(spark, root, "logs") == []
    assert not landing.land(batch(spark, 10, 15), "logs", root, 1)  # it comes again after it has been stored
    assert landing.land(batch(spark, 15, 20), "logs", root, 2) and seen(spark, root) == [*range(20)]
    assert scan.read_signal(spark, root, "logs").count() == 15 and landing.landed(spark, root, "logs").count() == 5
    assert landing.current(spark, root, "logs", T0, T0 + HOUR).count() == 10
    assert sorted(r["batch"] for r in landing.ledger(spark, root, "logs").collect()) == ["0", "1"]


@pytest.mark.parametrize("step", range(9))
def test_a_promotion_that_stops(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    landing.land(batch(spark, 0, 8), "logs", root, 0)
    landing.promote(spark, root, "logs")
    landing.land(batch(spark, 8, 12), "logs", root, 1)
    with monkeypatch.context() as patched:
        stop_at(patched, step)
        with pytest.raises(Stopped):
            landing.promote(spark, root, "logs")
    assert seen(spark, root) == [*range(12)]
    landing.land(batch(spark, 8, 12), "logs", root, 1)  # the source repeats it
    assert seen(spark, root) == [*range(12)]
    landing.promote(spark, root, "logs")
    assert seen(spark, root) == [*range(12)] and scan.read_signal(spark, root, "logs").count() == 12 and not folders.names(spark, landing.landing_path(root, "logs"))


@pytest.mark.parametrize("step", range(0, 12, 2))
def test_a_compaction_that_stops(spark, tmp_path, monkeypatch, step):
    root, now = str(tmp_path), T0 + 24 * HOUR
    for n in range(3):
        storage.write_signal(batch(spark, 10 * n, 10 * n + 10), "logs", root)
    with monkeypatch.context() as patched:
        left = stop_at(patched, step)
        try:
            storage.compact_hours(spark, root, "logs", now)
            assert left[0] >= 0
        except Stopped:
            pass
    assert seen(spark, root) == [*range(30)]
    storage.compact_hours(spark, root, "logs", now)
    assert seen(spark, root) == [*range(30)] and {r["files"] for r in storage.stored_files(spark, root, "logs").collect()} == {1}
    assert not folders.names(spark, f"{root}/swaps/logs")


def test_files_of_a_busy_hour_do_not_overlap(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for n in range(2):
        storage.write_signal(batch(spark, 4000 * n, 4000 * n + 4000).withColumn("trace_id", F.sha2("body", 256)), "logs", root)
    monkeypatch.setattr(storage, "FILE_BYTES", 60_000)
    storage.compact_hours(spark, root, "logs", T0 + 24 * HOUR)
    rows = scan.read_signal(spark, root, "logs").withColumn("file", F.col("_metadata.file_name"))
    ranges = rows.groupBy("date", "hour", "file").agg(F.min(F.struct("service_name", "time_unix_nano")).alias("low"), F.max(F.struct("service_name", "time_unix_nano")).alias("high")).collect()
    assert len(ranges) > 4 and rows.count() == 8000
    for a in ranges:
        assert not any(a["file"] != b["file"] and (a["date"], a["hour"]) == (b["date"], b["hour"]) and tuple(a["low"]) <= tuple(b["low"]) <= tuple(a["high"]) for b in ranges)


def test_a_stream_lands_and_is_promoted(spark, tmp_path):
    root = f"{tmp_path}/root"
    for n in range(3):
        batch(spark, 10 * n, 10 * n + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOGS_DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    landing.land_stream(stream, "logs", root, f"{tmp_path}/c", {"availableNow": True}).awaitTermination()
    assert seen(spark, root) == [*range(30)] and landing.promote(spark, root, "logs") == ["0", "1", "2"] and seen(spark, root) == [*range(30)]


@pytest.mark.parametrize("step", range(1, 7))
def test_compaction_of_one_hour_leaves_the_other_alone(spark, tmp_path, monkeypatch, step):
    """A task's files of both hours have one name; only the first hour is due."""
    root = str(tmp_path)
    for low in (0, 10):
        storage.write_signal(batch(spark, low, low + 10).coalesce(1), "logs", root)
    with monkeypatch.context() as m:
        stop_at(m, step)
        try:
            storage.compact_hours(spark, root, "logs", T0 // HOUR * HOUR + HOUR + storage.GRACE)
        except Stopped:
            pass
    assert seen(spark, root) == list(range(20))
