"""Writing signals to hourly partitions, and keeping these compact and no older than wanted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import hour_number, utc_date, utc_hour
from ..schema import HOUR, SCHEMAS, SORTED_BY, TIME
from . import folders, swaps, text_index
from .scan import signal_path

GRACE, RETENTION = 5 * 60 * 1_000_000_000, 7 * 24 * HOUR
#: Rows in a file at most, and bytes of the files that are merged into one.
FILE_ROWS, FILE_BYTES = 5_000_000, 128 << 20


def hourly(df: DataFrame, signal: str) -> DataFrame:
    """``df`` with the partition columns of each row's own hour in UTC, however late it came."""
    return df.withColumn("date", utc_date(TIME[signal])).withColumn("hour", utc_hour(TIME[signal]))


def _write(rows: DataFrame, signal: str, path: str, mode: str) -> None:
    writer = rows.sortWithinPartitions("date", "hour", *SORTED_BY[signal]).write.mode(mode).partitionBy("date", "hour")
    writer = writer.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    if signal == "spans":
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.parquet(path)


def write_signal(df: DataFrame, signal: str, root: str, mode: str = "append", signed: bool = False) -> None:
    """Append rows to their hours, sorted as readers prune them; ``signed`` (logs, spans) by their text too (``text_index``).

    The shuffle is a rebalance: adaptive execution puts small hours together and splits a busy one by bytes.
    """
    _write(hourly(df, signal).hint("rebalance", "date", "hour"), signal, signal_path(root, signal), mode)
    if signed:
        text_index.refresh(df.sparkSession, root, signal)


def write_staged(df: DataFrame, signal: str, staging: str) -> None:
    """``write_signal`` to a folder of its own, from which files are moved to their hours."""
    _write(hourly(df, signal).hint("rebalance", "date", "hour"), signal, staging, "error")


def hourly_files(spark: SparkSession, folder: str) -> list[dict]:
    """date, hour, path, size of the files of an hourly folder, on the driver: for staged files, whose names have to be moved one by one."""
    return folders.parquet_files(spark, folder).collect()


def stored_files(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """signal, date, hour, hour_end, files, bytes of each stored hour, from the listing of the folder: no file is opened."""
    end = (hour_number() + 1) * HOUR
    files = folders.parquet_files(spark, signal_path(root, signal))
    return files.groupBy(F.lit(signal).alias("signal"), "date", "hour", end.alias("hour_end")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def compaction_candidates(files: DataFrame, now: int, grace: int = GRACE) -> DataFrame:
    """Hours that are over, the grace for late rows included, and have more than one file."""
    return files.filter((F.col("hour_end") + grace <= now) & (F.col("files") > 1))


def expired_partitions(files: DataFrame, now: int, retention: int | dict[str, int] = RETENTION) -> DataFrame:
    """Hours wholly older than the retention, which may differ by signal; 0 keeps all."""
    by = retention if isinstance(retention, dict) else {}
    kept = F.lit(0 if by else retention).cast("long")
    for signal, ns in by.items():
        kept = F.when(F.col("signal") == signal, F.lit(ns).cast("long")).otherwise(kept)
    return files.filter((kept > 0) & (F.col("hour_end") <= F.lit(now) - kept))


def hour_folder(root: str, signal: str, hour: dict) -> str:
    return f"{signal_path(root, signal)}/date={hour['date']}/hour={hour['hour']:02d}"


def compact_hours(spark: SparkSession, root: str, signal: str, now: int, grace: int = GRACE) -> DataFrame:
    """Rewrite closed hours of several files, sorted anew; returns the hours rewritten (date, hour, files, bytes).

    Rows are written once, to a staging folder beside the signals, an hour of many bytes by as many tasks as it needs
    files, each a range of the hour's sort order, so that files do not overlap; then the old files give way to the new ones as one change
    (``swaps``): a stop at any moment leaves each row once, for readers of this library, and the next run finishes it. The driver handles
    names of files of the due hours only.
    """
    swaps.finish(spark, root, signal)
    due = compaction_candidates(stored_files(spark, root, signal), now, grace).select("date", "hour", "files", "bytes").collect()  # a row per due hour
    hours = spark.createDataFrame(due, "date date, hour int, files long, bytes long")
    if not due:
        return hours
    old = [f["path"] for f in folders.parquet_files(spark, signal_path(root, signal)).join(F.broadcast(hours), ["date", "hour"], "left_semi").collect()]
    files = spark.read.schema(f"{SCHEMAS[signal]}, date date, hour int").option("basePath", signal_path(root, signal))
    rows = files.parquet(*old).withColumn("hour", F.lpad(F.col("hour").cast("string"), 2, "0"))  # just these: others may have come meanwhile
    large = [h for h in due if h["bytes"] > FILE_BYTES]
    in_large = F.lit(False)
    for h in large:  # hours of many files
        in_large |= (F.col("date") == F.lit(h["date"])) & (F.col("hour") == f"{h['hour']:02d}")
    tasks = sum(-(-h["bytes"] // FILE_BYTES) for h in large)
    parts = [rows.filter(~in_large).repartition(max(1, len(due) - len(large)), "date", "hour")]
    if large:
        parts.append(rows.filter(in_large).repartitionByRange(tasks, "date", "hour", *SORTED_BY[signal]))
    staging = f"{root}/staging-{uuid.uuid4().hex}"
    for n, part in enumerate(parts):
        _write(part, signal, staging, "append" if n else "error")
    come = {file["path"]: hour_folder(root, signal, file) for file in hourly_files(spark, staging)}
    swaps.begin(spark, root, signal, staging, come, old)
    swaps.finish(spark, root, signal)
    if text_index.kept(spark, root, signal):
        text_index.refresh(spark, root, signal)
    return hours


def expire(spark: SparkSession, root: str, signal: str, now: int, retention: int | dict[str, int] = RETENTION) -> DataFrame:
    """Delete the hours that ``expired_partitions`` finds; returns them (date, hour, files, bytes)."""
    gone = expired_partitions(stored_files(spark, root, signal), now, retention).select("date", "hour", "files", "bytes").collect()  # a row per expired hour
    for hour in gone:
        folders.delete(spark, hour_folder(root, signal, hour))
        folders.delete(spark, f"{text_index.signatures_path(root, signal)}/date={hour['date']}/hour={hour['hour']:02d}")
    return spark.createDataFrame(gone, "date date, hour int, files long, bytes long")


def signal_counts(logs: DataFrame, spans: DataFrame, points: DataFrame) -> DataFrame:
    """signal, items."""
    named = [df.select(F.lit(name).alias("signal")) for name, df in (("logs", logs), ("spans", spans), ("metric_points", points))]
    return named[0].union(named[1]).union(named[2]).groupBy("signal").agg(F.count(F.lit(1)).alias("items"))
