"""Search, volume, counts and facets of logs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Term, group_key, log_filter, severity
from ..functions.time import bucket, bucket_start, in_range, nice_step

LIMIT, MOST = 100, 1000
RECORD = ["time_unix_nano", "service_name", "severity_number", "severity_text", "body", "trace_id", "span_id", "attributes", "resource_attributes"]


def limited(limit: int, default: int, most: int) -> int:
    """``limit`` within 1..``most``; the default if it is not positive."""
    return default if limit <= 0 else min(limit, most)


def matching(logs: DataFrame, terms: Iterable[Term], from_ns: int | None, to_ns: int | None) -> DataFrame:
    return logs.filter(in_range("time_unix_nano", from_ns, to_ns)).filter(log_filter(terms))


def search_logs(logs: DataFrame, terms: Iterable[Term], from_ns: int | None, to_ns: int | None, limit: int = LIMIT) -> DataFrame:
    """The newest matching logs; ties by span id and body."""
    rows = matching(logs, terms, from_ns, to_ns).select(RECORD)
    return rows.orderBy(F.desc("time_unix_nano"), "span_id", "body").limit(limited(limit, LIMIT, MOST))


def log_histogram(logs: DataFrame, terms: Iterable[Term], from_ns: int, to_ns: int, step_ns: int | None = None) -> DataFrame:
    """bucket_start, level, logs: how many matching logs each step has by level. Empty steps are absent."""
    step_ns = step_ns or nice_step(to_ns - from_ns, 60)
    rows = matching(logs, terms, from_ns, to_ns).select(bucket("time_unix_nano", from_ns, step_ns).alias("n"), severity().alias("level"))
    return rows.groupBy("n", "level").agg(F.count(F.lit(1)).alias("logs")).select(bucket_start("n", from_ns, step_ns).alias("bucket_start"), "level", "logs")


def count_logs(logs: DataFrame, terms: Iterable[Term], from_ns: int | None, to_ns: int | None, group_by: Sequence[str] = ()) -> DataFrame:
    """Matching logs per combination of keys, ordered by them; without keys one row, which may be 0."""
    rows = matching(logs, terms, from_ns, to_ns)
    if not group_by:
        return rows.agg(F.count(F.lit(1)).alias("logs"))
    return rows.groupBy(*(group_key(k).alias(k) for k in group_by)).agg(F.count(F.lit(1)).alias("logs")).orderBy(*(F.col(f"`{k}`") for k in group_by))


def log_facet(logs: DataFrame, terms: Iterable[Term], from_ns: int | None, to_ns: int | None, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """key, value, logs: the most frequent values of each key, all keys in one pass; ties by value."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), group_key(k).alias("value")) for k in keys))
    rows = matching(logs, terms, from_ns, to_ns).select(F.explode(pairs).alias("pair")).select("pair.key", "pair.value")
    counts = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("logs"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("logs"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= limit)
