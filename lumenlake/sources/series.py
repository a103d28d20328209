"""Metric points that hold the id of their series alone, beside a dictionary of the series.

``<root>/series`` has a row per series: its metric, what else names it, both attribute maps, and ``series``, a hash of all these.
``<root>/v1/points`` has the points by hour, without maps. Filters on attributes are resolved on the dictionary, and the points are
read by ids. A batch brings its new series first, so that no point is stored without its series; series of a batch that was
stopped are there already when it comes again. One job at a time writes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import attributes_match
from ..functions.time import hours_between, in_range
from ..schema import POINTS_DDL
from . import folders
from .storage import FILE_ROWS, hourly

_TYPES = dict(c.split(" ", 1) for c in POINTS_DDL.split(", "))
#: What belongs to a series; the rest belongs to a point.
SERIES = ["metric_name", "type", "unit", "temporality", "is_monotonic", "series_id", "service_name", "scope_name", "attributes", "resource_attributes"]
_OF_POINT = [c for c in _TYPES if c not in SERIES]
_DICTIONARY = ", ".join(["series bigint", *(f"{c} {_TYPES[c]}" for c in SERIES)])
_POINTS = ", ".join(["metric_name string", "series bigint", *(f"{c} {_TYPES[c]}" for c in _OF_POINT), "date date", "hour int"])
_ENTRIES = "array<struct<key:string,value:string>>"
_IDENTITY = ", ".join(f"{c} {_ENTRIES if _TYPES[c].startswith('map') else _TYPES[c]}" for c in SERIES)
#: Series that are broadcast at most (counted; beyond it the join shuffles), and ids that go into the predicate of the scan at most.
BROADCAST, PUSHED = 20_000, 10


def _identity() -> Column:
    """All that belongs to a series as JSON, the same in whatever order the maps are; null columns and null maps are left out of it."""
    entries = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.to_json(F.struct(*(entries(c).alias(c) if _TYPES[c].startswith("map") else F.col(c) for c in SERIES)))


def dictionary(spark: SparkSession, root: str) -> DataFrame:
    """series and what belongs to it, each once."""
    path = f"{root}/series"
    return spark.read.schema(_DICTIONARY).parquet(path) if folders.exists(spark, path) else spark.createDataFrame([], _DICTIONARY)


def new_series(points: DataFrame, known: DataFrame) -> DataFrame:
    """The series of ``points`` that are not among ``known`` (metric_name, series). Points are reduced to their series before the shuffle."""
    identity = points.select("metric_name", _identity().alias("identity")).distinct()
    keyed = identity.withColumn("series", F.xxhash64("identity"))
    before = known.select(F.col("metric_name").alias("known_name"), F.col("series").alias("known"))
    missing = keyed.join(before, (F.col("series") == F.col("known")) & F.col("metric_name").eqNullSafe(F.col("known_name")), "left_anti")
    of = missing.select("series", F.from_json("identity", _IDENTITY).alias("s"))
    return of.select("series", *((F.map_from_entries(f"s.{c}") if _TYPES[c].startswith("map") else F.col(f"s.{c}")).alias(c) for c in SERIES))


def write_points(points: DataFrame, root: str) -> None:
    """Append a batch: its new series to the dictionary, then its points, sorted within their hours by metric, series and time."""
    spark = points.sparkSession
    new = new_series(points, dictionary(spark, root)).persist()
    if not new.isEmpty():
        new.hint("rebalance").sortWithinPartitions("metric_name", "series").write.mode("append").option("compression", "zstd").parquet(f"{root}/series")
    new.unpersist()
    rows = hourly(points.select("metric_name", F.xxhash64(_identity()).alias("series"), *_OF_POINT), "metric_points")
    placed = rows.hint("rebalance", "date", "hour").sortWithinPartitions("date", "hour", "metric_name", "series", "time_unix_nano")
    placed.write.mode("append").partitionBy("date", "hour").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/v1/points")


def read_points(spark: SparkSession, root: str, metrics: Iterable[str] = (), from_ns: int | None = None, to_ns: int | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """The points of ``[from_ns, to_ns)`` of ``metrics`` (all, if none are named) whose series the ``filters`` match, with all columns, as the metric operators take them.

    Metrics and filters choose series in the dictionary first. Up to ``PUSHED`` ids reach the scan, which then skips row groups
    of other series; up to ``BROADCAST`` series meet the points without a shuffle. A query over a range needs ``metrics.LOOKBACK`` before it.
    """
    path, names = f"{root}/v1/points", list(metrics)
    if not folders.exists(spark, path):
        return spark.createDataFrame([], POINTS_DDL)
    named = F.col("metric_name").isin(names) if names else F.lit(True)
    known = dictionary(spark, root).filter(named).filter(attributes_match(filters or {}))
    found = known.select("series").limit(max(BROADCAST, PUSHED) + 1).collect()  # ids of a bounded number
    rows = spark.read.schema(_POINTS).parquet(path).filter(hours_between(from_ns, to_ns)).filter(in_range("time_unix_nano", from_ns, to_ns)).filter(named)
    if len(found) <= PUSHED:
        rows = rows.filter(F.col("series").isin([r["series"] for r in found]))
    known = known.withColumnsRenamed({"metric_name": "known_name", "series": "known"})
    known = F.broadcast(known) if len(found) <= BROADCAST else known
    return rows.join(known, (F.col("series") == F.col("known")) & F.col("metric_name").eqNullSafe(F.col("known_name"))).select(*_TYPES)
