"""Reading signals from their public layout ``<root>/v1/<signal>/date=YYYY-MM-DD/hour=HH/*.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import hours_between, in_range
from ..schema import SCHEMAS, TIME
from . import folders, swaps


def signal_path(root: str, signal: str) -> str:
    return f"{root}/v1/{signal}"


def read_signal(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """All rows of a signal with the partition columns ``date`` and ``hour``; columns that older files lack are null.

    Files of a change that is under way (``swaps``) are left out, so that each row is there once.
    """
    schema, path = f"{SCHEMAS[signal]}, date date, hour int", signal_path(root, signal)
    if not folders.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows, hidden = spark.read.schema(schema).parquet(path), swaps.unseen(spark, root, signal)[0]
    return rows.filter(~folders.place("_metadata.file_path").isin(hidden)) if hidden else rows


def scan(spark: SparkSession, root: str, signal: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Rows of ``[from_ns, to_ns)``. Hours outside are pruned as partitions, row groups by the statistics of the time column."""
    rows = read_signal(spark, root, signal)
    return rows.filter(hours_between(from_ns, to_ns)).filter(in_range(TIME[signal], from_ns, to_ns)).drop("date", "hour")


def with_landing(stored: DataFrame, landing: DataFrame) -> DataFrame:
    """Stored rows and rows that have not been stored yet. ``landing.current`` keeps the two apart by a ledger."""
    return stored.unionByName(landing, allowMissingColumns=True)
