"""Signatures of stored files by the trigrams of their text: they tell which files a search for a text has to open.

A signature is a row per file (``date=/hour=/name``, since a task gives its files of several hours one name) in ``<root>/signatures/<signal>``: the slots, by a hash, of all trigrams of its rows' lower-cased titles and
attribute values. A file that lacks a slot of the text sought cannot hold it. Files without a signature are always opened, so that one that
is missing or late costs time and no rows; so do texts of fewer than three characters, which have no trigram.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Term
from ..functions.time import hours_between, in_range
from ..schema import SCHEMAS, TIME
from . import folders
from .scan import read_signal, signal_path

TITLE = {"logs": "body", "spans": "name"}
#: Slots of a signature: at most this many whole numbers are kept for a file, whatever its rows.
SLOTS = 1 << 17
#: Files named in a scan's predicate at most. Where more files may hold the text, all of the range are opened.
NAMES = 20_000
_SCHEMA = "file string, slots array<int>, date date, hour int"


def _slots(text: Column) -> Column:
    """The slots of all trigrams of ``text``, which is in lower case already; none of a null or of fewer than three characters."""
    letters = F.split(text, "")
    starts = F.greatest(F.size(letters) - 2, F.lit(0))
    part = lambda k: F.slice(letters, k, starts)
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
    trigrams = joined(joined(part(1), part(2)), part(3))
    found = F.array_distinct(F.transform(trigrams, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")))
    return F.when(text.isNotNull() & (F.length(text) >= 3), found).otherwise(F.array().cast("array<int>"))


def signatures_path(root: str, signal: str) -> str:
    return f"{root}/signatures/{signal}"


def kept(spark: SparkSession, root: str, signal: str) -> bool:
    """Whether a signal has signatures, which compaction then keeps up to date."""
    return folders.exists(spark, signatures_path(root, signal))


def signatures(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """file, slots, date, hour of every file that has a signature."""
    return spark.read.schema(_SCHEMA).parquet(signatures_path(root, signal)) if kept(spark, root, signal) else spark.createDataFrame([], _SCHEMA)


def _files(spark: SparkSession, root: str, signal: str) -> DataFrame:
    return folders.parquet_files(spark, signal_path(root, signal)).withColumn("file", folders.place("path"))


def refresh(spark: SparkSession, root: str, signal: str) -> int:
    """Sign the files that have no signature yet; how many. For the sink, after it has written, and for compaction.

    The rows of these files are read once; a set of slots per file and task is shuffled. A file's signature is one row, so a
    refresh that was stopped leaves whole signatures or none, and the next one does the rest.
    """
    new = [f["path"] for f in _files(spark, root, signal).join(signatures(spark, root, signal).select("file"), "file", "left_anti").select("path").collect()]  # names of new files
    if not new:
        return 0
    rows = spark.read.schema(f"{SCHEMAS[signal]}, date date, hour int").option("basePath", signal_path(root, signal)).parquet(*new)
    values = F.array_join(F.map_values("attributes"), " ")
    both = F.array_union(_slots(F.lower(TITLE[signal])), _slots(F.lower(values)))
    at = rows.select(folders.place("_metadata.file_path").alias("file"), "date", F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"), F.explode_outer(both).alias("slot"))
    signed = at.groupBy("file", "date", "hour").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    signed.hint("rebalance", "date", "hour").write.mode("append").partitionBy("date", "hour").option("compression", "zstd").parquet(signatures_path(root, signal))
    return len(new)


def files_to_open(spark: SparkSession, root: str, signal: str, terms: Iterable[Term], from_ns: int | None = None, to_ns: int | None = None) -> list[str] | None:
    """Names of the stored files of a range that may hold rows that all ``terms`` match; None if all have to be opened."""
    sought = [value.lower() for key, value, negated in terms if key == "" and not negated and len(value.lower()) > 2]
    if not sought or not kept(spark, root, signal):
        return None
    lacking = F.lit(False)
    for text in sought:
        lacking |= F.size(F.array_except(_slots(F.lit(text)), "slots")) > 0
    without = signatures(spark, root, signal).filter(hours_between(from_ns, to_ns)).filter(lacking).select("file")
    left = _files(spark, root, signal).filter(hours_between(from_ns, to_ns)).join(without, "file", "left_anti")
    names = [f["file"] for f in left.select("file").limit(NAMES + 1).collect()]
    return names if len(names) <= NAMES else None


def scan_text(spark: SparkSession, root: str, signal: str, terms: Iterable[Term], from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """``scan.scan`` for a search by ``terms``: the same rows, less those of files that cannot hold a text sought. The terms are still to be applied."""
    rows = read_signal(spark, root, signal)  # the files are listed here, before those to open are looked up: none that comes later is missed
    names = files_to_open(spark, root, signal, terms, from_ns, to_ns)
    if names is not None:
        rows = rows.filter(folders.place("_metadata.file_path").isin(names))
    return rows.filter(hours_between(from_ns, to_ns)).filter(in_range(TIME[signal], from_ns, to_ns)).drop("date", "hour")
