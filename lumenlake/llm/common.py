"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may name none, as in tests; it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if not (known := context._jsc.sc().getCheckpointDir()).isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows in a batch that goes to Python. Whole texts are long; Spark's own limit counts rows, not bytes.
BATCH_ROWS = 1000


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id`` as long and ``text`` as it is: no other column reaches the operators, and batches are small."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: What names a stored row: a hash of its file's path, and its place in the file.
PLACE = "struct<file:long,at:long>"


def stored(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` as a table of Parquet files, and the column (``PLACE``) that names a row in every read of it, however files are split.

    A table that is not read from Parquet is written to the shared folder first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        df.select(place)
    except AnalysisException:
        folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        df = df.sparkSession.read.parquet(folder)
    return df, place


def texts_by_row(docs: DataFrame, row: Column | None) -> tuple[DataFrame, str]:
    """``texts`` with ``row`` (that of ``stored``; without it a number that holds in this read alone), and its type."""
    if row is not None:
        return texts(docs, row.alias("row")), PLACE
    return texts(docs.withColumn("_row", F.monotonically_increasing_id()), F.col("_row").alias("row")), "long"


def without_rows(df: DataFrame, place: Column, gone: DataFrame) -> DataFrame:
    """The table ``df`` without the rows whose ``place`` (both from ``stored``) is a ``row`` of ``gone``."""
    row = free_name(df, "row")
    return df.withColumn(row, place).join(gone.select(F.col("row").alias(row)), row, "left_anti").drop(row)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


Batches = Iterator[pa.RecordBatch]
