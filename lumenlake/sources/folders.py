"""Listing, moving, deleting and small files in folders of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, system = _path(spark, path)
    system.delete(at, True)


def move(spark: SparkSession, source: str, folder: str) -> None:
    """One file into ``folder``."""
    at, system = _path(spark, source)
    into = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system.mkdirs(into)
    if not system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(into, at.getName())):
        raise OSError(f"could not move {source} to {folder}")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder to another name, whose folder is made if need be."""
    at, system = _path(spark, source)
    system.mkdirs(_path(spark, target)[0].getParent())
    if not system.rename(at, _path(spark, target)[0]):
        raise OSError(f"could not rename {source} to {target}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder. For folders of few entries."""
    at, system = _path(spark, folder)
    return sorted(status.getPath().getName() for status in system.listStatus(at)) if system.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there whole or not at all: it is written under another name first."""
    at, system = _path(spark, f"{path}.part")
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, f"{path}.part", path)


def read_text(spark: SparkSession, path: str) -> str:
    at, system = _path(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def place(path: str) -> Column:
    """The last three parts of a path, ``date=/hour=/name``: which file of an hourly folder it is. A name alone may be that of files of several hours."""
    return F.substring_index(path, "/", -3)


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """date, hour, path, size of the Parquet files of an hourly folder, from its listing: no file is opened."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "date date, hour int, path string, size bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    place = lambda pattern: F.regexp_extract("path", pattern, 1)
    return files.select(place("date=([0-9-]{10})").cast("date").alias("date"), place("hour=([0-9]{2})").cast("int").alias("hour"), "path", F.col("length").alias("size"))
