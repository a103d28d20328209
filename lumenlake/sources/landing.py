"""Rows that have not been stored yet, and the ledger of those that have: every row is seen exactly once.

A batch of rows lands whole in ``<root>/landing/<signal>/batch=<id>``. Now and then landed batches are promoted: written to their hours in files of
some size, and entered in the ledger. Readers take what is stored and the batches that are not in the ledger. A batch that
comes again, as a source repeats it after a failure, is known by its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.time import in_range
from ..schema import SCHEMAS, TIME
from . import folders, swaps
from .scan import scan, with_landing
from .storage import hour_folder, hourly_files, write_staged


def landing_path(root: str, signal: str) -> str:
    return f"{root}/landing/{signal}"


def ledger(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """batch: the ids of all batches that are stored."""
    made = spark.createDataFrame([(b,) for b in sorted(swaps.unseen(spark, root, signal)[1])], "batch string")
    path = swaps.ledger_path(root, signal)
    return spark.read.schema("batch string").json(path).union(made).distinct() if folders.names(spark, path) else made


def _stored(spark: SparkSession, root: str, signal: str, batch: str) -> bool:
    return not ledger(spark, root, signal).filter(F.col("batch") == batch).isEmpty()


def land(df: DataFrame, signal: str, root: str, batch: str | int) -> bool:
    """Land the rows of a batch; whether it is new. One that has landed or is stored already changes nothing."""
    spark, path = df.sparkSession, f"{landing_path(root, signal)}/batch={batch}"
    if folders.exists(spark, path) or _stored(spark, root, signal, str(batch)):
        return False
    staging = f"{root}/staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    folders.rename(spark, staging, path)
    return True


def land_stream(rows: DataFrame, signal: str, root: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Land each micro-batch of a stream under its number; one that is repeated lands once."""
    return rows.writeStream.foreachBatch(lambda df, number: land(df, signal, root, number)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _landed(spark: SparkSession, root: str, signal: str) -> list[str]:
    return [n.removeprefix("batch=") for n in folders.names(spark, landing_path(root, signal)) if n.startswith("batch=")]


def promote(spark: SparkSession, root: str, signal: str) -> list[str]:
    """Store all landed batches and enter them in the ledger; their ids. A promotion that was stopped is finished, or else done anew."""
    swaps.finish(spark, root, signal)
    done = {r["batch"] for r in ledger(spark, root, signal).join(spark.createDataFrame([(b,) for b in _landed(spark, root, signal)], "batch string"), "batch").collect()}  # of the landed ones
    for batch in done:  # stored, but not yet cleared away
        folders.delete(spark, f"{landing_path(root, signal)}/batch={batch}")
    batches = [b for b in _landed(spark, root, signal) if b not in done]
    if batches:
        rows = spark.read.schema(SCHEMAS[signal]).parquet(*(f"{landing_path(root, signal)}/batch={b}" for b in batches))
        staging = f"{root}/staging-{uuid.uuid4().hex}"
        write_staged(rows, signal, staging)
        come = {file["path"]: hour_folder(root, signal, file) for file in hourly_files(spark, staging)}
        swaps.begin(spark, root, signal, staging, come, [], batches)
        swaps.finish(spark, root, signal)
        for batch in batches:
            folders.delete(spark, f"{landing_path(root, signal)}/batch={batch}")
    return batches


def landed(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """The rows of all batches that are not stored yet, by an anti join on the ledger."""
    path, batches = landing_path(root, signal), _landed(spark, root, signal)
    if not batches:
        return spark.createDataFrame([], SCHEMAS[signal])
    rows = spark.read.schema(f"{SCHEMAS[signal]}, batch string").option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))
    return rows.join(ledger(spark, root, signal), "batch", "left_anti").drop("batch")


def current(spark: SparkSession, root: str, signal: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """All rows of ``[from_ns, to_ns)``, stored or not, each once."""
    stored = scan(spark, root, signal, from_ns, to_ns)
    return with_landing(stored, landed(spark, root, signal).filter(in_range(TIME[signal], from_ns, to_ns)))


__all__ = ["current", "land", "land_stream", "landed", "ledger", "promote"]
