"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put in doc_id order by a range shuffle of (id, size, checksum) only; texts never move. Each
range partition gives one total, the totals are summed into the bytes before each partition, and a row's
shard follows from the bytes before it. The totals are as many as partitions, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, texts

#: Bytes that each row is taken to need besides its text.
ROW_BYTES = 16


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``before`` (sum of ``size`` over all earlier rows) and ``position`` (their count).

    The range shuffle is checkpointed: partition numbers must not change if an executor is lost.
    """
    placed = checkpoint(
        rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 8, *order)
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(*order)
    )
    totals = placed.groupBy("part").agg(F.sum(size).alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition only
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("part_position"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("position", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
        .join(F.broadcast(starts), "part")  # bounded: one row per range partition
        .withColumn("before", F.col("before") + F.col("part_before"))
        .withColumn("position", F.col("position") + F.col("part_position"))
        .drop("part", "part_before", "part_position")
    )


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document with its shard and its gapless place there.

    doc_id, size (UTF-8 bytes + 16; null text: 16), text_crc32, shard, slot. Shards are runs in doc_id
    order (null ids first, repeated rows by checksum and size); a row belongs to the shard in which its
    middle byte falls, so that a shard misses the mean by less than one row's size at either end. A row
    larger than a shard fills the shards it spans alone. An empty table gives no rows; shards may be empty.
    """
    rows = texts(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = checkpoint(prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size"))
    whole = placed.agg(F.sum("size").alias("whole"))  # one row
    sharded = placed.crossJoin(F.broadcast(whole)).withColumn(
        "shard", F.least(F.expr("int((2 * cast(before as decimal(30,0)) + size) * %d div (2 * whole))" % shards), F.lit(shards - 1))
    )
    firsts = sharded.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
