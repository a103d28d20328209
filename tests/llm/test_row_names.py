"""Rows that are chosen in one job and dropped in another stay the same when files are split otherwise in between."""

import uuid

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import common, exact_dedup, simhash

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.keep_one_of_each])
def test_other_splits_drop_the_same_rows(spark, tmp_path, drop):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat(F.col("id") % 200, F.lit(k)).cast("string"), 256) for k in range(9))).alias("text"))
    rows.repartition(7, "doc_id").write.parquet(path)
    before = spark.conf.get(SPLIT)
    try:
        spark.conf.set(SPLIT, str(1 << 30))
        out = drop(spark.read.parquet(path))
        spark.conf.set(SPLIT, "3000")
        assert sorted(r["doc_id"] for r in out.collect()) == [*range(200)]
    finally:
        spark.conf.set(SPLIT, before)


def test_a_computed_table_is_stored_first(spark):
    df, place = common.stored(spark.range(5).select(F.rand().alias("x")))
    first, second = (sorted(map(tuple, df.select("x", place.alias("row")).collect())) for _ in range(2))
    assert first == second and len({row for _, row in first}) == 5
