"""Service maps kept up to date without rows in the memory of state stores."""

import os

from lumenlake.schema import NANOS, SPANS_DDL
from lumenlake.streaming import jobs

T0 = 1_791_378_000 * NANOS


def span(name, parent, at, service, status="Unset"):
    return ("t", name, parent, "n", "Server", T0 + at * NANOS, T0 + (at + 1) * NANOS, NANOS, status, "", service, "", {}, {}, [])


def test_calls_across_batches_count_once(spark, tmp_path):
    """Callers before and after their calls, in one batch or not; too late or too far apart; no state of joins."""
    batches = [
        [span("1", "", 0, "a"), span("2", "1", 1, "b", "Error"), span("4", "3", 2, "c")],
        [span("3", "1", 60, "b"), span("5", "4", 61, "d"), span("6", "5", 62, "d")],
        [span("7", "", 9000, "a"), span("8", "1", 3700, "b"), span("9", "7", 9001, "e")],
        [span("10", "7", 9002, "e", "Error"), span("11", "3", 63, "e")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, SPANS_DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SPANS_DDL).parquet(f"{tmp_path}/in")
        jobs.land_edges(stream, f"{tmp_path}/edges", f"{tmp_path}/c", {"availableNow": True}).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/edges").groupBy("from_service", "to_service").sum("requests", "errors").collect()
    assert {tuple(r) for r in rows} == {("a", "b", 2, 1), ("b", "c", 1, 0), ("c", "d", 1, 0), ("a", "e", 2, 1)}
    assert not os.path.exists(f"{tmp_path}/c/state") and sorted(os.listdir(f"{tmp_path}/edges-recent")) == ["batch=2", "batch=3"]
