"""Figures of services from counts kept by hour, against those of all spans."""

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import services
from lumenlake.schema import HOUR, NANOS

T0 = 1_791_378_000 * NANOS


@pytest.fixture(scope="module")
def spans(spark):
    """Two services of many different durations over seven hours, one of a few."""
    rows = spark.range(30_000, numPartitions=4)
    start = (F.lit(T0) + F.pmod(F.xxhash64("id"), F.lit(7 * HOUR))).alias("start_time_unix_nano")
    long = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5_000_000_000)) + 1000
    service = F.when(F.col("id") % 100 == 0, "few").otherwise(F.concat(F.lit("s"), F.col("id") % 2))
    return rows.select(
        start, service.alias("service_name"), F.concat(F.lit("op"), F.col("id") % 3).alias("name"), F.when(F.col("id") % 5 == 0, "Client").otherwise("Server").alias("kind"), F.lit("x").alias("parent_span_id"),
        F.when(F.col("id") % 7 == 0, "Error").otherwise("Ok").alias("status_code"), F.when(F.col("id") % 100 == 0, 7).otherwise(long).alias("duration_nano"),
    ).cache()


@pytest.mark.parametrize(("low", "high"), [(0, 7 * HOUR), (HOUR, 3 * HOUR), (HOUR // 3, 5 * HOUR + 17), (HOUR // 3, HOUR // 2), (HOUR + 5, 2 * HOUR - 5), (HOUR // 2, 2 * HOUR), (9 * HOUR, 10 * HOUR)])
def test_figures_equal_those_of_spans(spans, low, high):
    low, high = T0 + low, T0 + high
    hours = services.latency_hours(spans)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(services.services_from_hours(hours, spans, low, high)) == rows(services.services(spans, low, high))
    assert rows(services.operations_from_hours(hours, spans, "s1", low, high)) == rows(services.service_operations(spans, "s1", low, high))


def test_few_spans_are_read_again(spans):
    """The spans in the steps of the ranks are under one in a hundred."""
    shares = (0.5, 0.95, 0.99)
    asked = services.asked_steps(services.latency_hours(spans), spans, T0, T0 + 7 * HOUR, ["service_name"], shares).filter("service_name <> 'few'")
    rows = services.entries(spans, T0, T0 + 7 * HOUR).withColumn("v", F.col("duration_nano")).withColumn("step", services._step())
    read = rows.join(asked, ["service_name", "step"], "left_semi").count()
    assert asked.count() <= 2 * 2 * len(shares) and 0 < read < rows.count() / 100
