"""Rollups against the points that they are made of."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import metrics, rollups
from lumenlake.schema import NANOS, POINTS_DDL

T0, MIN = 1_791_378_000 * NANOS, 60 * NANOS  # the beginning of an hour


def point(metric, kind, series, t, start=0, value=None, temporality="", monotonic=False, count=None, total=None, bounds=None, buckets=None):
    return (metric, kind, "1", temporality, monotonic, series, "s", "", {"n": str(series % 3)}, {"service.name": "s"}, start, T0 + int(t * NANOS), value, count, total, None, None, bounds, buckets)


@pytest.fixture(scope="module")
def points(spark):
    """Points of all kinds at uneven times, with resets that change the start or do not, gaps, and changes of buckets."""
    dice, rows = random.Random(8), []
    for series in range(6):
        start, value, counts, t = 0, 0.0, [0, 0, 0], 0.0
        for _ in range(160):
            t += dice.choice([1, 7, 20, 33, 300])
            if dice.random() < 0.06:
                start, value, counts = (int(t) if dice.random() < 0.5 else start), 0.0, [0] * dice.choice([3, 3, 4])
            grown, more = dice.randint(0, 5) / 4, [dice.randint(0, 2) for _ in counts]
            value, counts = value + grown, [a + b for a, b in zip(counts, more, strict=True)]
            bounds = [float(2**k) for k in range(len(counts) - 1)]
            rows.append(point("gauge", "Gauge", series, t, value=dice.randint(-9, 9) / 2))
            rows.append(point("counter", "Sum", series, t, start, value, "Cumulative", True))
            rows.append(point("delta", "Sum", series, t, start, grown, "Delta", True))
            rows.append(point("updown", "Sum", series, t, start, value, "Cumulative", False))
            rows.append(point("histogram", "Histogram", series, t, start, None, "Cumulative", False, sum(counts), sum(counts) / 2, bounds, counts))
            rows.append(point("delta histogram", "Histogram", series, t, start, None, "Delta", False, sum(more), sum(more) / 2, bounds, more))
            rows.append(point("exponential", "ExponentialHistogram", series, t, start, None, "Cumulative", False, sum(counts), sum(counts) / 4, [], []))
            rows.append(point("summary", "Summary", series, t, start, None, "", False, sum(counts), sum(counts) / 8, [], []))
    return spark.createDataFrame(rows, POINTS_DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def levels(points):
    minutes = rollups.rollup(points, MIN).cache()
    return {MIN: minutes, 60 * MIN: rollups.merged(minutes, 60 * MIN).cache()}


def values(df):
    return sorted((*(tuple(r)[:-1]), round(r[-1], 6)) for r in df.collect())


RANGES = [(T0, T0 + 4 * 60 * MIN, 60 * MIN), (T0 + 17 * MIN, T0 + 200 * MIN, 30 * MIN), (T0 + 100 * NANOS + 5, T0 + 9000 * NANOS, 777 * NANOS), (T0 + 61 * MIN, T0 + 62 * MIN, 20 * NANOS)]
QUERIES = [("gauge", "avg"), ("gauge", "count"), ("updown", "max"), ("counter", None), ("delta", "max"), ("histogram", "p90"), ("histogram", "avg"), ("delta histogram", "p50"), ("exponential", "count"), ("summary", "avg")]


@pytest.mark.parametrize(("low", "high", "step"), RANGES)
def test_queries_from_rollups_equal_those_from_points(points, levels, low, high, step):
    for metric, agg in QUERIES:
        wanted = values(metrics.query_metric(points, metric, low, high, agg, ["n"], None, step))
        assert values(rollups.query_rollups(points, levels, rollups.series_of(points), metric, low, high, step, agg, ["n"])) == wanted and wanted, (metric, agg)


def test_filters_and_metrics_without_points(points, levels):
    series = rollups.series_of(points)
    low, high, step = RANGES[0]
    assert values(rollups.query_rollups(points, levels, series, "counter", low, high, step, None, [], {"n": "1"})) == values(metrics.query_metric(points, "counter", low, high, None, [], {"n": "1"}, step))
    assert rollups.query_rollups(points, levels, series, "none", low, high, step).count() == 0
    assert rollups.query_rollups(points, levels, series, "counter", low, high, step, None, [], {"n": "9"}).count() == 0


def test_levels_do_not_depend_on_their_steps(points, levels):
    """Hours made of minutes equal hours made of points."""
    shown = lambda df: sorted((tuple(r) for r in df.selectExpr("metric_name", "series_id", "bucket_start", "points", "min", "max", "total", "first", "last", "grown", "count", "sum", "buckets").collect()), key=repr)
    assert shown(levels[60 * MIN]) == shown(rollups.rollup(points, 60 * MIN))


def test_what_is_read_where():
    cover = rollups.covered(T0, T0 + 3 * 60 * MIN, 60 * MIN, [MIN, 60 * MIN])
    assert cover == {60 * MIN: [(T0, T0 + 180 * MIN)], MIN: [(T0 - 15 * MIN, T0)], 0: []}
    cover = rollups.covered(T0 + 30 * MIN + 5, T0 + 150 * MIN, 600 * MIN, [60 * MIN, MIN])
    assert cover[60 * MIN] == [(T0 + 60 * MIN, T0 + 120 * MIN)] and cover[0] == [(T0 + 15 * MIN + 5, T0 + 16 * MIN), (T0 + 30 * MIN, T0 + 31 * MIN)]
    for low, high, step in RANGES:
        every = sorted(r for ranges in rollups.covered(low, high, step, [MIN, 60 * MIN]).values() for r in ranges)
        assert every[0][0] == low - rollups.LOOKBACK and every[-1][1] == high and all(a[1] == b[0] for a, b in zip(every, every[1:], strict=False))


def test_aligned_ranges_read_no_points(spark, levels):
    """Within the lookback and the steps of whole minutes no point is needed."""
    none = spark.createDataFrame([], POINTS_DDL).withColumn("value", F.raise_error(F.lit("points were read")).cast("double"))
    pieces = rollups.pieces_of(none, levels, "counter", T0 + 15 * MIN, T0 + 75 * MIN, 10 * MIN)
    assert pieces.count() > 10 and pieces.select("points").agg(F.max("points")).first()[0] > 1


def test_no_points(spark):
    assert rollups.merged(rollups.rollup(spark.createDataFrame([], POINTS_DDL), MIN), 60 * MIN).count() == 0
