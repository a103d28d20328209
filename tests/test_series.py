"""Points by ids of their series give what whole points give."""

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import metrics
from lumenlake.schema import HOUR, NANOS, POINTS_DDL
from lumenlake.sources import series

T0, MIN = 1_791_378_000 * NANOS, 60 * NANOS


def point(metric, k, minute, **more):
    row = dict(
        metric_name=metric, type="Sum", unit="1", temporality="Cumulative", is_monotonic=True, series_id=k, service_name=f"s{k % 3}", scope_name="", attributes={"k": str(k), "host": f"h{k % 4}"},
        resource_attributes={"service.name": f"s{k % 3}"}, start_time_unix_nano=T0, time_unix_nano=T0 + minute * MIN, value=float(minute * (k + 1)), count=None, sum=None, min=None, max=None,
        explicit_bounds=None, bucket_counts=None,
    ) | more
    return tuple(row[c.split(" ", 1)[0]] for c in POINTS_DDL.split(", "))


ROWS = [point(m, k, minute) for m in ("req", "other") for k in range(12) for minute in range(0, 180, 20)]
ODD = [
    point("req", 3, 7, attributes=None), point("req", 3, 8, attributes={}), point("req", 3, 9, attributes={"k": None}), point(None, 1, 9),
    point("req", 3, 10, unit=None, temporality="1"), point("req", 3, 11, unit="1", temporality=None), point("req", 3, 12, series_id=None), point("req", 3, 12, value=None),
]


def plain(df):
    maps = [c for c, kind in df.dtypes if kind.startswith("map")]
    return sorted(df.select(*(F.to_json(F.array_sort(F.map_entries(c))).alias(c) if c in maps else F.col(c) for c in df.columns)).collect(), key=str)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("series"))
    for n in (0, 1, 2):
        series.write_points(spark.createDataFrame(ROWS[n::3] + (ODD if n == 1 else []), POINTS_DDL), root)
    return root


def test_whole_points_come_back(spark, stored):
    points = spark.createDataFrame(ROWS + ODD, POINTS_DDL)
    assert plain(series.read_points(spark, stored)) == plain(points)
    late = series.read_points(spark, stored, ["req"], T0 + HOUR, T0 + 2 * HOUR)
    assert plain(late) == plain(points.filter(f"metric_name = 'req' and time_unix_nano >= {T0 + HOUR} and time_unix_nano < {T0 + 2 * HOUR}"))


def test_a_series_is_there_once(spark, stored):
    known = series.dictionary(spark, stored)
    assert known.count() == known.select("metric_name", "series").distinct().count() == 24 + 7
    again = spark.createDataFrame(ROWS + ODD, POINTS_DDL).withColumn("attributes", F.map_from_entries(F.reverse(F.map_entries("attributes"))))
    assert series.new_series(again, known).isEmpty()
    assert series.new_series(spark.createDataFrame([point("req", 12, 0)], POINTS_DDL), known).count() == 1


@pytest.mark.parametrize("filters", [{}, {"host": "h1"}, {"service.name": "s2", "k": "5"}, {"k": "no such"}])
@pytest.mark.parametrize("broadcast", [20_000, 11, 0])
def test_rates(spark, stored, filters, broadcast, monkeypatch):
    monkeypatch.setattr(series, "BROADCAST", broadcast)
    ask = lambda points, filters: metrics.query_metric(points, "req", T0, T0 + 3 * HOUR, None, ["host"], filters, HOUR)
    rows = ROWS + ODD
    got = ask(series.read_points(spark, stored, ["req"], T0 - metrics.LOOKBACK, T0 + 3 * HOUR, filters), None)
    assert plain(got) == plain(ask(spark.createDataFrame(rows, POINTS_DDL), filters))


def test_the_scan_reads_no_maps_and_knows_the_ids(spark, stored, capsys):
    series.read_points(spark, stored, ["req"], filters={"k": "5"}).groupBy("attributes.host").agg(F.sum("value")).explain("formatted")
    plan = capsys.readouterr().out
    scan = next(part for part in plan.split("\n\n") if "v1/points" in part)
    assert "map<" not in scan and "In(series" in scan.replace("EqualTo(series", "In(series") and "BroadcastHashJoin" in plan


def test_nothing_stored(spark, tmp_path):
    assert series.read_points(spark, str(tmp_path), ["req"]).isEmpty()
    series.write_points(spark.createDataFrame([], POINTS_DDL), str(tmp_path))
    assert series.read_points(spark, str(tmp_path)).isEmpty() and series.dictionary(spark, str(tmp_path)).isEmpty()
