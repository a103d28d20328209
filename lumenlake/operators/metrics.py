"""Series of metrics: gauges, counter rates with resets, histograms with percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import attributes_match, group_key
from ..functions.time import bucket, bucket_start, in_range, nice_step
from ..schema import NANOS

#: How far before a range points serve as the ones before, in ns.
LOOKBACK = 15 * 60 * NANOS
REDUCTIONS = ("sum", "avg", "min", "max", "count")


def metric_catalog(points: DataFrame, from_ns: int | None, to_ns: int | None) -> DataFrame:
    """Per metric: type, unit, series, attribute keys (sorted, ``service.name`` last), whether monotonic."""
    rows = points.filter(in_range("time_unix_nano", from_ns, to_ns))
    about = rows.groupBy("metric_name").agg(
        F.min("type").alias("type"), F.min("unit").alias("unit"), F.count_distinct("series_id").alias("series"), F.bool_or("is_monotonic").alias("monotonic")
    )
    names = rows.select("metric_name", F.explode(F.map_keys("attributes")).alias("key")).groupBy("metric_name").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    keys = F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.array(F.lit("service.name")))
    return about.join(names, "metric_name", "left").select("metric_name", "type", "unit", "series", keys.alias("keys"), "monotonic").orderBy("metric_name")


def selected(points: DataFrame, metric: str, from_ns: int, to_ns: int, group_by: Sequence[str] = (), filters: dict[str, str] | None = None) -> DataFrame:
    """Points of a metric from the lookback on, with the grouping keys as columns ``g0``, ``g1``, ... and no maps."""
    rows = points.filter(F.col("metric_name") == metric).filter(in_range("time_unix_nano", from_ns - LOOKBACK, to_ns)).filter(attributes_match(filters or {}))
    keys = [group_key(k, logs=False).alias(f"g{n}") for n, k in enumerate(group_by)]
    return rows.select("series_id", "start_time_unix_nano", "time_unix_nano", "value", "count", "sum", "explicit_bounds", "bucket_counts", "type", "temporality", *keys)


def previous_points(rows: DataFrame, *fields: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``rows`` with ``before``: start and ``fields`` of the point before in the series, which ``keys`` tell apart. Points of one time go by value."""
    by_time = Window.partitionBy(*keys).orderBy("time_unix_nano", "start_time_unix_nano", *fields)
    return rows.withColumn("before", F.lag(F.struct("start_time_unix_nano", *fields)).over(by_time))


def counter_increments(rows: DataFrame, delta: bool = False, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``rows`` with ``increment``: null at a cumulative series' first point, the full value after a reset."""
    rows = previous_points(rows, "value", keys=keys)
    reset = (F.col("start_time_unix_nano") != F.col("before.start_time_unix_nano")) | (F.col("value") < F.col("before.value"))
    grown = F.when(F.col("before").isNull(), None).when(reset, F.col("value")).otherwise(F.col("value") - F.col("before.value"))
    return rows.withColumn("reset", F.coalesce(reset, F.lit(False))).withColumn("increment", F.col("value") if delta else grown)


def reduce_series(rows: DataFrame, groups: Sequence[str], agg: str) -> DataFrame:
    """``value`` of each group's series reduced to one; an unknown reduction gives no rows."""
    if agg not in REDUCTIONS:
        return rows.groupBy(*groups).agg(F.sum("value").alias("value")).filter(F.lit(False))
    value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(agg)
    return rows.groupBy(*groups).agg((value("value") if value else F.count("value").cast("double")).alias("value"))


def _groups(group_by: Sequence[str]) -> list[str]:
    return [f"g{n}" for n in range(len(group_by))]


def _named(rows: DataFrame, group_by: Sequence[str], from_ns: int, step_ns: int) -> DataFrame:
    keys = [F.col(f"g{n}").alias(k) for n, k in enumerate(group_by)]
    return rows.select(*keys, bucket_start("n", from_ns, step_ns).alias("bucket_start"), "value").orderBy(*(F.col(f"`{k}`") for k in group_by), "bucket_start")


def gauge_series(points: DataFrame, metric: str, from_ns: int, to_ns: int, step_ns: int, agg: str = "avg", group_by: Sequence[str] = (), filters: dict[str, str] | None = None) -> DataFrame:
    """The last value of each series in each step, reduced over series."""
    rows = selected(points, metric, from_ns, to_ns, group_by, filters).filter(in_range("time_unix_nano", from_ns, to_ns))
    return gauge_last(rows.withColumn("n", bucket("time_unix_nano", from_ns, step_ns)), from_ns, step_ns, agg, group_by)


def gauge_last(rows: DataFrame, from_ns: int, step_ns: int, agg: str = "avg", group_by: Sequence[str] = ()) -> DataFrame:
    """``gauge_series`` from ``rows`` (series_id, n: the number of the step, time_unix_nano, value, ``g0``, ...)."""
    last = rows.groupBy("series_id", "n", *_groups(group_by)).agg(F.max_by("value", F.struct("time_unix_nano", "value")).alias("value"))
    return _named(reduce_series(last, [*_groups(group_by), "n"], agg), group_by, from_ns, step_ns)


def counter_rate(
    points: DataFrame, metric: str, from_ns: int, to_ns: int, step_ns: int, agg: str = "sum", group_by: Sequence[str] = (), filters: dict[str, str] | None = None, delta: bool = False
) -> DataFrame:
    """Increase per second of each series in each step, reduced over series. The window sees points before the range; only later ones count."""
    return rate_series(counter_increments(selected(points, metric, from_ns, to_ns, group_by, filters), delta), from_ns, to_ns, step_ns, agg, group_by)


def rate_series(increments: DataFrame, from_ns: int, to_ns: int, step_ns: int, agg: str = "sum", group_by: Sequence[str] = ()) -> DataFrame:
    """Rates from ``increments`` (series_id, time_unix_nano, increment, and ``g0``, ``g1``, ... for the grouping keys), of points or of a stream."""
    rows = increments.filter(in_range("time_unix_nano", from_ns, to_ns)).filter("increment is not null").withColumn("n", bucket("time_unix_nano", from_ns, step_ns))
    summed = rows.groupBy("series_id", "n", *_groups(group_by)).agg((F.sum("increment") / F.lit(step_ns / NANOS)).alias("value"))
    return _named(reduce_series(summed, [*_groups(group_by), "n"], agg), group_by, from_ns, step_ns)


def distribution_increments(rows: DataFrame, differenced: bool = True, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``rows`` with count, sum and bucket_counts since the point before; a cumulative series' first point goes."""
    if not differenced:
        return rows
    rows = previous_points(rows, "count", "sum", "bucket_counts", keys=keys).filter("before is not null")
    going_on = (F.col("start_time_unix_nano") == F.col("before.start_time_unix_nano")) & (F.col("count") >= F.col("before.count"))
    same = going_on & (F.size("before.bucket_counts") == F.size("bucket_counts"))
    less = lambda c: F.when(going_on, F.col(c) - F.col(f"before.{c}")).otherwise(F.col(c))
    buckets = F.when(same, F.zip_with("bucket_counts", "before.bucket_counts", lambda a, b: a - b)).otherwise(F.col("bucket_counts"))
    return rows.select("*", less("count").alias("_c"), less("sum").alias("_s"), buckets.alias("_b")).drop("count", "sum", "bucket_counts", "before").withColumnsRenamed(
        {"_c": "count", "_s": "sum", "_b": "bucket_counts"}
    )


def bucket_quantile(rows: DataFrame, groups: Sequence[str], q: float | Column, bounds: str = "bounds", counts: str = "counts") -> DataFrame:
    """``rows`` (a merged histogram each) with ``value``: the q-quantile, interpolated in the bucket that holds its rank.

    Rows without counts, without bounds, or with lengths that do not fit are left out.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    fits = (F.size(bounds) > 0) & (F.size(counts) == F.size(bounds) + 1) & (total > 0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("below"), F.lit(None).cast("double").alias("value"))
    rank = q * total

    def step(state: Column, c: Column) -> Column:
        lower = F.when(state["at"] == 0, F.lit(0.0)).otherwise(F.get(F.col(bounds), state["at"] - 1))
        upper = F.get(F.col(bounds), state["at"])
        inside = F.when(upper.isNull(), F.element_at(bounds, -1)).when((state["at"] == 0) & (upper <= 0), upper).otherwise(lower + (upper - lower) * ((rank - state["below"]) / c))
        here = state["value"].isNull() & (c > 0) & (state["below"] + c >= rank)
        return F.struct((state["at"] + 1).alias("at"), (state["below"] + c).alias("below"), F.when(here, inside).otherwise(state["value"]).alias("value"))

    return rows.filter(fits).select(*groups, F.aggregate(counts, start, step, lambda state: state["value"]).alias("value"))


def histogram_series(
    points: DataFrame, metric: str, from_ns: int, to_ns: int, step_ns: int, agg: str = "avg", group_by: Sequence[str] = (), filters: dict[str, str] | None = None, differenced: bool = True
) -> DataFrame:
    """``count`` (a second), ``avg``, or a percentile ``p<q>`` of the observations of each step.

    Buckets are summed by position. Of a step's points only those with its smallest bounds array count toward percentiles.
    """
    rows = distribution_increments(selected(points, metric, from_ns, to_ns, group_by, filters), differenced)
    return distribution_series(rows, from_ns, to_ns, step_ns, agg, group_by)


def distribution_series(increments: DataFrame, from_ns: int, to_ns: int, step_ns: int, agg: str = "avg", group_by: Sequence[str] = ()) -> DataFrame:
    """``histogram_series`` from ``increments`` (time_unix_nano, count, sum, explicit_bounds, bucket_counts, ``g0``, ...), of points or of a stream."""
    groups = [*_groups(group_by), "n"]
    rows = increments.filter(in_range("time_unix_nano", from_ns, to_ns)).withColumn("n", bucket("time_unix_nano", from_ns, step_ns))
    if agg in ("count", "avg"):
        value = F.sum("count") / F.lit(step_ns / NANOS) if agg == "count" else F.when(F.sum("count") != 0, F.sum("sum") / F.sum("count"))
        return _named(rows.groupBy(*groups).agg(value.alias("value")).filter("value is not null"), group_by, from_ns, step_ns)
    try:
        q = float(agg.removeprefix("p")) / 100 if agg.startswith("p") else 0.0
    except ValueError:
        q = 0.0
    if not 0 < q < 1:
        return _named(rows.select(*groups, F.lit(0.0).alias("value")).filter(F.lit(False)), group_by, from_ns, step_ns)
    return _named(bucket_quantile(merged_buckets(rows, groups), groups, q), group_by, from_ns, step_ns)


def merged_buckets(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each group's buckets summed by position: ``bounds`` (the smallest array of the group) and ``counts``."""
    slots = rows.filter(F.size("explicit_bounds") > 0).select(*groups, F.col("explicit_bounds").alias("bounds"), F.posexplode("bucket_counts").alias("slot", "c"))
    summed = slots.groupBy(*groups, "bounds", "slot").agg(F.sum("c").cast("double").alias("c"))
    by_bounds = summed.groupBy(*groups, "bounds").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "c"))), lambda x: x["c"]).alias("counts"))
    return by_bounds.groupBy(*groups).agg(F.min("bounds").alias("bounds"), F.min_by("counts", "bounds").alias("counts"))


def query_metric(
    points: DataFrame, metric: str, from_ns: int, to_ns: int, agg: str | None = None, group_by: Sequence[str] = (), filters: dict[str, str] | None = None, step_ns: int | None = None
) -> DataFrame:
    """The series of a metric of any kind, by the kind's own rules; a metric without points gives no rows."""
    step_ns = step_ns or nice_step(to_ns - from_ns, 120)
    near = points.filter(F.col("metric_name") == metric).filter(in_range("time_unix_nano", from_ns - LOOKBACK, to_ns))
    kind = near.agg(F.max("type").alias("type"), F.max("temporality").alias("temporality"), F.bool_or("is_monotonic").alias("monotonic")).first()
    more = {"group_by": group_by, "filters": filters}
    if kind["type"] in ("Histogram", "ExponentialHistogram", "Summary"):
        differenced = kind["type"] != "Summary" and kind["temporality"] != "Delta"
        return histogram_series(points, metric, from_ns, to_ns, step_ns, agg or "avg", differenced=differenced, **more)
    if kind["type"] == "Sum" and kind["monotonic"]:
        return counter_rate(points, metric, from_ns, to_ns, step_ns, agg or "sum", delta=kind["temporality"] == "Delta", **more)
    return gauge_series(points, metric, from_ns, to_ns, step_ns, agg or "avg", **more)


def series_dictionary(points: DataFrame) -> DataFrame:
    """Each series once with what identifies it: an order-independent hash over metric, type and both maps."""
    entries = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    rows = points.select("metric_name", "type", entries("attributes").alias("attributes"), entries("resource_attributes").alias("resource_attributes"), "time_unix_nano")
    rows = rows.withColumn("series", F.xxhash64("metric_name", "type", "attributes", "resource_attributes"))
    return rows.groupBy("metric_name", "type", "attributes", "resource_attributes", "series").agg(F.count(F.lit(1)).alias("points"), F.min("time_unix_nano").alias("first"))


def cardinality_guard(points: DataFrame, limit: int) -> DataFrame:
    """``points`` with ``series``: its id as text, or ``__overflow__`` for series beyond the first ``limit`` of their metric.

    Series are ranked by first point. Counts by hour tell which hours lie within the limit, so that only the series
    of those are ranked, an hour at a time.
    """
    first = points.groupBy("metric_name", "series_id").agg(F.min("time_unix_nano").alias("first")).withColumn("hour", F.expr(f"first div {3600 * NANOS}L"))
    hours = first.groupBy("metric_name", "hour").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("metric_name").orderBy("hour")
    hours = hours.withColumn("before", F.sum("n").over(up_to) - F.col("n")).filter(F.col("before") < limit).drop("n")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("metric_name", "hour").orderBy("first", "series_id"))
    kept = first.join(hours, ["metric_name", "hour"]).withColumn("rank", rank).filter(F.col("rank") <= limit).select("metric_name", "series_id")
    return overflowing(points, kept)


def overflowing(points: DataFrame, kept: DataFrame) -> DataFrame:
    """``points`` with ``series``: its id as text where ``kept`` (metric_name, series_id) has it, else ``__overflow__``."""
    marked = points.join(kept.withColumn("kept", F.lit(True)), ["metric_name", "series_id"], "left")
    return marked.withColumn("series", F.when(F.col("kept"), F.col("series_id").cast("string")).otherwise("__overflow__")).drop("kept")
