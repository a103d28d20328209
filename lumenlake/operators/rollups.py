"""Rollups of metrics that can be merged, and queries that read them in place of points.

A piece stands for the points of one series in a stretch of time: how many, least, greatest, sum, the first and the last point whole, and what
was added within, after the first point: by a counter, or count, sum and buckets of a histogram. Two neighbouring pieces make one; between the last
point of one and the first of the next a cumulative series adds their difference, or all of it after a reset. A point is
a piece, so that minutes come from points, hours from minutes, and the steps of a query from both, with points at the edges alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import attributes_match, group_key
from ..functions.time import bucket, in_range
from ..schema import NANOS
from .metrics import LOOKBACK, distribution_series, gauge_last, rate_series

MINUTE, HOUR = 60 * NANOS, 3600 * NANOS
_POINT = ["time_unix_nano", "start_time_unix_nano", "value", "count", "sum", "explicit_bounds", "bucket_counts"]
_SERIES = ["metric_name", "type", "temporality", "is_monotonic", "series_id"]
_BUCKETS = "array<struct<bounds:array<double>,counts:array<double>>>"
#: Series that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000


def differenced() -> Column:
    """Whether a series is cumulative, so that a point tells of all since its start."""
    counter = (F.col("type") == "Sum") & F.col("is_monotonic")
    return (counter | F.col("type").isin("Histogram", "ExponentialHistogram")) & (F.col("temporality") != "Delta")


def as_pieces(points: DataFrame) -> DataFrame:
    """Each point as a piece. What it adds is known at once but for cumulative series."""
    point, whole = F.struct(*_POINT), ~differenced()
    own = F.array(F.struct(F.col("explicit_bounds").alias("bounds"), F.col("bucket_counts").cast("array<double>").alias("counts"))).cast(_BUCKETS)
    return points.select(
        *_SERIES, F.col("time_unix_nano").alias("bucket_start"), F.lit(1).cast("long").alias("points"), F.col("value").alias("min"), F.col("value").alias("max"), F.col("value").alias("total"),
        point.alias("first"), point.alias("last"), F.when(whole, F.col("value")).alias("grown"), F.when(whole, F.col("count")).alias("count"), F.when(whole, F.col("sum")).alias("sum"),
        F.when(whole & (F.size("explicit_bounds") > 0), own).otherwise(F.array().cast(_BUCKETS)).alias("buckets"),
    )


def _sum(*columns: Column) -> Column:
    """The sum of what is not null, null if all is."""
    return F.when(F.coalesce(*columns).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns)))


def joined(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pieces`` with what was added since the piece before in the series (within equal ``keys``) put to what they added themselves."""
    in_order = Window.partitionBy("metric_name", "series_id", *keys).orderBy("first")
    now, before = F.col("first"), F.col("before")
    rows = pieces.withColumn("before", F.when(differenced(), F.lag("last").over(in_order)))
    same_start = now["start_time_unix_nano"] == before["start_time_unix_nano"]
    grown = F.when(same_start & (now["value"] >= before["value"]), now["value"] - before["value"]).otherwise(now["value"])
    going_on = same_start & (now["count"] >= before["count"])
    less = lambda c: F.when(going_on, now[c] - before[c]).otherwise(now[c])
    counts = F.when(going_on & (F.size(now["bucket_counts"]) == F.size(before["bucket_counts"])), F.zip_with(now["bucket_counts"], before["bucket_counts"], lambda a, b: a - b)).otherwise(now["bucket_counts"])
    between = F.array(F.struct(now["explicit_bounds"].alias("bounds"), counts.cast("array<double>").alias("counts"))).cast(_BUCKETS)
    known = F.col("before").isNotNull()
    add = lambda name, what: _sum(F.col(name), F.when(known, what)).alias(name)
    buckets = F.when(known & (F.size(now["explicit_bounds"]) > 0), F.concat("buckets", between)).otherwise(F.col("buckets"))
    rest = [c for c in pieces.columns if c not in ("grown", "count", "sum", "buckets")]
    return rows.select(*rest, add("grown", grown), add("count", less("count")), add("sum", less("sum")), buckets.alias("buckets"))


def merged(pieces: DataFrame, step_ns: int) -> DataFrame:
    """Pieces of ``step_ns``, aligned to the epoch, of finer ones: a row per series and step that has points."""
    keys = ["metric_name", "series_id", "bucket_start"]
    rows = joined(pieces.withColumn("bucket_start", F.expr(f"bucket_start - pmod(bucket_start, {step_ns}L)")), ["bucket_start"])
    whole = rows.groupBy(*keys).agg(
        F.first("type").alias("type"), F.first("temporality").alias("temporality"), F.first("is_monotonic").alias("is_monotonic"), F.sum("points").alias("points"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("grown").alias("grown"), F.sum("count").alias("count"), F.sum("sum").alias("sum"),
    )
    slots = rows.select(*keys, F.explode("buckets").alias("b")).select(*keys, "b.bounds", F.posexplode("b.counts").alias("slot", "c"))
    by_bounds = slots.groupBy(*keys, "bounds", "slot").agg(F.sum("c").alias("c")).groupBy(*keys, "bounds")
    counted = by_bounds.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "c"))), lambda x: x["c"]).alias("counts"))  # as many as buckets
    listed = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bounds", "counts"))).alias("buckets"))  # as many as a series has bounds
    empty = F.array().cast(_BUCKETS)
    names = [*_SERIES, "bucket_start", "points", "min", "max", "total", "first", "last", "grown", "count", "sum"]
    return whole.join(listed, keys, "left").select(*names, F.coalesce("buckets", empty).alias("buckets"))


def rollup(points: DataFrame, step_ns: int) -> DataFrame:
    """Pieces of ``step_ns`` of points of all kinds: a row per series and step. ``merged`` makes coarser levels of finer ones."""
    return merged(as_pieces(points), step_ns)


def covered(from_ns: int, to_ns: int, step_ns: int, levels: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """Which times to read at which level (0: points) so that each is read once and no piece lies across two steps: the coarsest that fit, the rest finer.

    The lookback before the range counts as a step.
    """
    out: dict[int, list[tuple[int, int]]] = {level: [] for level in (*levels, 0)}

    def fill(low: int, high: int, left: Sequence[int]) -> None:
        if low >= high:
            return
        if not left:
            taken, ranges = 0, out[0]
            a, b = low, high
        else:
            taken, ranges = left[0], out[left[0]]
            a, b = -(-low // taken) * taken, high // taken * taken
            if a >= b:
                return fill(low, high, left[1:])
            fill(low, a, left[1:])
        if ranges and ranges[-1][1] == a:
            ranges[-1] = ranges[-1][0], b
        else:
            ranges.append((a, b))
        if left:
            fill(b, high, left[1:])

    coarse_first = sorted(levels, reverse=True)
    fill(from_ns - LOOKBACK, from_ns, coarse_first)
    for low in range(from_ns, to_ns, step_ns):
        fill(low, min(low + step_ns, to_ns), coarse_first)
    return out


def _within(time: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, (in_range(time, low, high) for low, high in ranges), F.lit(False))


def pieces_of(points: DataFrame, levels: dict[int, DataFrame], metric: str, from_ns: int, to_ns: int, step_ns: int) -> DataFrame:
    """The pieces of a metric from the lookback on: from ``levels`` (rollups by their step) as far as they fit the steps of the query, else from points."""
    ranges = covered(from_ns, to_ns, step_ns, [*levels])
    of = lambda df: df.filter(F.col("metric_name") == metric)
    parts = [of(df).filter(_within("bucket_start", ranges[level])) for level, df in levels.items() if ranges[level]]
    if ranges[0] or not parts:
        parts.append(as_pieces(of(points).filter(_within("time_unix_nano", ranges[0]))))
    return reduce(DataFrame.unionByName, parts)


def series_of(points: DataFrame) -> DataFrame:
    """metric_name, series_id, attributes, resource_attributes: what rollups leave out, once per series."""
    return points.groupBy("metric_name", "series_id").agg(F.any_value("attributes").alias("attributes"), F.any_value("resource_attributes").alias("resource_attributes"))


def query_rollups(
    points: DataFrame, levels: dict[int, DataFrame], series: DataFrame, metric: str, from_ns: int, to_ns: int, step_ns: int, agg: str | None = None, group_by: Sequence[str] = (), filters: dict[str, str] | None = None
) -> DataFrame:
    """What ``metrics.query_metric`` finds, from ``levels`` of rollups: filters and grouping keys are looked up in ``series`` first, and
    points are read only where steps and range do not fit the finest level.
    """
    keys = [group_key(k, logs=False).alias(f"g{n}") for n, k in enumerate(group_by)]
    chosen = series.filter(F.col("metric_name") == metric).filter(attributes_match(filters or {})).select("series_id", *keys)
    few = chosen.limit(BROADCAST + 1).count() <= BROADCAST
    pieces = pieces_of(points, levels, metric, from_ns, to_ns, step_ns).join(F.broadcast(chosen) if few else chosen, "series_id")
    kind = pieces.agg(F.max("type").alias("type"), F.bool_or("is_monotonic").alias("monotonic")).first()
    if kind["type"] == "Gauge" or (kind["type"] == "Sum" and not kind["monotonic"]):
        rows = pieces.filter(F.col("bucket_start") >= from_ns).withColumn("n", bucket("bucket_start", from_ns, step_ns))
        last = rows.select("series_id", "n", *(f"g{k}" for k in range(len(keys))), F.col("last.time_unix_nano").alias("time_unix_nano"), F.col("last.value").alias("value"))
        return gauge_last(last, from_ns, step_ns, agg or "avg", group_by)
    rows = joined(pieces, []).withColumn("time_unix_nano", F.col("bucket_start"))
    if kind["type"] == "Sum":
        return rate_series(rows.withColumn("increment", F.col("grown")), from_ns, to_ns, step_ns, agg or "sum", group_by)
    names = ["time_unix_nano", *(f"g{k}" for k in range(len(keys)))]
    sums = rows.select(*names, "count", "sum", F.lit(None).cast("array<double>").alias("explicit_bounds"), F.lit(None).cast("array<double>").alias("bucket_counts"))
    shown = rows.select(*names, F.explode("buckets").alias("b")).select(*names, F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("sum"), F.col("b.bounds").alias("explicit_bounds"), F.col("b.counts").alias("bucket_counts"))
    return distribution_series(sums.unionByName(shown), from_ns, to_ns, step_ns, agg or "avg", group_by)
