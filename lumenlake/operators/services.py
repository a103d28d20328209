"""Requests, errors and latency of services, and what changed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_entry, span_is_error
from ..functions.time import bucket, bucket_start, in_range, nice_step
from ..schema import HOUR, NANOS
from .iteration import cut

#: Error shares and latency ratios from which a service is in a warning or critical state, and the p95 (ms) below which latency never counts.
ERRORS, RATIOS, SLOW_MS = (0.01, 0.05), (1.5, 2.0), 200.0
#: Steps of durations that are broadcast; more are joined by a shuffle.
STEPS = 100_000


def entries(spans: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    return spans.filter(in_range("start_time_unix_nano", from_ns, to_ns)).filter(is_entry())


def _step() -> Column:
    """The step of a duration ``v``: values of eleven leading bits in common."""
    return F.greatest(F.length(F.bin("v")) - 11, F.lit(0)) * 1024 + F.expr("shiftright(v, cast(greatest(length(bin(v)) - 11, 0) as int))")


def _asked(steps: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Of ``steps`` (keys, step, m, failed; at most 55,000 a key) those in which the ranks of ``shares`` lie: ranks, before (how many lie in earlier steps), requests, errors."""
    up_to, whole = Window.partitionBy(*keys).orderBy("step"), Window.partitionBy(*keys)
    steps = steps.select(
        *keys, "step", "m", (F.sum("m").over(up_to) - F.col("m")).alias("before"), F.sum("m").over(whole).alias("requests"), F.sum("failed").over(whole).alias("errors")
    )
    ranks = F.array(*(f(_place(share)).cast("long") for share in shares for f in (F.floor, F.ceil)))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))
    return steps.withColumn("ranks", inside).filter(F.size("ranks") > 0).drop("m")


def _place(share: float) -> Column:
    return (F.col("requests") - 1) * F.lit(share)


def _percentiles(values: DataFrame, asked: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``keys``, requests, errors and percentiles, from the ``values`` (keys, step, v, n) of the steps ``asked`` for."""
    so_far = Window.partitionBy(*keys, "step").orderBy("v")
    values = values.join(asked, [*keys, "step"]).withColumn("last", F.col("before") + F.sum("n").over(so_far))
    found = values.select(*keys, "requests", "errors", "v", F.explode("ranks").alias("rank"), "last", "n").filter("rank < last and rank >= last - n")
    by_rank = found.groupBy(*keys, "requests", "errors").agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at"))  # two a share at most

    def percentile(share: float) -> Column:
        place = _place(share)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        value = lambda rank: F.element_at("at", rank).cast("double")
        exact = F.when(low == high, value(low)).otherwise((high - place) * value(low) + (place - low) * value(high))
        return (F.round(exact, 3) / 1e6).alias(f"p{share * 100:g}_ms")  # nanoseconds are rounded first, so that engines agree to the last bit

    return by_rank.select(*keys, "requests", "errors", *map(percentile, shares))


def _figures(rows: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``keys``, requests, errors, and exact percentiles of the duration in ms (interpolated between neighbours, as p50_ms etc.).

    Durations are counted by value, then by steps of their leading eleven bits. Sums over the steps of a key tell in which ones
    the ranks lie that are asked for; only the values within these are put in order. So no buffer or task holds all of a key's durations.
    """
    counts = rows.groupBy(*keys, F.col("duration_nano").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(span_is_error()).alias("failed"))
    counts = counts.withColumn("step", _step())
    steps = counts.groupBy(*keys, "step").agg(F.sum("n").alias("m"), F.sum("failed").alias("failed"))
    return _percentiles(counts.drop("failed"), _asked(steps, keys, shares), keys, shares)


def latency_hours(spans: DataFrame) -> DataFrame:
    """service_name, name, hour (its start in ns), step, m, failed: how many entry spans of each hour have a duration in each step. Kept, it answers for whole hours.

    Two such tables of different spans are put together by a union.
    """
    hour = F.expr(f"start_time_unix_nano - pmod(start_time_unix_nano, {HOUR}L)").alias("hour")
    rows = spans.filter(is_entry()).select("service_name", "name", hour, F.col("duration_nano").alias("v"), span_is_error().alias("error"))
    return rows.groupBy("service_name", "name", "hour", _step().alias("step")).agg(F.count(F.lit(1)).alias("m"), F.count_if("error").alias("failed"))


def asked_steps(hours: DataFrame, spans: DataFrame, from_ns: int, to_ns: int, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """The steps of a range that hold the ranks of ``shares``: of ``latency_hours`` for whole hours, of spans for what is left at either end."""
    low, high = -(-from_ns // HOUR) * HOUR, to_ns // HOUR * HOUR
    edges = latency_hours(spans.filter(in_range("start_time_unix_nano", from_ns, min(low, to_ns)) | in_range("start_time_unix_nano", max(high, low), to_ns)))
    rows = hours.filter(in_range("hour", low, high))
    rows = rows.unionByName(edges) if (low, high) != (from_ns, to_ns) else rows
    return _asked(rows.groupBy(*keys, "step").agg(F.sum("m").alias("m"), F.sum("failed").alias("failed")), keys, shares)


def _from_hours(hours: DataFrame, spans: DataFrame, from_ns: int, to_ns: int, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``_figures`` with all counts from ``hours``: of the spans only those whose durations lie in the few steps of the ranks are put in order."""
    asked = cut(asked_steps(hours, spans, from_ns, to_ns, keys, shares))
    rows = entries(spans, from_ns, to_ns).select(*keys, F.col("duration_nano").alias("v")).withColumn("step", _step())
    few = asked.limit(STEPS + 1).count() <= STEPS  # two a share for each key at most
    near = rows.join(F.broadcast(asked.select(*keys, "step")) if few else asked.select(*keys, "step"), [*keys, "step"], "left_semi")
    return _percentiles(near.groupBy(*keys, "step", "v").agg(F.count(F.lit(1)).alias("n")), asked, keys, shares)


def services_from_hours(hours: DataFrame, spans: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """``services`` from kept ``latency_hours``."""
    return _rated(_from_hours(hours, spans, from_ns, to_ns, ["service_name"], (0.5, 0.95, 0.99)), from_ns, to_ns)


def operations_from_hours(hours: DataFrame, spans: DataFrame, name: str, from_ns: int, to_ns: int, limit: int = 50) -> DataFrame:
    """``service_operations`` from kept ``latency_hours``."""
    of = lambda df: df.filter(F.col("service_name") == name)
    return _from_hours(of(hours), of(spans), from_ns, to_ns, ["name"], (0.5, 0.95)).orderBy(F.desc("requests"), "name").limit(limit)


def _rated(found: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    found = found.withColumn("error_rate", F.col("errors") / F.col("requests")).withColumn("rate", F.col("requests") / F.lit((to_ns - from_ns) / NANOS))
    return found.orderBy(F.desc("requests"), "service_name")


def services(spans: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """Per service: requests, errors, error rate, requests a second, p50, p95 and p99 in ms; most requests first."""
    return _rated(_figures(entries(spans, from_ns, to_ns), ["service_name"], (0.5, 0.95, 0.99)), from_ns, to_ns)


def service_timeline(spans: DataFrame, name: str, from_ns: int, to_ns: int, step_ns: int | None = None) -> DataFrame:
    """The figures of one service for each step that has requests."""
    step_ns = step_ns or nice_step(to_ns - from_ns, 60)
    rows = entries(spans, from_ns, to_ns).filter(F.col("service_name") == name).withColumn("bucket", bucket("start_time_unix_nano", from_ns, step_ns))
    rate = F.col("requests") / F.lit(step_ns / NANOS)
    found = _figures(rows, ["bucket"], (0.5, 0.95, 0.99))
    return found.select(bucket_start("bucket", from_ns, step_ns).alias("bucket_start"), "requests", "errors", "p50_ms", "p95_ms", "p99_ms", rate.alias("rate")).orderBy("bucket_start")


def service_operations(spans: DataFrame, name: str, from_ns: int, to_ns: int, limit: int = 50) -> DataFrame:
    """Per span name of a service's entry spans: requests, errors, p50, p95; most requests first."""
    rows = entries(spans, from_ns, to_ns).filter(F.col("service_name") == name)
    return _figures(rows, ["name"], (0.5, 0.95)).orderBy(F.desc("requests"), "name").limit(limit)


def service_map(spans: DataFrame, from_ns: int | None, to_ns: int | None) -> DataFrame:
    """from_service, to_service, requests, errors of calls between services; both spans start in the range."""
    rows = spans.filter(in_range("start_time_unix_nano", from_ns, to_ns)).select("trace_id", "span_id", "parent_span_id", "service_name", span_is_error().alias("failed"))
    parents = rows.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("from_service"))
    calls = rows.filter("parent_span_id <> ''").join(parents, ["trace_id", "parent_span_id"]).filter(F.col("from_service") != F.col("service_name"))
    edges = calls.groupBy("from_service", F.col("service_name").alias("to_service"))
    return edges.agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors")).orderBy(F.desc("requests"), "from_service", "to_service")


def service_calls(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("from_service") == name)


def service_called_by(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("to_service") == name)


def service_health(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` (as ``services`` gives it) with status and reasons, next to the period before; worst first.

    The error rate and the growth of the p95 each give a status; the worse one holds.
    """
    old = before.select("service_name", F.col("p95_ms").alias("before_p95_ms"))
    rows = now.join(old, "service_name", "left")
    ratio = F.when((F.col("p95_ms") >= SLOW_MS) & (F.col("before_p95_ms") > 0), F.col("p95_ms") / F.col("before_p95_ms"))
    level = lambda x, steps: F.when(x >= steps[1], 2).when(x >= steps[0], 1).otherwise(0)
    rows = rows.withColumn("by_errors", level(F.col("error_rate"), ERRORS)).withColumn("by_latency", level(ratio, RATIOS))
    reasons = F.concat_ws(",", F.when(F.col("by_errors") > 0, "errors"), F.when(F.col("by_latency") > 0, "latency"))
    worst = F.greatest("by_errors", "by_latency")
    return (
        rows.withColumn("status", F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), worst + 1))
        .withColumn("reasons", reasons)
        .orderBy(F.desc(worst), F.desc("error_rate"), "service_name")
        .drop("by_errors", "by_latency")
    )


def deployments(spans: DataFrame, from_ns: int, to_ns: int, lookback_ns: int = 24 * HOUR) -> DataFrame:
    """service_name, version, previous, at: versions first seen in the range after another version of their service; newest first."""
    version = F.col("resource_attributes")["service.version"]
    rows = spans.filter(in_range("start_time_unix_nano", from_ns - lookback_ns, to_ns)).select("service_name", version.alias("version"), "start_time_unix_nano")
    first = rows.filter("version is not null").groupBy("service_name", "version").agg(F.min("start_time_unix_nano").alias("at"))
    previous = F.lag("version").over(Window.partitionBy("service_name").orderBy("at", "version"))
    new = first.withColumn("previous", previous).filter((F.col("at") >= from_ns) & (F.col("previous") != "") & (F.col("previous") != F.col("version")))
    return new.orderBy(F.desc("at"), "service_name")
