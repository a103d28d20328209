"""The three signals, derived from the star-schema tables that tests and benchmarks use."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HOUR, NANOS, TIME
from . import folders

#: The upper bounds of the histogram buckets, and the event types in the order that gives their series ids.
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the three signals to ``folder`` once, in order of time. Given to the queries in place of ``sf_dir``, it is read instead of derived.

    The tables spread a few rows over each of many hours, so these are few files and not the hourly layout.
    """
    for name, rows in (("spans", spans(spark, sf_dir)), ("logs", logs(spark, sf_dir)), ("metric_points", metric_points(spark, sf_dir))):
        time = TIME[name]
        rows.repartitionByRange(spark.sparkContext.defaultParallelism, time).sortWithinPartitions(time).write.parquet(f"{folder}/signals/{name}")


def _stored(signal: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(signal)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/signals/{signal.__name__}"
        return spark.read.parquet(path) if folders.exists(spark, path) else signal(spark, sf_dir)

    return read


def _nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def _text_map(**entries: Column) -> Column:
    pairs = [x for k, v in entries.items() for x in (F.lit(k.replace("__", ".")), v)]
    return F.create_map(*pairs)


_EVENTS = "array<struct<time_unix_nano:bigint,name:string,attributes:map<string,string>>>"


@_stored
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as root spans, their line items as children: a chain for even order keys, a binary tree for odd ones."""
    orders = table(spark, sf_dir, "orders")
    version = F.concat(F.lit("1."), (F.year(F.col("o_orderdate")) - 1995).cast("string"))
    begin = _nanos("o_orderdate") + (F.col("o_orderkey") % 86400) * NANOS
    failed = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)
    shop = F.concat(F.lit("shop-"), F.substring("o_orderpriority", 1, 1))
    roots = orders.select(
        F.col("o_orderkey").cast("string").alias("trace_id"), F.lit("0").alias("span_id"), F.lit("").alias("parent_span_id"),
        F.concat(F.lit("order "), "o_orderpriority").alias("name"), F.lit("Server").alias("kind"),
        begin.alias("start_time_unix_nano"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("duration_nano"),
        F.when(failed, "Error").otherwise("Unset").alias("status_code"), F.lit("").alias("status_message"), shop.alias("service_name"),
        _text_map(order__status=F.col("o_orderstatus"), order__priority=F.col("o_orderpriority")).alias("attributes"),
        _text_map(service__name=shop, service__version=version).alias("resource_attributes"),
    )
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(place))
    joined = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    supplier = F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 7).cast("string"))
    children = joined.select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.col("n").cast("string").alias("span_id"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("n") - 1).otherwise(F.expr("n div 2")).cast("string").alias("parent_span_id"),
        F.concat(F.lit("handle "), "l_returnflag", "l_linestatus").alias("name"),
        F.when(F.col("n") % 3 == 0, "Client").when(F.col("n") % 3 == 1, "Server").otherwise("Internal").alias("kind"),
        (begin + F.col("n").cast("long") * 1_000_000).alias("start_time_unix_nano"), (F.col("l_quantity").cast("long") * 1_000_000).alias("duration_nano"),
        F.when(returned, "Error").when(F.col("l_returnflag") == "A", "Ok").otherwise("Unset").alias("status_code"),
        F.when(returned, F.concat(F.lit("item "), F.col("l_partkey").cast("string"), F.lit(" returned"))).otherwise("").alias("status_message"),
        supplier.alias("service_name"),
        _text_map(line__status=F.col("l_linestatus"), line__flag=F.col("l_returnflag")).alias("attributes"),
        _text_map(service__name=supplier, service__version=version).alias("resource_attributes"),
    )
    both = roots.unionByName(children)
    return both.withColumn("end_time_unix_nano", F.col("start_time_unix_nano") + F.col("duration_nano")).withColumn("scope_name", F.lit("")).withColumn("events", F.array().cast(_EVENTS))


def _service() -> Column:
    return F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))


@_stored
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per event; levels by type, one of them in lower case and one absent."""
    kind = F.col("event_type")
    by_type = lambda **v: F.expr("case event_type " + " ".join(f"when '{k}' then {x!r}" for k, x in v.items()) + " end")
    own = F.map_concat(
        _text_map(event__type=kind),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    where = F.when(F.col("user_id") % 3 > 0, "prod").otherwise("staging")
    return table(spark, sf_dir, "events").select(
        _nanos("ts").alias("time_unix_nano"), _nanos("ts").alias("observed_time_unix_nano"), _service().alias("service_name"),
        by_type(error=17, purchase=13, signup=9, click=5, view=0).alias("severity_number"),
        by_type(error="ERROR", purchase="WARN", signup="INFO", click="debug", view="").alias("severity_text"),
        F.concat(kind, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value "), F.col("value").cast("decimal(18,2)").cast("string")).alias("body"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise((F.col("event_id") % 1500).cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"), F.lit("").alias("scope_name"), own.alias("attributes"),
        _text_map(service__name=_service(), deployment__environment__name=where).alias("resource_attributes"),
    )


@_stored
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge, cumulative and delta sums per user; histogram, exponential histogram and summary per event type and hour."""
    time = _nanos("ts")
    day = F.expr(f"time_unix_nano - time_unix_nano % {24 * HOUR}L")
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", time.alias("time_unix_nano"), F.round(F.col("value") * 100).cast("long").alias("cents")
    ).withColumn("day", day)
    no_list = {"count": "bigint", "sum": "double", "min": "double", "max": "double", "explicit_bounds": "array<double>", "bucket_counts": "array<bigint>"}
    so_far = Window.partitionBy("user_id", "day").orderBy("time_unix_nano", "event_id").rowsBetween(Window.unboundedPreceding, 0)

    def numbers(rows: DataFrame, name: str, kind: str, temporality: str, value: Column, start: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("metric_name"), F.lit(kind).alias("type"), F.lit("1").alias("unit"), F.lit(temporality).alias("temporality"),
            F.lit(kind == "Sum").alias("is_monotonic"), F.col("user_id").alias("series_id"), _service().alias("service_name"), F.lit("").alias("scope_name"),
            _text_map(user__id=F.col("user_id").cast("string")).alias("attributes"), _text_map(service__name=_service()).alias("resource_attributes"),
            start.alias("start_time_unix_nano"), "time_unix_nano", value.cast("double").alias("value"),
            *(F.lit(None).cast(t).alias(n) for n, t in no_list.items()),
        )

    slot = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b < F.col("value")))
    hour = F.expr(f"time_unix_nano - time_unix_nano % {HOUR}L")
    hourly = events.withColumn("slot", slot).groupBy("event_type", "day", hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), *(F.count_if(F.col("slot") == k).alias(f"c{k}") for k in range(len(BOUNDS) + 1))
    )
    of_day = Window.partitionBy("event_type", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    running = hourly.select(
        "event_type", "day", "hour", F.sum("n").over(of_day).alias("n"), F.sum("cents").over(of_day).alias("cents"),
        F.array(*(F.sum(f"c{k}").over(of_day) for k in range(len(BOUNDS) + 1))).alias("buckets"),
    )

    def distributions(name: str, kind: str, temporality: str, with_buckets: bool) -> DataFrame:
        service = F.lit("svc-events")
        return running.select(
            F.lit(name).alias("metric_name"), F.lit(kind).alias("type"), F.lit("1").alias("unit"), F.lit(temporality).alias("temporality"),
            F.lit(False).alias("is_monotonic"), F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).alias("series_id"), service.alias("service_name"),
            F.lit("").alias("scope_name"), _text_map(event__type=F.col("event_type")).alias("attributes"), _text_map(service__name=service).alias("resource_attributes"),
            F.col("day").alias("start_time_unix_nano"), (F.col("hour") + F.lit(HOUR - NANOS)).alias("time_unix_nano"), F.lit(None).cast("double").alias("value"),
            F.col("n").alias("count"), F.col("cents").cast("double").alias("sum"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
            (F.array(*map(F.lit, BOUNDS)) if with_buckets else F.array().cast("array<double>")).alias("explicit_bounds"),
            (F.col("buckets") if with_buckets else F.array().cast("array<bigint>")).alias("bucket_counts"),
        )

    parts = [
        numbers(events, "event.value", "Gauge", "", F.col("value"), F.col("time_unix_nano")),
        numbers(events.withColumn("total", F.sum("cents").over(so_far)), "event.cents", "Sum", "Cumulative", F.col("total"), F.col("day")),
        numbers(events, "event.cents.delta", "Sum", "Delta", F.col("cents"), F.col("day")),
        distributions("event.size", "Histogram", "Cumulative", True),
        distributions("event.size.exp", "ExponentialHistogram", "Cumulative", False),
        distributions("event.size.summary", "Summary", "", False),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
