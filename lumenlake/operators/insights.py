"""Issues (errors grouped by message at their origin), and what sets some records apart from the others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Term, log_filter, log_is_error, span_filter, span_is_error
from ..functions.text import issue_id, message_template
from ..functions.time import bucket, in_range
from ..schema import TIME
from .traces import error_ancestors

#: Shares from which an attribute value is reported: in the selection, and above the baseline.
SHARE, GAP = 0.2, 0.1
#: Items of a sketch of frequent pairs: at first, enough for 117 entries a record, and at most.
ITEMS, MOST_ITEMS = 1 << 12, 1 << 20


def _marked(df: DataFrame, signal: str, from_ns: int, to_ns: int, terms: Iterable[Term], errors: bool, window: tuple[int, int] | None) -> DataFrame:
    """Matching records of the range with ``chosen``: errors, or those of the window."""
    matches = log_filter(terms) if signal == "logs" else span_filter(terms)
    rows = df.filter(in_range(TIME[signal], from_ns, to_ns)).filter(matches)
    if errors:
        chosen = log_is_error() if signal == "logs" else span_is_error()
    else:
        chosen = in_range(TIME[signal], *window)
    return rows.withColumn("chosen", F.coalesce(chosen, F.lit(False)))


def _entries(signal: str) -> Column:
    """All keys and values of a record: its own, its resource's and a span's name. A key in both maps is there twice."""
    entries = F.concat(F.map_entries("attributes"), F.map_entries("resource_attributes"))
    return F.concat(entries, F.array(F.struct(F.lit("span.name").alias("key"), F.col("name").alias("value")))) if signal == "spans" else entries


def compare_counts(rows: DataFrame, signal: str) -> DataFrame:
    """key, value, selected, others over record attributes, resource attributes and span names. A key in both maps counts twice."""
    pairs = rows.select("chosen", F.explode(_entries(signal)).alias("e")).select("chosen", "e.key", "e.value")
    return pairs.groupBy("key", "value").agg(F.count_if("chosen").alias("selected"), F.count_if(~F.col("chosen")).alias("others"))


def _name(entry: Column) -> Column:
    """A key and value as one text; keys with separators in them do not collide."""
    return F.concat(F.length(entry["key"]).cast("string"), F.lit(":"), entry["key"], F.lit("="), entry["value"])


def frequent_pairs(rows: DataFrame, signal: str, share: float = SHARE, items: int = ITEMS) -> tuple[list[str], int, int]:
    """Names (``_name``) of all pairs that at least ``share`` of the chosen ``rows`` can have, and how many rows are chosen and not.

    One pass with a sketch of frequent items in each task, of which ``items`` are kept; what is shuffled is a sketch per task, however many values there
    are. The sketch may miss a count by 3.5 of ``items`` of all pairs; it is made anew with more if that is over half the share.
    """
    pairs = rows.select("chosen", F.posexplode_outer(_entries(signal)).alias("at", "e")).select("chosen", "at", _name(F.col("e")).alias("pair"))
    while True:
        kept = int(items * share / 7)  # no more pairs can have half the share if the sketch is large enough
        own = F.col("at").isNull() | (F.col("at") == 0)
        found = pairs.agg(
            F.expr(f"approx_top_k(pair, {kept}, {items}) FILTER (WHERE chosen AND pair IS NOT NULL)").alias("top"), F.count_if(F.col("chosen") & F.col("pair").isNotNull()).alias("all"),
            F.count_if(F.col("chosen") & own).alias("selection"), F.count_if(~F.col("chosen") & own).alias("baseline"),
        ).first()
        if 3.5 * found["all"] <= items * share / 2 * found["selection"] or items >= MOST_ITEMS:
            break
        items *= 4
    least = share * found["selection"]
    return [t["item"] for t in found["top"] or () if t["count"] >= least], found["selection"], found["baseline"]


def compare(
    df: DataFrame, signal: str, from_ns: int, to_ns: int, terms: Iterable[Term] = (), errors: bool = False, window: tuple[int, int] | None = None, limit: int = 12
) -> DataFrame:
    """The attribute values most over-represented among errors, or in a window, against all other records of the range.

    A first pass finds the few pairs that reach the share (``frequent_pairs``), a second one counts those alone.
    """
    rows = _marked(df, signal, from_ns, to_ns, terms, errors, window)
    names, selection, baseline = frequent_pairs(rows, signal)
    sought = F.broadcast(rows.sparkSession.createDataFrame([(n,) for n in names], "pair string"))  # a few for each entry of a record
    pairs = rows.select("chosen", F.explode(_entries(signal)).alias("e")).withColumn("pair", _name(F.col("e"))).join(sought, "pair").select("chosen", "e.key", "e.value")
    shares = pairs.groupBy("key", "value").agg(F.count_if("chosen").alias("selected"), F.count_if(~F.col("chosen")).alias("others"))
    shares = shares.withColumn("selection", F.lit(selection).cast("long")).withColumn("baseline", F.lit(baseline).cast("long"))
    shares = shares.withColumn("share", F.col("selected") / F.col("selection"))
    shares = shares.withColumn("base_share", F.when(F.col("baseline") > 0, F.try_divide("others", "baseline")).otherwise(0.0))
    shares = shares.filter((F.col("share") >= SHARE) & (F.col("share") - F.col("base_share") >= GAP))
    order = [F.desc(F.col("share") - F.col("base_share")), F.desc(F.col("key") == "service.name"), F.col("key"), F.col("value")]
    return shares.orderBy(*order).limit(limit)


def _issue_rows(rows: DataFrame, time: str, kind: str, title: Column, from_ns: int, step_ns: int, buckets: int) -> DataFrame:
    """One row per issue of the errors ``rows``, of both periods, with counts and the latest example."""
    template = message_template(F.col("title"))
    rows = rows.select("service_name", "trace_id", F.col(time).alias("t"), title.alias("title"))
    rows = rows.withColumn("template", template).withColumn("now", F.col("t") >= from_ns)
    slot = F.least(bucket("t", from_ns, step_ns), F.lit(buckets - 1))
    latest = F.struct("t", "title", "trace_id")
    now = lambda x: F.when(F.col("now"), x)
    traced = F.when(F.col("now") & (F.col("trace_id") != ""), latest)
    counted = rows.groupBy("service_name", "template").agg(
        F.count_if("now").alias("count"), F.count_if(~F.col("now")).alias("previous"), F.min(now(F.col("t"))).alias("first_seen"),
        F.max(now(F.col("t"))).alias("last_seen"), F.max(now(latest)).alias("example"), F.max(traced).alias("traced"),
        *(F.count_if(F.col("now") & (slot == k)).alias(f"b{k}") for k in range(buckets)),
    )
    return counted.filter("count > 0").select(
        issue_id(F.col("service_name"), F.lit(kind), F.col("template")).alias("id"), "service_name", F.lit(kind).alias("kind"), "template", "count", "previous",
        "first_seen", "last_seen", F.col("example.title").alias("example"), F.coalesce("traced.trace_id", F.lit("")).alias("example_trace_id"),
        F.array(*(F.col(f"b{k}") for k in range(buckets))).alias("buckets"),
    )


def _with_status(found: DataFrame, all_rows: DataFrame, time: str, before_ns: int, from_ns: int) -> DataFrame:
    """``status``: nothing is new or rising unless there are records of the period before."""
    history = all_rows.filter(in_range(time, before_ns, from_ns)).limit(1).agg((F.count(F.lit(1)) > 0).alias("history"))  # one row
    status = F.when(~F.col("history"), "ongoing").when(F.col("previous") == 0, "new").when(F.col("count") >= 2 * F.col("previous"), "rising").otherwise("ongoing")
    return found.crossJoin(F.broadcast(history)).withColumn("status", status).drop("history")


def log_issues(logs: DataFrame, from_ns: int, to_ns: int, buckets: int = 24) -> DataFrame:
    before, step = from_ns - (to_ns - from_ns), max((to_ns - from_ns) // buckets, 1)
    rows = logs.filter(in_range("time_unix_nano", before, to_ns)).filter(log_is_error())
    return _with_status(_issue_rows(rows, "time_unix_nano", "log", F.col("body"), from_ns, step, buckets), logs, "time_unix_nano", before, from_ns)


def span_issues(spans: DataFrame, from_ns: int, to_ns: int, buckets: int = 24) -> DataFrame:
    """Issues of error spans at their origin: spans above another error span of both periods do not count."""
    before, step, time = from_ns - (to_ns - from_ns), max((to_ns - from_ns) // buckets, 1), "start_time_unix_nano"
    rows = spans.filter(in_range(time, before, to_ns))
    above = error_ancestors(rows).withColumnRenamed("ancestor", "span_id")
    origins = rows.filter(span_is_error()).join(above, ["trace_id", "span_id"], "left_anti")
    title = F.when(F.col("status_message") == "", F.col("name")).otherwise(F.concat("name", F.lit(": "), "status_message"))
    return _with_status(_issue_rows(origins, time, "span", title, from_ns, step, buckets), spans, time, before, from_ns)


def issues(logs: DataFrame, spans: DataFrame, from_ns: int, to_ns: int, buckets: int = 24, service: str | None = None) -> DataFrame:
    """Issues of both signals, most frequent first."""
    found = log_issues(logs, from_ns, to_ns, buckets).unionByName(span_issues(spans, from_ns, to_ns, buckets))
    if service is not None:
        found = found.filter(F.col("service_name") == service)
    return found.orderBy(F.desc("count"), "id")


def log_patterns(logs: DataFrame, from_ns: int, to_ns: int, limit: int = 50) -> DataFrame:
    """The most frequent message templates: template, logs, services."""
    rows = logs.filter(in_range("time_unix_nano", from_ns, to_ns)).select(message_template(F.col("body")).alias("template"), "service_name")
    counts = rows.groupBy("template").agg(F.count(F.lit(1)).alias("logs"), F.count_distinct("service_name").alias("services"))
    return counts.orderBy(F.desc("logs"), "template").limit(limit)
