"""Alert rules over tables: values, one evaluation, back-tests over history, and status.

Labels are shown as ``k=v,k=v``: a group. Times are nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import attribute, severity
from ..schema import NANOS
from .metrics import LOOKBACK, bucket_quantile, counter_increments, distribution_increments, merged_buckets

EVENTS, MOST_EVENTS = 50, 1000
#: Keys of rules that are broadcast; more are joined by a shuffle.
AT_ONCE = 10_000


def breached(value: Column, op: Column, threshold: Column) -> Column:
    """Whether the comparison holds; an unknown operator never does."""
    return F.coalesce(
        F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold).when(op == "<=", value <= threshold), F.lit(False)
    )


def _term_holds(term: Column) -> Column:
    """A structured term of a rule against a log; null (an attribute that is absent) is no match, negated or not."""
    key, value = F.lower(term["key"]), term["value"]
    values = F.transform(F.split(value, ","), lambda v: F.upper(F.trim(v)))
    text = F.contains(F.lower("body"), F.lower(value)) | F.contains(F.lower(F.array_join(F.map_values("attributes"), " ")), F.lower(value))
    own = F.coalesce(F.element_at("attributes", term["key"]), F.element_at("resource_attributes", term["key"]))
    holds = (
        F.when(key == "", text).when(key == "service", F.col("service_name") == value).when(key == "trace_id", F.col("trace_id") == value)
        .when(key.isin("level", "status", "severity"), F.array_contains(values, F.upper("severity_text"))).otherwise(own == value)
    )
    return F.coalesce(F.when(term["negated"], ~holds).otherwise(holds), F.lit(False))


def _index_keys(rules: DataFrame) -> DataFrame:
    """``rules`` with ``key``: what a log must have to match, a row for each value that does, and ``asks``: the attribute that it is of.

    Rules with text and negated terms alone have the key ''.
 Of a rule's plain terms the one that tells most apart serves: a trace, else an attribute, a service, a level.
    """
    known = lambda t: F.lower(t["key"])
    kind = lambda t: F.when(known(t) == "trace_id", 0).when(known(t) == "service", 2).when(known(t).isin("level", "status", "severity"), 3).otherwise(1)
    plain = F.filter("terms", lambda t: (t["key"] != "") & ~t["negated"])
    best = F.array_min(F.transform(plain, lambda t: F.struct(kind(t).alias("kind"), t["key"].alias("name"), t["value"].alias("value"))))
    named = F.element_at(F.array(F.lit("trace_id="), F.concat(F.lit("a:"), "best.name", F.lit("=")), F.lit("service="), F.lit("level=")), F.col("best.kind") + 1)
    levels = F.array_distinct(F.transform(F.split("best.value", ","), lambda v: F.upper(F.trim(v))))
    values = F.when(F.col("best.kind") == 3, levels).otherwise(F.array("best.value"))
    keys = F.when(F.col("best").isNull(), F.array(F.lit(""))).otherwise(F.transform(values, lambda v: F.concat(named, v)))
    return rules.withColumn("best", best).withColumn("key", F.explode(keys)).withColumn("asks", F.when(F.col("best.kind") == 1, F.col("best.name"))).drop("best")


def rule_hits(logs: DataFrame, rules: DataFrame, all_logs: bool = False) -> DataFrame:
    """rule_id, group, time_unix_nano, window, op, threshold, hold (ns) of every match of a log with an enabled log rule.

    Logs meet rules by an equality: that of a key that the log has and the rule asks for. Only rules of text and negated terms alone meet all
    logs. Up to AT_ONCE rules are broadcast; more are joined by a shuffle on the key. With ``all_logs`` logs without a match are there too, with
    a null rule_id. Works on tables and on streams.
    """
    own = rules.filter("enabled and kind = 'logs'").select(
        F.col("id").alias("rule_id"), "terms", "group_by", "op", "threshold", (F.col("window_seconds").cast("long") * NANOS).alias("window"), (F.col("for_seconds").cast("long") * NANOS).alias("hold")
    )
    keyed = _index_keys(own)
    keys, used = keyed.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("asks"))).first()  # names of the attributes that rules ask for
    has = [F.lit(""), F.concat(F.lit("service="), "service_name"), F.concat(F.lit("trace_id="), "trace_id"), F.concat(F.lit("level="), F.upper("severity_text"))]
    has += [F.concat(F.lit(f"a:{k}="), attribute(k)) for k in used]
    rows = logs.withColumn("key", F.explode(F.array_compact(F.array(*has))))
    listed = F.broadcast(keyed) if keys <= AT_ONCE else keyed
    rows = rows.join(listed, (rows["key"] == listed["key"]) & F.forall("terms", _term_holds), "left" if all_logs else "inner").filter(F.col("rule_id").isNotNull() | (rows["key"] == ""))
    value_of = lambda k: F.when(k == "level", severity()).otherwise(F.coalesce(F.element_at("attributes", k), F.element_at("resource_attributes", k), F.lit("")))
    group = F.array_join(F.transform(F.array_sort("group_by"), lambda k: F.concat(k, F.lit("="), value_of(k))), ",")
    return rows.select("rule_id", group.alias("group"), "time_unix_nano", "window", "op", "threshold", "hold")


def _ungrouped(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled and kind = 'logs' and size(group_by) = 0").select(F.col("id").alias("rule_id"), F.lit("").alias("group"))


def log_rule_values(logs: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """rule_id, group, value: for each enabled log rule the matching logs of its window, per group. Rules without groups yield 0 if nothing matches.

    One pass over the logs of the longest window.
    """
    longest = rules.filter("enabled and kind = 'logs'").agg(F.max("window_seconds")).first()[0] or 0
    recent = logs.filter((F.col("time_unix_nano") >= now - longest * NANOS) & (F.col("time_unix_nano") < now))
    hits = rule_hits(recent, rules).filter(F.col("time_unix_nano") >= F.lit(now) - F.col("window"))
    counts = hits.groupBy("rule_id", "group").agg(F.count(F.lit(1)).cast("double").alias("value"))
    zero = _ungrouped(rules).join(counts, ["rule_id", "group"], "left_anti").withColumn("value", F.lit(0.0))
    return counts.unionByName(zero)


def tick_slot(rules: DataFrame, every: int) -> int:
    """The longest stretch (ns) of which ``every`` and all windows of log rules are multiples."""
    windows = rules.filter("enabled and kind = 'logs'").select("window_seconds").distinct().collect()  # a row per length of window
    return gcd(every, *(r["window_seconds"] * NANOS for r in windows))


def log_rule_ticks(logs: DataFrame, rules: DataFrame, every: int, from_ns: int, to_ns: int) -> DataFrame:
    """rule_id, group, tick, value: the values of all log rules at every multiple of ``every`` in ``[from_ns, to_ns]``, for ``alert_backtest``.

    Matches are counted by slot (``tick_slot``), and only the counts go to the ticks whose windows hold the slot. A group without matching
    logs has no value at a tick, a rule without groups 0.
    """
    slot = tick_slot(rules, every)
    hits = rule_hits(logs.filter(F.col("time_unix_nano") < to_ns), rules)
    slots = hits.groupBy("rule_id", "group", "window", F.expr(f"time_unix_nano div {slot}L * {slot}L").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    first = F.expr(f"(greatest(slot + {slot}L, {from_ns}L) + {every - 1}L) div {every}L")
    last = F.expr(f"least(slot + window, {to_ns}L) div {every}L")
    at = slots.withColumn("first", first).withColumn("last", last).filter("first <= last")
    ticks = at.withColumn("tick", F.explode(F.sequence("first", "last"))).withColumn("tick", F.col("tick") * every)
    counts = ticks.groupBy("rule_id", "group", "tick").agg(F.sum("n").cast("double").alias("value"))
    low, high = -(-from_ns // every), to_ns // every
    zero = _ungrouped(rules).withColumn("tick", F.explode(F.expr(f"sequence({low}L, {high}L)"))).filter(F.lit(low <= high)).withColumn("tick", F.col("tick") * every)
    zero = zero.join(counts, ["rule_id", "group", "tick"], "left_anti").withColumn("value", F.lit(0.0))
    return counts.unionByName(zero)


_METRIC_RULE = "rule_id string, metric_name string, agg string, filters map<string,string>, group_by array<string>, seconds long"


def metric_rule_values(points: DataFrame, rules: Iterable[dict], now: int) -> DataFrame:
    """rule_id, group, value of metric rules (their rows as dicts): the metric's single step over each rule's window.

    All rules are answered in one pass over the points for each way of reading a metric (gauge, counter, distribution; differenced
    or not), of which there are five.
    """
    listed = [(r["id"], r["metric"], r.get("agg") or None, r.get("filters") or {}, sorted(r.get("group_by") or ()), r["window_seconds"]) for r in rules]
    spark = points.sparkSession
    if not listed:
        return spark.createDataFrame([], "rule_id string, `group` string, value double")
    own = F.broadcast(spark.createDataFrame(listed, _METRIC_RULE))
    low = F.lit(now) - F.col("seconds") * NANOS
    time = F.col("time_unix_nano")
    longest = max(r[5] for r in listed) * NANOS
    attribute_of = lambda k: F.coalesce(F.element_at("attributes", k), F.element_at("resource_attributes", k))
    rows = points.filter((time >= now - longest - LOOKBACK) & (time < now)).join(own, "metric_name").filter(time >= low - LOOKBACK)
    kinds = rows.groupBy("rule_id").agg(F.max("type").alias("kind"), F.max("temporality").alias("how"), F.bool_or("is_monotonic").alias("grows"))  # a row per rule
    shape = (
        F.when(F.col("kind").isin("Histogram", "ExponentialHistogram", "Summary"), F.when((F.col("kind") == "Summary") | (F.col("how") == "Delta"), "whole").otherwise("differenced"))
        .when((F.col("kind") == "Sum") & F.col("grows"), F.when(F.col("how") == "Delta", "delta").otherwise("counter"))
        .otherwise("gauge")
    )
    rows = rows.join(F.broadcast(kinds.select("rule_id", shape.alias("shape"))), "rule_id")
    rows = rows.filter(F.forall(F.map_entries("filters"), lambda e: F.coalesce(attribute_of(e["key"]) == e["value"], F.lit(False))))
    group = F.array_join(F.transform("group_by", lambda k: F.concat(k, F.lit("="), F.coalesce(attribute_of(k), F.lit("")))), ",")
    rows = rows.select(
        "rule_id", group.alias("group"), "shape", "agg", "seconds", (time >= low).alias("inside"), "series_id", "start_time_unix_nano", "time_unix_nano", "value", "count", "sum",
        "explicit_bounds", "bucket_counts",
    )
    of, keys, whole = lambda shape: rows.filter(F.col("shape") == shape), ["rule_id", "series_id"], ["rule_id", "group", "agg", "seconds"]

    def reduced(series: DataFrame, default: str) -> DataFrame:
        named = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double")}
        found = series.groupBy("rule_id", "group", "agg").agg(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))).alias("by"))
        return found.select("rule_id", "group", F.element_at("by", F.coalesce("agg", F.lit(default))).alias("value"))

    last = of("gauge").filter("inside").groupBy(*whole, "series_id").agg(F.max_by("value", F.struct("time_unix_nano", "value")).alias("value"))
    out = [reduced(last, "avg")]
    for shape, delta in (("counter", False), ("delta", True)):
        grown = counter_increments(of(shape), delta, keys).filter("inside and increment is not null")
        out.append(reduced(grown.groupBy(*whole, "series_id").agg((F.sum("increment") / F.col("seconds")).alias("value")), "sum"))
    for shape, differenced in (("differenced", True), ("whole", False)):
        seen = distribution_increments(of(shape), differenced, keys).filter("inside").withColumn("agg", F.coalesce("agg", F.lit("avg")))
        value = F.when(F.col("agg") == "count", F.sum("count") / F.col("seconds")).when((F.col("agg") == "avg") & (F.sum("count") != 0), F.sum("sum") / F.sum("count"))
        out.append(seen.filter("agg in ('count', 'avg')").groupBy(*whole).agg(value.alias("value")).select("rule_id", "group", "value"))
        share = F.regexp_extract("agg", r"^p([0-9.]+)$", 1).try_cast("double") / 100
        merged = merged_buckets(seen.withColumn("share", share).filter("share > 0 and share < 1"), ["rule_id", "group", "share"])
        out.append(bucket_quantile(merged, ["rule_id", "group"], F.col("share")))
    return reduce(DataFrame.union, out).filter("value is not null")


def preview(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``values`` with their rule's comparison: nothing is kept."""
    by = rules.select(F.col("id").alias("rule_id"), "op", "threshold")
    return values.join(by, "rule_id").withColumn("breached", breached(F.col("value"), F.col("op"), F.col("threshold")))


def alert_transition(rules: DataFrame, previous: DataFrame, values: DataFrame, now: int) -> DataFrame:
    """One evaluation of all rules: a row per rule and group that had a state or has a value.

    rule_id, group, status (null: the state goes), since, value, event (firing, resolved or null), event_value.
    Disabled rules lose their states silently.
    """
    by = rules.filter("enabled").select(F.col("id").alias("rule_id"), "op", "threshold", (F.col("for_seconds").cast("long") * NANOS).alias("hold"))
    old = previous.select("rule_id", "group", F.col("status").alias("was"), F.col("since").alias("was_since"), F.col("value").alias("was_value"))
    rows = values.select("rule_id", "group", "value").join(old, ["rule_id", "group"], "full_outer").join(by, "rule_id")
    present = F.col("value").isNotNull()
    high = present & breached(F.col("value"), F.col("op"), F.col("threshold"))
    was = F.coalesce("was", F.lit("none"))
    holding = (was == "pending") & (F.lit(now) - F.col("was_since") < F.col("hold"))
    status = (
        F.when(~present, None)
        .when(high & (was == "firing"), "firing")
        .when(high & was.isin("none", "ok") & (F.col("hold") > 0), "pending")
        .when(high & holding, "pending")
        .when(high, "firing")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    fires = (F.col("status") == "firing") & (was != "firing")
    resolves = (was == "firing") & (F.coalesce("status", F.lit("")) != "firing")
    since = F.when(F.col("status") == was, F.col("was_since")).when(F.col("status").isNotNull(), F.lit(now).cast("long"))
    event = F.when(fires, "firing").when(resolves, "resolved")
    shown = F.when(event.isNotNull(), F.coalesce("value", "was_value"))
    return rows.select("rule_id", "group", "status", since.alias("since"), F.when(present, F.col("value")).alias("value"), event.alias("event"), shown.alias("event_value"))


def alert_backtest(rules: DataFrame, values: DataFrame, tick_ns: int) -> DataFrame:
    """rule_id, group, fired_at, resolved_at (null: still firing) over all ticks at once.

    ``values``: rule_id, group, tick, value. Breached ticks one ``tick_ns`` apart form an island; it fires at its first tick, or at
    the first one by which it has lasted as long as the rule asks. A tick without a value counts as not breached.
    """
    by = rules.filter("enabled").select(F.col("id").alias("rule_id"), "op", "threshold", (F.col("for_seconds").cast("long") * NANOS).alias("hold"))
    high = values.join(by, "rule_id").filter(breached(F.col("value"), F.col("op"), F.col("threshold")))
    last = values.groupBy("rule_id").agg(F.max("tick").alias("last_tick"))
    in_order = Window.partitionBy("rule_id", "group").orderBy("tick")
    begins = F.coalesce(F.col("tick") - F.lag("tick").over(in_order) > tick_ns, F.lit(True))
    numbered = high.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(in_order))
    begun = numbered.withColumn("begun", F.min("tick").over(Window.partitionBy("rule_id", "group", "island")))
    lasting = F.when((F.col("tick") - F.col("begun") >= F.col("hold")), F.col("tick"))
    islands = begun.groupBy("rule_id", "group", "island").agg(F.min(lasting).alias("fired_at"), F.max("tick").alias("end")).filter("fired_at is not null")
    over = F.when(F.col("end") < F.col("last_tick"), F.col("end") + tick_ns)
    return islands.join(last, "rule_id").select("rule_id", "group", "fired_at", over.alias("resolved_at"))


def backtest_events(tested: DataFrame, values: DataFrame, tick_ns: int) -> DataFrame:
    """rule_id, group, event, at, value of ``alert_backtest``: firing with the value then; resolved with the value then, or the last one if there is none."""
    at = values.select("rule_id", "group", F.col("tick").alias("at"), "value")
    fired = tested.select("rule_id", "group", F.lit("firing").alias("event"), F.col("fired_at").alias("at")).join(at, ["rule_id", "group", "at"])
    over = tested.filter("resolved_at is not null").select("rule_id", "group", F.lit("resolved").alias("event"), F.col("resolved_at").alias("at"))
    last = at.withColumn("at", F.col("at") + tick_ns).withColumnRenamed("value", "last")
    over = over.join(at, ["rule_id", "group", "at"], "left").join(last, ["rule_id", "group", "at"]).withColumn("value", F.coalesce("value", "last")).drop("last")
    names = ["rule_id", "group", "event", "at", "value"]
    return fired.select(names).unionByName(over.select(names))


def rule_status(rules: DataFrame, states: DataFrame) -> DataFrame:
    """id, name, status (firing if any group fires, else pending if any pends, else ok), firing groups."""
    order = F.when(F.col("status") == "firing", 2).when(F.col("status") == "pending", 1).otherwise(0)
    worst = states.groupBy(F.col("rule_id").alias("id")).agg(F.max(order).alias("worst"), F.count_if(F.col("status") == "firing").alias("firing"))
    status = F.element_at(F.array(F.lit("ok"), F.lit("pending"), F.lit("firing")), F.coalesce("worst", F.lit(0)) + 1)
    return rules.select("id", "name").join(worst, "id", "left").select("id", "name", status.alias("status"), F.coalesce("firing", F.lit(0)).cast("long").alias("firing"))


def latest_events(events: DataFrame, limit: int = EVENTS) -> DataFrame:
    """The newest events; ``limit`` from 1 to 1000."""
    return events.orderBy(F.desc("at"), "rule_id", "group", "event").limit(max(1, min(limit, MOST_EVENTS)))


__all__ = [
    "alert_backtest", "alert_transition", "backtest_events", "breached", "latest_events", "log_rule_ticks", "log_rule_values", "metric_rule_values", "preview", "rule_hits", "rule_status", "tick_slot",
]
