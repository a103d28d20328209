"""Queries over alert rules, evaluated on the derived signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts
from ..schema import NANOS, RULES_DDL
from ..sources import derived
from .metric_queries import GROWN, histogram_sql, percentile_sql, rate_sql
from .registry import D20, DAY, FEB, HOUR, JAN, query
from .views import LOGS, POINTS

#: Rules of the queries: counts of error logs in two days, by service, and fewer than a number; a percentile by type; and one that is off.
RULES = [
    ("errors", "Errors", "logs", "", "", {}, [("level", "error", False)], [], ">", 50.0, 172800, 0, [], True),
    ("by-service", "Purchases by service", "logs", "", "", {}, [("event.type", "purchase", False)], ["service.name"], ">=", 12.0, 172800, 43200, [], True),
    ("quiet", "Hardly any log", "logs", "", "", {}, [("", "no such text", False)], [], "<", 1.0, 3600, 0, [], True),
    ("not-prod", "Outside production", "logs", "", "", {}, [("deployment.environment.name", "prod", True), ("level", "warn,error", False)], ["level"], "<=", 60.0, 259200, 0, [], True),
    ("size", "Large events", "metrics", "event.size", "p95", {}, [], ["event.type"], ">", 90.0, 86400, 60, [], True),
    ("off", "Switched off", "logs", "", "", {}, [], [], ">", 0.0, 3600, 0, [], False),
]
NOW = D20


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULES_DDL)


def _window(seconds: int) -> str:
    return f"t >= {NOW - seconds * NANOS} AND t < {NOW}"


_VALUES = f"""vals AS (
        SELECT 'errors' AS rule_id, '' AS "group", CAST(count(*) AS DOUBLE) AS value FROM logs WHERE {_window(172800)} AND severity_text = 'ERROR' UNION ALL
        SELECT 'by-service', 'service.name=' || service_name, CAST(count(*) AS DOUBLE) FROM logs WHERE {_window(172800)} AND event_type = 'purchase' GROUP BY service_name UNION ALL
        SELECT 'quiet', '', 0.0 UNION ALL
        SELECT 'not-prod', 'level=' || level, CAST(count(*) AS DOUBLE) FROM logs WHERE {_window(259200)} AND env <> 'prod' AND severity_text IN ('WARN', 'ERROR') GROUP BY level
    )"""
_OPS = "(VALUES ('errors', '>', 50.0, 0), ('by-service', '>=', 12.0, 43200), ('quiet', '<', 1.0, 0), ('not-prod', '<=', 60.0, 0)) AS r(id, op, threshold, hold)"
_HIGH = "CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold ELSE value <= threshold END"


def _values(spark: SparkSession, sf_dir: str, now: int = NOW) -> DataFrame:
    return alerts.log_rule_values(derived.logs(spark, sf_dir), rules(spark), now)


@query("alert_log_values", f"WITH {LOGS}, {_VALUES} SELECT * FROM vals")
def alert_log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir)


_DAY_BEFORE = NOW - DAY
_METRICS = f"""WITH {POINTS}, rated AS (WITH {rate_sql('sum', GROWN, _DAY_BEFORE, NOW, DAY)}),
    shaped AS (WITH {histogram_sql(_DAY_BEFORE, NOW, DAY)}, {percentile_sql(95, _DAY_BEFORE, DAY)})
    SELECT 'cents' AS rule_id, 'service.name=' || "service.name" AS "group", value FROM rated UNION ALL SELECT 'size', 'event.type=' || "event.type", value FROM shaped"""


@query("alert_metric_values", _METRICS)
def alert_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [{"id": r[0], "metric": r[3], "agg": r[4], "filters": r[5], "group_by": r[7], "window_seconds": r[10]} for r in RULES if r[2] == "metrics"]
    own.append({"id": "cents", "metric": "event.cents", "agg": "", "filters": {}, "group_by": ["service.name"], "window_seconds": 86400})
    return alerts.metric_rule_values(derived.metric_points(spark, sf_dir), own, NOW).withColumn("value", F.round("value", 6))


@query("alert_preview", f"""WITH {LOGS}, {_VALUES} SELECT rule_id, "group", value, op, threshold, {_HIGH} AS breached FROM vals JOIN {_OPS} ON r.id = vals.rule_id""")
def alert_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.preview(_values(spark, sf_dir), rules(spark))


@query("alert_breach", f"""WITH {LOGS} SELECT op, count(*) FILTER (CASE op WHEN '>' THEN severity_number > 9 WHEN '>=' THEN severity_number >= 9 WHEN '<' THEN severity_number < 9
    WHEN '<=' THEN severity_number <= 9 ELSE FALSE END) AS breached, count(*) AS logs FROM logs, (VALUES ('>'), ('>='), ('<'), ('<='), ('=')) AS o(op) GROUP BY op""")
def alert_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.explode(F.array(*map(F.lit, (">", ">=", "<", "<=", "="))))
    rows = derived.logs(spark, sf_dir).select("severity_number", ops.alias("op"))
    return rows.groupBy("op").agg(F.count_if(alerts.breached(F.col("severity_number"), F.col("op"), F.lit(9))).alias("breached"), F.count(F.lit(1)).alias("logs"))


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that an evaluation two days earlier leaves when nothing was known before, and one of a group that has gone."""
    none = spark.createDataFrame([("by-service", "service.name=gone", "firing", 5, 3.0)], "rule_id string, `group` string, status string, since long, value double")
    before = alerts.alert_transition(rules(spark), none.limit(0), _values(spark, sf_dir, NOW - 2 * DAY), NOW - 2 * DAY)
    return before.filter("status is not null").select("rule_id", "group", "status", "since", "value").unionByName(none)



def _at(now: int) -> str:
    """The values of all log rules at a time."""
    high = lambda seconds: f"t >= {now - seconds * NANOS} AND t < {now}"
    return f"""SELECT 'errors' AS rule_id, '' AS "group", CAST(count(*) AS DOUBLE) AS value FROM logs WHERE {high(172800)} AND severity_text = 'ERROR' UNION ALL
        SELECT 'by-service', 'service.name=' || service_name, CAST(count(*) AS DOUBLE) FROM logs WHERE {high(172800)} AND event_type = 'purchase' GROUP BY service_name UNION ALL
        SELECT 'quiet', '', 0.0 UNION ALL
        SELECT 'not-prod', 'level=' || level, CAST(count(*) AS DOUBLE) FROM logs WHERE {high(259200)} AND env <> 'prod' AND severity_text IN ('WARN', 'ERROR') GROUP BY level"""


_MOVED = f"""WITH {LOGS}, early AS (
        SELECT rule_id, "group", value, CASE WHEN NOT {_HIGH} THEN 'ok' WHEN hold > 0 THEN 'pending' ELSE 'firing' END AS was, {NOW - 2 * DAY} AS was_since
        FROM ({_at(NOW - 2 * DAY)}) e JOIN {_OPS} ON r.id = e.rule_id
        UNION ALL SELECT 'by-service', 'service.name=gone', 3.0, 'firing', 5
    ), late AS (SELECT rule_id, "group", value, {_HIGH} AS high, hold FROM ({_at(NOW)}) v JOIN {_OPS} ON r.id = v.rule_id),
    merged AS (
        SELECT coalesce(l.rule_id, e.rule_id) AS rule_id, coalesce(l."group", e."group") AS "group", l.value, e.value AS was_value, coalesce(was, 'none') AS was, was_since,
               CASE WHEN l.value IS NULL THEN NULL WHEN NOT high THEN 'ok' WHEN was = 'firing' THEN 'firing' WHEN was = 'pending' AND {NOW} - was_since >= CAST(hold AS BIGINT) * 1000000000 THEN 'firing'
                    WHEN hold > 0 THEN 'pending' ELSE 'firing' END AS status
        FROM late l FULL OUTER JOIN early e ON e.rule_id = l.rule_id AND e."group" = l."group"
    ), moved AS (
        SELECT *, CASE WHEN status = 'firing' AND was <> 'firing' THEN 'firing' WHEN was = 'firing' AND coalesce(status, '') <> 'firing' THEN 'resolved' END AS event FROM merged
    ), transitions AS (
        SELECT rule_id, "group", status, CASE WHEN status = was THEN was_since WHEN status IS NOT NULL THEN {NOW} END AS since, value, event,
               CASE WHEN event IS NOT NULL THEN coalesce(value, was_value) END AS event_value FROM moved
    )"""


@query("alert_transition", f"{_MOVED} SELECT * FROM transitions")
def alert_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_transition(rules(spark), _previous(spark, sf_dir), _values(spark, sf_dir), NOW)


_NAMES = ", ".join(f"('{r[0]}', '{r[1]}')" for r in RULES)


@query("alert_rule_status", f"""{_MOVED} SELECT n.id, n.name, CASE WHEN bool_or(coalesce(status, '') = 'firing') THEN 'firing' WHEN bool_or(coalesce(status, '') = 'pending') THEN 'pending' ELSE 'ok' END AS status,
    count(*) FILTER (status = 'firing') AS firing FROM (VALUES {_NAMES}) AS n(id, name) LEFT JOIN transitions t ON t.rule_id = n.id GROUP BY n.id, n.name""")
def alert_rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = alert_transition(spark, sf_dir).filter("status is not null")
    return alerts.rule_status(rules(spark), states)


def alert_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error logs per service and six hours, as values of the rule ``by-service``."""
    rows = derived.logs(spark, sf_dir).filter((F.col("severity_text") == "ERROR") & (F.col("time_unix_nano") >= JAN) & (F.col("time_unix_nano") < FEB))
    tick = F.expr(f"{JAN}L + ((time_unix_nano - {JAN}L) div {6 * HOUR}L + 1) * {6 * HOUR}L")
    return rows.groupBy(F.lit("by-service").alias("rule_id"), F.col("service_name").alias("group"), tick.alias("tick")).agg(F.count(F.lit(1)).cast("double").alias("value"))


ISLANDS = f"""ticks AS (
        SELECT service_name AS grp, {JAN} + ((t - {JAN}) // {6 * HOUR} + 1) * {6 * HOUR} AS tick, CAST(count(*) AS DOUBLE) AS value
        FROM logs WHERE severity_text = 'ERROR' AND t >= {JAN} AND t < {FEB} GROUP BY 1, 2
    ), marked AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY grp ORDER BY tick) = {6 * HOUR} THEN 0 ELSE 1 END AS b FROM ticks WHERE value >= 5),
    numbered AS (SELECT *, sum(b) OVER (PARTITION BY grp ORDER BY tick) AS island FROM marked),
    begun AS (SELECT *, min(tick) OVER (PARTITION BY grp, island) AS begin FROM numbered),
    fired AS (SELECT grp, island, min(tick) FILTER (tick - begin >= {12 * HOUR}) AS fired_at, max(tick) AS last FROM begun GROUP BY grp, island)"""
_FIRED = f"SELECT 'by-service' AS rule_id, grp AS \"group\", fired_at, CASE WHEN last < (SELECT max(tick) FROM ticks) THEN last + {6 * HOUR} END AS resolved_at FROM fired WHERE fired_at IS NOT NULL"


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules(spark).filter("id = 'by-service'").withColumn("threshold", F.lit(5.0))
    return alerts.alert_backtest(own, alert_ticks(spark, sf_dir), 6 * HOUR)


@query("alert_backtest", f"WITH {LOGS}, {ISLANDS} {_FIRED}")
def alert_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir)


@query("alert_events_latest", f"""WITH {LOGS}, {ISLANDS}, tested AS ({_FIRED}), happened AS (
        SELECT rule_id, "group", 'firing' AS event, fired_at AS "at" FROM tested UNION ALL SELECT rule_id, "group", 'resolved', resolved_at FROM tested WHERE resolved_at IS NOT NULL
    ) SELECT * FROM happened ORDER BY "at" DESC, rule_id, "group", event LIMIT 50""")
def alert_events_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.explode(F.array(F.struct(F.lit("firing").alias("event"), F.col("fired_at").alias("at")), F.struct(F.lit("resolved").alias("event"), F.col("resolved_at").alias("at"))))
    return alerts.latest_events(_tested(spark, sf_dir).select("rule_id", "group", event.alias("e")).select("rule_id", "group", "e.event", "e.at").filter("at is not null"))


