"""Queries over spans: services, traces, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import insights, services, traces
from ..operators.iteration import cut
from ..sources import derived
from .log_queries import RANKED, issues_sql, shown
from .registry import DAY, FEB, HOUR, JAN, MID96, TURN_FROM, TURN_TO, Y96, Y97, ns, query
from .views import LOGS, SPANS

_ENTRY = "(kind IN ('Server', 'Consumer') OR parent_span_id = '')"
_FAILED = "count(*) FILTER (status_code = 'Error') AS errors"


def _ms(q: float, name: str) -> str:
    return f"round(quantile_cont(d, {q}), 3) / 1000000.0 AS {name}"


_P = ", ".join(_ms(q, n) for q, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")))
_YEAR = f"t >= {Y96} AND t < {Y97}"


def services_sql(low: int, high: int) -> str:
    return f"""SELECT service_name, count(*) AS requests, {_FAILED}, {_P}, count(*) FILTER (status_code = 'Error') / count(*) AS error_rate,
        count(*) / {(high - low) / 1e9!r} AS rate FROM spans WHERE t >= {low} AND t < {high} AND {_ENTRY} GROUP BY service_name"""


@query("services_red", f"WITH {SPANS} {services_sql(Y96, Y97)}")
def services_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.services(derived.spans(spark, sf_dir), Y96, Y97)


#: A range that begins and ends within an hour.
_IN_HOURS = (Y96 + 1234567 * 10**9, Y97 - 987654 * 10**9)


@query("services_red_hours", f"WITH {SPANS} {services_sql(*_IN_HOURS)}")
def services_red_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures from kept counts by hour, with spans at the ends and where the ranks lie."""
    spans = derived.spans(spark, sf_dir)
    return services.services_from_hours(cut(services.latency_hours(spans)), spans, *_IN_HOURS)


@query("service_timeline", f"""WITH {SPANS} SELECT {Y96} + ((t - {Y96}) // {7 * DAY}) * {7 * DAY} AS bucket_start, count(*) AS requests, {_FAILED}, {_P}, count(*) / 604800.0 AS rate
    FROM spans WHERE {_YEAR} AND {_ENTRY} AND service_name = 'supplier-3' GROUP BY 1""")
def service_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_timeline(derived.spans(spark, sf_dir), "supplier-3", Y96, Y97, 7 * DAY)


@query("service_operations", f"""WITH {SPANS} SELECT name, count(*) AS requests, {_FAILED}, {_ms(0.5, 'p50_ms')}, {_ms(0.95, 'p95_ms')}
    FROM spans WHERE {_YEAR} AND {_ENTRY} AND service_name = 'supplier-3' GROUP BY name ORDER BY requests DESC, name LIMIT 50""")
def service_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_operations(derived.spans(spark, sf_dir), "supplier-3", Y96, Y97)


def _edges(where: str = "TRUE") -> str:
    return f"""WITH {SPANS}, ranged AS (SELECT * FROM spans WHERE {_YEAR}), edges AS (
        SELECT p.service_name AS from_service, c.service_name AS to_service, count(*) AS requests, count(*) FILTER (c.status_code = 'Error') AS errors
        FROM ranged c JOIN ranged p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
        WHERE c.parent_span_id <> '' AND p.service_name <> c.service_name GROUP BY 1, 2) SELECT * FROM edges WHERE {where}"""


@query("service_map", _edges())
def service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_map(derived.spans(spark, sf_dir), Y96, Y97)


@query("service_calls", _edges("from_service = 'supplier-3'"))
def service_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_calls(service_map(spark, sf_dir), "supplier-3")


@query("service_called_by", _edges("to_service = 'supplier-3'"))
def service_called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_called_by(service_map(spark, sf_dir), "supplier-3")


_HEALTH = f"""now AS ({services_sql(MID96, Y97)}), before AS ({services_sql(Y96, MID96)}), rated AS (
        SELECT now.*, before.p95_ms AS before_p95_ms,
               CASE WHEN now.error_rate >= 0.05 THEN 2 WHEN now.error_rate >= 0.01 THEN 1 ELSE 0 END AS e,
               CASE WHEN now.p95_ms >= 200 AND before.p95_ms > 0 AND now.p95_ms / before.p95_ms >= 2 THEN 2
                    WHEN now.p95_ms >= 200 AND before.p95_ms > 0 AND now.p95_ms / before.p95_ms >= 1.5 THEN 1 ELSE 0 END AS l
        FROM now LEFT JOIN before ON before.service_name = now.service_name
    ), health AS (SELECT * EXCLUDE (e, l), CASE greatest(e, l) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status,
           concat_ws(',', CASE WHEN e > 0 THEN 'errors' END, CASE WHEN l > 0 THEN 'latency' END) AS reasons FROM rated)"""


@query("service_health", f"WITH {SPANS}, {_HEALTH} SELECT * FROM health")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = derived.spans(spark, sf_dir)
    return services.service_health(services.services(spans, MID96, Y97), services.services(spans, Y96, MID96))


_DEPLOYED = f"""first_seen AS (
        SELECT service_name, version, min(t) AS "at" FROM spans WHERE t >= {TURN_FROM - 10 * DAY} AND t < {TURN_TO} GROUP BY 1, 2
    ), lagged AS (SELECT *, lag(version) OVER (PARTITION BY service_name ORDER BY "at", version) AS previous FROM first_seen),
    deployed AS (SELECT service_name, version, previous, "at" FROM lagged WHERE "at" >= {TURN_FROM} AND previous <> '' AND previous <> version)"""


@query("deployments", f"WITH {SPANS}, {_DEPLOYED} SELECT * FROM deployed")
def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.deployments(derived.spans(spark, sf_dir), TURN_FROM, TURN_TO, 10 * DAY).select("service_name", "version", "previous", "at")


@query("filter_span_status", f"WITH {SPANS} SELECT service_name, count(*) AS spans FROM spans WHERE status_code IN ('Error', 'Ok') GROUP BY service_name")
def filter_span_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.spans(spark, sf_dir).filter(P.status_in(["error", "ok"])).groupBy("service_name").agg(F.count(F.lit(1)).alias("spans"))


def _search(having: str, limit: int) -> str:
    return f"""WITH {SPANS}, found AS (
        SELECT trace_id, coalesce(arg_min(service_name, t) FILTER (parent_span_id = ''), arg_min(service_name, t)) AS root_service,
               coalesce(arg_min(name, t) FILTER (parent_span_id = ''), arg_min(name, t)) AS root_name, min(t) AS start, max(t + d) - min(t) AS duration, count(*) AS spans,
               {_FAILED}, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services FROM spans WHERE {_YEAR} GROUP BY trace_id HAVING {having})
        SELECT * FROM found ORDER BY start DESC, trace_id LIMIT {limit}"""


def _searched(name: str, having: str, limit: int = 50, **options: object) -> None:
    @query(name, _search(having, limit))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = traces.search_traces(derived.spans(spark, sf_dir), Y96, Y97, limit=limit, **options)
        return found.withColumn("services", F.array_join("services", ","))


_searched("trace_search", "TRUE")
_searched("trace_search_errors", "bool_or(status_code = 'Error')", errors_only=True)
_searched("trace_search_slow", "max(t + d) - min(t) >= 400000000", min_duration_ns=400_000_000)
_searched("trace_search_service", "bool_or(service_name = 'supplier-3')", 200, service="supplier-3")
_searched("trace_search_query", "bool_or((k1 = 'line.flag' AND v1 = 'R' OR k2 = 'line.flag' AND v2 = 'R') AND contains(name, 'rf') OR (v2 = 'R' AND contains(lower(name), 'rf')))", terms=[("line.flag", "R", False), ("", "RF", False)])


@query("trace_by_id", f"""WITH {SPANS} SELECT trace_id, span_id, parent_span_id, name, kind, t AS start_time_unix_nano, t + d AS end_time_unix_nano, d AS duration_nano,
    status_code, status_message, service_name FROM spans WHERE trace_id = '42' """)
def trace_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace(derived.spans(spark, sf_dir), "42").select(traces.SPAN[:11])


@query("trace_stats", f"WITH {SPANS} SELECT trace_id, count(DISTINCT service_name) AS services, count(*) AS spans, {_FAILED}, max(t + d) - min(t) AS duration FROM spans GROUP BY trace_id")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_stats(derived.spans(spark, sf_dir))


@query("trace_logs", f"""WITH {SPANS}, {LOGS}, moved AS (SELECT t + (CAST(trace_id AS BIGINT) * 0 + {JAN}) - {JAN} AS t, trace_id, t AS own FROM spans),
    bounds AS (SELECT trace_id, {JAN} + CAST(trace_id AS BIGINT) * {HOUR // 10} - {DAY} AS low, {JAN} + CAST(trace_id AS BIGINT) * {HOUR // 10} + {4 * DAY} AS high
               FROM spans WHERE span_id = '0'),
    ranked AS (SELECT l.trace_id, l.span_id, l.t AS time_unix_nano, row_number() OVER (PARTITION BY l.trace_id ORDER BY l.t DESC, l.span_id, l.body) AS place
               FROM logs l JOIN bounds b ON b.trace_id = l.trace_id WHERE l.trace_id <> '' AND l.t >= b.low AND l.t < b.high)
    SELECT trace_id, span_id, time_unix_nano, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 200""")
def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the spans of the orders, moved to the month of the logs
    roots = derived.spans(spark, sf_dir).filter("span_id = '0'")
    start = F.lit(JAN).cast("long") + F.col("trace_id").cast("long") * (HOUR // 10)
    moved = roots.withColumn("start_time_unix_nano", start).withColumn("end_time_unix_nano", start + 3 * DAY)
    return traces.trace_logs(moved, derived.logs(spark, sf_dir), DAY).select("trace_id", "span_id", "time_unix_nano", "place")


#: From every span down to all spans beneath it, and those that have an error beneath them.
UP = """paths AS (
        SELECT trace_id, span_id AS top, span_id AS foot FROM scope
        UNION
        SELECT child.trace_id, paths.top, child.span_id FROM scope AS child, paths WHERE paths.trace_id = child.trace_id AND paths.foot = child.parent_span_id
    ), up AS (
        SELECT DISTINCT trace_id, top AS ancestor FROM paths WHERE top <> foot AND (trace_id, foot) IN (SELECT (trace_id, span_id) FROM scope WHERE status_code = 'Error')
    )"""


@query("error_ancestors", f"WITH RECURSIVE {SPANS}, scope AS (SELECT * FROM spans), {UP} SELECT trace_id, ancestor FROM up")
def error_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.error_ancestors(derived.spans(spark, sf_dir))


ORIGIN = "status_code = 'Error' AND (trace_id, span_id) NOT IN (SELECT (trace_id, ancestor) FROM up)"


@query("error_origins", f"WITH RECURSIVE {SPANS}, scope AS (SELECT * FROM spans), {UP} SELECT trace_id, span_id, service_name, name FROM scope WHERE {ORIGIN}")
def error_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.error_origins(derived.spans(spark, sf_dir)).select("trace_id", "span_id", "service_name", "name")


_TITLED = f"SELECT service_name, t, CASE WHEN status_message = '' THEN name ELSE name || ': ' || status_message END AS title, trace_id FROM scope WHERE {ORIGIN}"
_HALVES = f"scope AS (SELECT * FROM spans WHERE t >= {2 * MID96 - Y97} AND t < {Y97})"
_SPAN_ISSUES = issues_sql(_TITLED, "span", f"SELECT 1 FROM spans WHERE t >= {2 * MID96 - Y97} AND t < {MID96}", MID96, Y97)


@query("issues_spans", f"WITH RECURSIVE {SPANS}, {_HALVES}, {UP}, {_SPAN_ISSUES}")
def issues_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(insights.span_issues(derived.spans(spark, sf_dir), MID96, Y97))


_LATE = ns("1998-01-01")
_FAILED_LOGS = f"SELECT service_name, t, body AS title, trace_id FROM logs WHERE t >= {2 * _LATE - FEB} AND t < {FEB} AND upper(severity_text) IN ('ERROR', 'FATAL')"


@query("issues", f"""WITH RECURSIVE {SPANS}, {LOGS}, scope AS (SELECT * FROM spans WHERE t >= {2 * _LATE - FEB} AND t < {FEB}), {UP},
    of_spans AS (WITH {issues_sql(_TITLED, "span", f"SELECT 1 FROM spans WHERE t >= {2 * _LATE - FEB} AND t < {_LATE}", _LATE, FEB)}),
    of_logs AS (WITH {issues_sql(_FAILED_LOGS, "log", f"SELECT 1 FROM logs WHERE t >= {2 * _LATE - FEB} AND t < {_LATE}", _LATE, FEB)})
    SELECT * FROM of_spans UNION ALL SELECT * FROM of_logs""")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both signals: the range reaches from late spans to the month of the logs."""
    return shown(insights.issues(derived.logs(spark, sf_dir), derived.spans(spark, sf_dir), _LATE, FEB))


_PAIRS = """pairs AS (
        SELECT chosen, k1 AS key, v1 AS value FROM sel UNION ALL SELECT chosen, k2, v2 FROM sel UNION ALL SELECT chosen, 'service.name', service_name FROM sel UNION ALL
        SELECT chosen, 'service.version', version FROM sel UNION ALL SELECT chosen, 'span.name', name FROM sel
    ), totals AS (SELECT count(*) FILTER (chosen) AS selection, count(*) FILTER (NOT chosen) AS baseline FROM sel),
    counted AS (SELECT key, value, count(*) FILTER (chosen) AS selected, count(*) FILTER (NOT chosen) AS others FROM pairs GROUP BY key, value)"""
_ERR_SEL = f"sel AS (SELECT *, status_code = 'Error' AS chosen FROM spans WHERE {_YEAR})"


@query("compare_counts", f"WITH {SPANS}, {_ERR_SEL}, {_PAIRS} SELECT * FROM counted")
def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = derived.spans(spark, sf_dir).filter((F.col("start_time_unix_nano") >= Y96) & (F.col("start_time_unix_nano") < Y97))
    return insights.compare_counts(year.withColumn("chosen", P.span_is_error()), "spans")


@query("compare_errors_spans", f"WITH {SPANS}, {_ERR_SEL}, {_PAIRS} {RANKED}")
def compare_errors_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.compare(derived.spans(spark, sf_dir), "spans", Y96, Y97, errors=True)


@query("compare_window", f"""WITH {SPANS}, sel AS (SELECT *, t >= {TURN_FROM} AND t < {TURN_FROM + 10 * DAY} AS chosen FROM spans WHERE t >= {TURN_FROM} AND t < {TURN_TO}), {_PAIRS} {RANKED}""")
def compare_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.compare(derived.spans(spark, sf_dir), "spans", TURN_FROM, TURN_TO, window=(TURN_FROM, TURN_FROM + 10 * DAY))


@query("trace_waterfall", f"""WITH RECURSIVE {SPANS}, walk AS (
        SELECT trace_id, span_id, [t, CAST(span_id AS BIGINT)] AS path, 0 AS depth FROM spans WHERE parent_span_id = ''
        UNION ALL
        SELECT c.trace_id, c.span_id, list_concat(w.path, [c.t, CAST(c.span_id AS BIGINT)]), w.depth + 1 FROM walk w JOIN spans c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id
    ), whole AS (SELECT trace_id, min(t) AS begin, greatest(max(t + d) - min(t), 1) AS total FROM spans GROUP BY trace_id),
    parents AS (SELECT DISTINCT trace_id, parent_span_id FROM spans)
    SELECT s.trace_id, CAST(row_number() OVER (PARTITION BY s.trace_id ORDER BY w.path) AS INTEGER) AS place, s.span_id, s.service_name, s.name, s.status_code, w.depth,
           (s.t - whole.begin) / whole.total AS "offset", greatest(s.d / whole.total, 0.002) AS width, p.parent_span_id IS NOT NULL AS has_children
    FROM spans s JOIN walk w ON w.trace_id = s.trace_id AND w.span_id = s.span_id JOIN whole ON whole.trace_id = s.trace_id
    LEFT JOIN parents p ON p.trace_id = s.trace_id AND p.parent_span_id = s.span_id""")
def trace_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.waterfall(derived.spans(spark, sf_dir))


@query("red_metrics", f"""WITH {SPANS} SELECT service_name, name, {Y96} + ((t - {Y96}) // {30 * DAY}) * {30 * DAY} AS bucket_start, count(*) AS requests, {_FAILED},
    CAST(sum(d) AS BIGINT) AS total_nano FROM spans WHERE {_YEAR} AND {_ENTRY} GROUP BY ALL""")
def red_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = services.entries(derived.spans(spark, sf_dir), Y96, Y97)
    start = F.expr(f"{Y96}L + ((start_time_unix_nano - {Y96}L) div {30 * DAY}L) * {30 * DAY}L")
    return rows.groupBy("service_name", "name", start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(P.span_is_error()).alias("errors"), F.sum("duration_nano").alias("total_nano")
    )


@query("overview", f"""WITH RECURSIVE {SPANS}, {_HALVES}, {UP}, {_HEALTH}, {_DEPLOYED}, found AS (WITH {_SPAN_ISSUES})
    SELECT (SELECT count(*) FROM health WHERE status <> 'ok') AS unhealthy, (SELECT count(*) FROM found WHERE status <> 'ongoing') AS issues,
           (SELECT count(*) FROM deployed) AS deployments""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    unhealthy = number(service_health(spark, sf_dir).filter("status <> 'ok'"), "unhealthy")
    new = number(issues_spans(spark, sf_dir).filter("status <> 'ongoing'"), "issues")
    return unhealthy.crossJoin(new).crossJoin(number(deployments(spark, sf_dir), "deployments"))  # one row each
