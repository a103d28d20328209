"""Queries over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import longest_literal, message_template
from ..operators import insights, logs
from ..sources import derived
from .registry import D10, D20, FEB, HOUR, JAN, query
from .views import LOGS

_COUNT = f"WITH {LOGS} SELECT service_name, count(*) AS logs FROM logs WHERE "


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("service_name").agg(F.count(F.lit(1)).alias("logs"))


def _filtered(name: str, predicate, where: str) -> None:  # noqa: ANN001
    @query(name, f"{_COUNT} {where} GROUP BY service_name")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(derived.logs(spark, sf_dir).filter(predicate()))


_filtered("filter_service", lambda: P.service_is("svc-1"), "service_name = 'svc-1'")
_filtered("filter_level", lambda: P.level_in(["error", "debug"]), "upper(severity_text) IN ('ERROR', 'DEBUG')")
_filtered("filter_trace_id", lambda: P.trace_is("7"), "trace_id = '7'")
_filtered("filter_attribute", lambda: P.attribute_is("deployment.environment.name", "prod"), "env = 'prod'")
_filtered("filter_text", lambda: P.text_has("USER 12", "body"), "contains(lower(body), 'user 12') OR contains(lower(concat_ws(' ', event_type, k)), 'user 12')")
_filtered("filter_negated", lambda: P.log_filter([("k", "7", True)]), "NOT (k = '7')")
_filtered(
    "filter_conjunction",
    lambda: P.log_filter([("level", "error,warn", False), ("event.type", "error", False), ("deployment.environment.name", "prod", True), ("", "value", False)]),
    "upper(severity_text) IN ('ERROR', 'WARN') AND event_type = 'error' AND NOT (env = 'prod') AND contains(body, 'value')",
)


@query("search_logs", f"""WITH {LOGS} SELECT t AS time_unix_nano, service_name, severity_number, severity_text, body, trace_id, span_id, event_type, coalesce(k, '') AS k
    FROM logs WHERE t >= {JAN} AND t < {FEB} AND upper(severity_text) = 'ERROR' ORDER BY t DESC, span_id, body LIMIT 100""")
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.search_logs(derived.logs(spark, sf_dir), [("level", "error", False)], JAN, FEB)
    shown = [F.col("attributes")["event.type"].alias("event_type"), F.coalesce(F.col("attributes")["k"], F.lit("")).alias("k")]
    return found.select(*logs.RECORD[:6], "span_id", *shown)


@query("search_logs_text", f"""WITH {LOGS} SELECT t AS time_unix_nano, span_id, body FROM logs
    WHERE t >= {JAN} AND t < {FEB} AND (contains(lower(body), 'purchase') OR contains(lower(concat_ws(' ', event_type, k)), 'purchase'))
    ORDER BY t DESC, span_id, body LIMIT 100""")
def search_logs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.search_logs(derived.logs(spark, sf_dir), [("", "Purchase", False)], JAN, FEB).select("time_unix_nano", "span_id", "body")


@query("log_histogram", f"""WITH {LOGS} SELECT {JAN} + ((t - {JAN}) // {12 * HOUR}) * {12 * HOUR} AS bucket_start, level, count(*) AS logs
    FROM logs WHERE t >= {JAN} AND t < {FEB} GROUP BY ALL""")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_histogram(derived.logs(spark, sf_dir), [], JAN, FEB, 12 * HOUR)


@query("count_logs_total", f"WITH {LOGS} SELECT count(*) AS logs FROM logs WHERE t >= {D10} AND t < {D20} AND env = 'staging'")
def count_logs_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.count_logs(derived.logs(spark, sf_dir), [("deployment.environment.name", "staging", False)], D10, D20)


@query("count_logs_by", f"""WITH {LOGS} SELECT level, service_name AS "service.name", coalesce(k, '') AS k, count(*) AS logs
    FROM logs WHERE t >= {D10} AND t < {D20} GROUP BY ALL""")
def count_logs_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.count_logs(derived.logs(spark, sf_dir), [], D10, D20, ["level", "service.name", "k"])


@query("log_facet", f"""WITH {LOGS}, pairs AS (
        SELECT 'level' AS key, level AS value FROM logs WHERE t >= {JAN} AND t < {FEB} UNION ALL
        SELECT 'service.name', service_name FROM logs WHERE t >= {JAN} AND t < {FEB} UNION ALL
        SELECT 'k', coalesce(k, '') FROM logs WHERE t >= {JAN} AND t < {FEB}
    ), ranked AS (SELECT key, value, count(*) AS logs, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS place FROM pairs GROUP BY key, value)
    SELECT key, value, logs, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 20""")
def log_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_facet(derived.logs(spark, sf_dir), [], JAN, FEB, ["level", "service.name", "k"])


_TEMPLATE = "regexp_replace(body, '[0-9a-fA-F]{8,}|[0-9]+(?:\\.[0-9]+)?', '<*>', 'g')"


@query("log_patterns", f"""WITH {LOGS} SELECT {_TEMPLATE} AS template, count(*) AS logs, count(DISTINCT service_name) AS services
    FROM logs WHERE t >= {JAN} AND t < {FEB} GROUP BY 1 ORDER BY logs DESC, template LIMIT 50""")
def log_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.log_patterns(derived.logs(spark, sf_dir), JAN, FEB)


@query("issue_literal", f"""WITH {LOGS} SELECT DISTINCT {_TEMPLATE} AS template, event_type || ' user' AS literal FROM logs""")
def issue_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = derived.logs(spark, sf_dir).select(message_template(F.col("body")).alias("template")).distinct()
    return templates.withColumn("literal", longest_literal(F.col("template")))


_PAIRS = """pairs AS (
        SELECT chosen, 'event.type' AS key, event_type AS value FROM sel UNION ALL SELECT chosen, 'k', k FROM sel WHERE k IS NOT NULL UNION ALL
        SELECT chosen, 'service.name', service_name FROM sel UNION ALL SELECT chosen, 'deployment.environment.name', env FROM sel
    ), totals AS (SELECT count(*) FILTER (chosen) AS selection, count(*) FILTER (NOT chosen) AS baseline FROM sel),
    counted AS (SELECT key, value, count(*) FILTER (chosen) AS selected, count(*) FILTER (NOT chosen) AS others FROM pairs GROUP BY key, value)"""
RANKED = """SELECT key, value, selected, others, selection, baseline, selected / selection AS share, others / baseline AS base_share FROM counted, totals
    WHERE selection > 0 AND selected / selection >= 0.2 AND selected / selection - others / baseline >= 0.1
    ORDER BY share - base_share DESC, key = 'service.name' DESC, key, value LIMIT 12"""


@query("compare_errors_logs", f"""WITH {LOGS}, sel AS (SELECT *, upper(severity_text) IN ('ERROR', 'FATAL') AS chosen FROM logs WHERE t >= {JAN} AND t < {FEB}), {_PAIRS} {RANKED}""")
def compare_errors_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.compare(derived.logs(spark, sf_dir), "logs", JAN, FEB, errors=True)


def issues_sql(rows: str, kind: str, history: str, from_ns: int, to_ns: int) -> str:
    """The issues of ``rows`` (service_name, t, title, trace_id), with buckets as text."""
    step = (to_ns - from_ns) // 24
    slots = " || ',' || ".join(f"CAST(count(*) FILTER (t >= {from_ns} AND least((t - {from_ns}) // {step}, 23) = {k}) AS VARCHAR)" for k in range(24))
    return f"""templated AS (
        SELECT *, regexp_replace(title, '[0-9a-fA-F]{{8,}}|[0-9]+(?:\\.[0-9]+)?', '<*>', 'g') AS template FROM ({rows})
    ), counted AS (
        SELECT service_name, template, count(*) FILTER (t >= {from_ns}) AS count, count(*) FILTER (t < {from_ns}) AS previous,
               min(t) FILTER (t >= {from_ns}) AS first_seen, max(t) FILTER (t >= {from_ns}) AS last_seen, {slots} AS buckets FROM templated GROUP BY service_name, template
    ), newest AS (
        SELECT service_name, template, title, row_number() OVER (PARTITION BY service_name, template ORDER BY t DESC, title DESC, trace_id DESC) AS n
        FROM templated WHERE t >= {from_ns}
    ), traced AS (
        SELECT service_name, template, trace_id, row_number() OVER (PARTITION BY service_name, template ORDER BY t DESC, title DESC, trace_id DESC) AS n
        FROM templated WHERE t >= {from_ns} AND trace_id <> ''
    )
    SELECT substr(sha256(c.service_name || '|{kind}|' || c.template), 1, 12) AS id, c.service_name, '{kind}' AS kind, c.template, count, previous, first_seen, last_seen,
           newest.title AS example, coalesce(traced.trace_id, '') AS example_trace_id, buckets,
           CASE WHEN NOT EXISTS ({history}) THEN 'ongoing' WHEN previous = 0 THEN 'new' WHEN count >= 2 * previous THEN 'rising' ELSE 'ongoing' END AS status
    FROM counted c JOIN newest ON newest.n = 1 AND newest.service_name = c.service_name AND newest.template = c.template
    LEFT JOIN traced ON traced.n = 1 AND traced.service_name = c.service_name AND traced.template = c.template WHERE count > 0"""


def shown(found: DataFrame) -> DataFrame:
    """Issues with their buckets as text."""
    return found.withColumn("buckets", F.array_join(F.col("buckets").cast("array<string>"), ","))


_ERRORS = f"SELECT service_name, t, body AS title, trace_id FROM logs WHERE t >= {2 * D10 - D20} AND t < {D20} AND upper(severity_text) IN ('ERROR', 'FATAL')"


@query("issues_logs", f"WITH {LOGS}, {issues_sql(_ERRORS, 'log', f'SELECT 1 FROM logs WHERE t >= {2 * D10 - D20} AND t < {D10}', D10, D20)}")
def issues_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(insights.log_issues(derived.logs(spark, sf_dir), D10, D20))


