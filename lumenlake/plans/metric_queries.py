"""Queries over metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, rollups
from ..operators.iteration import cut
from ..sources import derived
from .registry import D10, D20, DAY, FEB, HOUR, JAN, query
from .views import POINTS

_STEP = 12 * HOUR
_BACK = metrics.LOOKBACK


def _start(low: int, step: int = _STEP) -> str:
    return f"{low} + n * {step} AS bucket_start"


@query("metric_catalog", f"""WITH {POINTS}, users AS (SELECT count(DISTINCT user_id) AS series FROM ev WHERE t >= {JAN} AND t < {FEB}),
    kinds AS (SELECT count(DISTINCT event_type) AS series FROM sizes WHERE t >= {JAN} AND t < {FEB})
    SELECT 'event.value' AS metric_name, 'Gauge' AS type, '1' AS unit, series, 'user.id,service.name' AS keys, FALSE AS monotonic FROM users UNION ALL
    SELECT 'event.cents', 'Sum', '1', series, 'user.id,service.name', TRUE FROM users UNION ALL
    SELECT 'event.cents.delta', 'Sum', '1', series, 'user.id,service.name', TRUE FROM users UNION ALL
    SELECT 'event.size', 'Histogram', '1', series, 'event.type,service.name', FALSE FROM kinds UNION ALL
    SELECT 'event.size.exp', 'ExponentialHistogram', '1', series, 'event.type,service.name', FALSE FROM kinds UNION ALL
    SELECT 'event.size.summary', 'Summary', '1', series, 'event.type,service.name', FALSE FROM kinds""")
def metric_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_catalog(derived.metric_points(spark, sf_dir), JAN, FEB).withColumn("keys", F.array_join("keys", ","))


def _gauge(agg: str, where: str = "TRUE") -> str:
    value = {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(*) AS DOUBLE)"}[agg]
    value = f"round({value}, 6)" if agg in ("avg", "sum") else value
    return f"""WITH {POINTS}, ranked AS (
        SELECT service_name, user_id, (t - {JAN}) // {_STEP} AS n, value, row_number() OVER (PARTITION BY user_id, (t - {JAN}) // {_STEP} ORDER BY t DESC, value DESC) AS r
        FROM ev WHERE t >= {JAN} AND t < {FEB} AND {where})
    SELECT service_name AS "service.name", {_start(JAN)}, {value} AS value FROM ranked WHERE r = 1 GROUP BY service_name, n"""


def _gauge_query(name: str, agg: str, where: str = "TRUE", filters: dict[str, str] | None = None) -> None:
    @query(name, _gauge(agg, where))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = derived.metric_points(spark, sf_dir)
        found = metrics.query_metric(points, "event.value", JAN, FEB, agg, ["service.name"], filters, _STEP)
        return found.withColumn("value", F.round("value", 6)) if agg in ("avg", "sum") else found


_gauge_query("metric_gauge", "avg")
for _agg in ("sum", "min", "max", "count"):
    _gauge_query(f"metric_reduce_{_agg}", _agg)
_gauge_query("metric_filtered", "max", "user_id = 7", {"user.id": "7"})
STEP, FILTERED = _STEP, _gauge("max", "user_id = 7")


def rate_sql(agg: str, increments: str, low: int, high: int, step: int) -> str:
    """CTEs and a statement of the rates of event.cents per service."""
    return f"""lagged AS (
        SELECT *, lag(total) OVER w AS before, lag(day) OVER w AS before_day FROM cum WHERE t >= {low - _BACK} AND t < {high} WINDOW w AS (PARTITION BY user_id ORDER BY t, day, total)
    ), grown AS (SELECT user_id, service_name, t, {increments} AS inc FROM lagged),
    summed AS (SELECT user_id, service_name, (t - {low}) // {step} AS n, sum(inc) / {step / 1e9!r} AS v FROM grown WHERE t >= {low} AND t < {high} AND inc IS NOT NULL GROUP BY ALL)
    SELECT service_name AS "service.name", {_start(low, step)}, round({agg}(v), 6) AS value FROM summed GROUP BY service_name, n"""


def _rate(agg: str, increments: str) -> str:
    return f"WITH {POINTS}, {rate_sql(agg, increments, D10, D20, _STEP)}"


GROWN = "CASE WHEN before IS NULL THEN NULL WHEN day <> before_day OR total < before THEN total ELSE total - before END"


RATE = _rate("sum", GROWN)


@query("metric_counter_rate", RATE)
def metric_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.query_metric(derived.metric_points(spark, sf_dir), "event.cents", D10, D20, None, ["service.name"], None, _STEP)
    return found.withColumn("value", F.round("value", 6))


@query("metric_delta_rate", _rate("max", "cents"))
def metric_delta_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.query_metric(derived.metric_points(spark, sf_dir), "event.cents.delta", D10, D20, "max", ["service.name"], None, _STEP)
    return found.withColumn("value", F.round("value", 6))


@query("series_prev_point", f"""WITH {POINTS} SELECT user_id AS series_id, t AS time_unix_nano, CAST(total AS DOUBLE) AS value,
    CAST(lag(total) OVER (PARTITION BY user_id ORDER BY t, day, total) AS DOUBLE) AS previous FROM cum""")
def series_prev_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name = 'event.cents'")
    return metrics.previous_points(points, "value").select("series_id", "time_unix_nano", "value", F.col("before.value").alias("previous"))


@query("counter_resets", f"""WITH {POINTS}, lagged AS (SELECT *, lag(total) OVER w AS before, lag(day) OVER w AS before_day FROM cum WINDOW w AS (PARTITION BY user_id ORDER BY t, day, total))
    SELECT user_id AS series_id, count(*) FILTER (before IS NOT NULL AND (day <> before_day OR total < before)) AS resets,
           CAST(sum({GROWN}) AS BIGINT) AS increase FROM lagged GROUP BY user_id""")
def counter_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name = 'event.cents'")
    rows = metrics.counter_increments(points)
    return rows.groupBy("series_id").agg(F.count_if("reset").alias("resets"), F.sum("increment").cast("long").alias("increase"))


_LAGS = ", ".join(f"lag(c{k}) OVER w AS b{k}" for k in range(8))
_DIFFS = ", ".join(f"CASE WHEN day = before_day AND n >= bn THEN c{k} - b{k} ELSE c{k} END AS c{k}" for k in range(8))


def histogram_sql(low: int, high: int, step: int) -> str:
    """CTEs up to ``diffed``: what each hour added to the histograms."""
    return f"""lagged AS (
        SELECT *, lag(n) OVER w AS bn, lag(cents) OVER w AS bcents, lag(day) OVER w AS before_day, {_LAGS}
        FROM sizes WHERE t >= {low - _BACK} AND t < {high} WINDOW w AS (PARTITION BY event_type ORDER BY t)
    ), diffed AS (
        SELECT event_type, (t - {low}) // {step} AS n, CASE WHEN day = before_day AND n >= bn THEN n - bn ELSE n END AS c,
               CASE WHEN day = before_day AND n >= bn THEN cents - bcents ELSE cents END AS s, {_DIFFS}
        FROM lagged WHERE bn IS NOT NULL AND t >= {low} AND t < {high}
    )"""


_HIST = f"WITH {POINTS}, {histogram_sql(D10, D20, DAY)}"
_BY_TYPE = f'SELECT event_type AS "event.type", {_start(D10, DAY)}'


def _distribution(name: str, metric: str, agg: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = metrics.query_metric(derived.metric_points(spark, sf_dir), metric, D10, D20, agg, ["event.type"], None, DAY)
        return found.withColumn("value", F.round("value", 6))


_COUNT, _AVG = "round(sum(c) / 86400.0, 6) AS value", "round(sum(s) / sum(c), 6) AS value"
_distribution("metric_histogram_count", "event.size", "count", f"{_HIST} {_BY_TYPE}, {_COUNT} FROM diffed GROUP BY event_type, n")
_distribution("metric_histogram_avg", "event.size", "avg", f"{_HIST} {_BY_TYPE}, {_AVG} FROM diffed GROUP BY event_type, n HAVING sum(c) <> 0")
_distribution("metric_exp_histogram", "event.size.exp", "avg", f"{_HIST} {_BY_TYPE}, {_AVG} FROM diffed GROUP BY event_type, n HAVING sum(c) <> 0")
_distribution(
    "metric_summary", "event.size.summary", "count",
    f"WITH {POINTS}, diffed AS (SELECT event_type, (t - {D10}) // {DAY} AS n, n AS c FROM sizes WHERE t >= {D10} AND t < {D20}) {_BY_TYPE}, {_COUNT} FROM diffed GROUP BY 1, diffed.n",
)

_EDGES = "(VALUES (0, 0.0, 1.0), (1, 1.0, 5.0), (2, 5.0, 10.0), (3, 10.0, 25.0), (4, 25.0, 50.0), (5, 50.0, 100.0), (6, 100.0, 250.0), (7, 250.0, 250.0)) AS e(slot, lo, hi)"
_SLOTS = " UNION ALL ".join(f"SELECT event_type, n, {k} AS slot, sum(c{k}) AS c FROM diffed GROUP BY event_type, n" for k in range(8))


def percentile_sql(p: int, low: int, step: int) -> str:
    """CTEs after ``diffed`` and a statement of a percentile per event type."""
    return f"""slots AS ({_SLOTS}), running AS (
        SELECT *, sum(c) OVER (PARTITION BY event_type, n ORDER BY slot) AS upto, sum(c) OVER (PARTITION BY event_type, n) AS total FROM slots
    ), hit AS (SELECT *, row_number() OVER (PARTITION BY event_type, n ORDER BY slot) AS r FROM running WHERE c > 0 AND upto >= {p / 100} * total AND total > 0)
    SELECT event_type AS "event.type", {_start(low, step)}, round(lo + (hi - lo) * (({p / 100} * total - (upto - c)) / c), 6) AS value FROM hit JOIN {_EDGES} ON e.slot = hit.slot WHERE r = 1"""


def _percentile(p: int) -> str:
    return f"{_HIST}, {percentile_sql(p, D10, DAY)}"


for _p in (50, 95, 99):
    _distribution(f"metric_histogram_p{_p}", "event.size", f"p{_p}", _percentile(_p))


_NUMBERS = f"""SELECT '{{name}}' AS metric_name, user_id AS series_id, t - t % {HOUR} AS bucket_start, count(*) AS points, min(CAST({{v}} AS DOUBLE)) AS min, max(CAST({{v}} AS DOUBLE)) AS max,
    round(sum(CAST({{v}} AS DOUBLE)), 2) AS total, arg_max(CAST({{v}} AS DOUBLE), (t, {{tie}})) AS last, {{grown}} AS grown, CAST(NULL AS BIGINT) AS "count", CAST(NULL AS DOUBLE) AS "sum", '' AS buckets
    FROM {{rows}} GROUP BY user_id, bucket_start"""
_WITHIN = f"""within AS (
        SELECT *, CASE WHEN lag(total) OVER w IS NULL THEN NULL WHEN day <> lag(day) OVER w OR total < lag(total) OVER w THEN total ELSE total - lag(total) OVER w END AS inc
        FROM cum WINDOW w AS (PARTITION BY user_id, t // {HOUR} ORDER BY t, day, total))"""
_DISTRIBUTIONS = """SELECT '{name}' AS metric_name, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS series_id, h * 3600000000000 // {step} * {step} AS bucket_start, count(*) AS points, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
    CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS grown, CAST({count} AS BIGINT) AS "count", CAST({cents} AS DOUBLE) AS "sum", {buckets} AS buckets FROM sizes GROUP BY event_type, bucket_start"""
# of a cumulative series a day's last point less its first; where there is one alone, it adds nothing
_GROWN_SLOTS = "concat_ws(',', " + ", ".join(f"CAST(max(c{k}) - min(c{k}) AS BIGINT)" for k in range(8)) + ")"


@query("metric_rollup", f"""WITH {POINTS}, {_WITHIN} {_NUMBERS.format(name="event.value", v="value", tie="value", grown="round(sum(value), 2)", rows="ev")} UNION ALL
    {_NUMBERS.format(name="event.cents.delta", v="cents", tie="cents", grown="round(sum(CAST(cents AS DOUBLE)), 2)", rows="ev")} UNION ALL
    {_NUMBERS.format(name="event.cents", v="total", tie="total", grown="round(sum(CAST(inc AS DOUBLE)), 2)", rows="within")}""")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name like 'event.value' or metric_name like 'event.cents%'")
    return _shown(rollups.rollup(points, HOUR))


@query("metric_rollup_levels", f"""WITH {POINTS} {_DISTRIBUTIONS.format(name="event.size", step=DAY, count="nullif(max(n) - min(n), CASE WHEN count(*) = 1 THEN 0 ELSE -1 END)", cents="CASE WHEN count(*) > 1 THEN max(cents) - min(cents) END", buckets=f"CASE WHEN count(*) > 1 THEN {_GROWN_SLOTS} ELSE '' END")} UNION ALL
    {_DISTRIBUTIONS.format(name="event.size.exp", step=DAY, count="nullif(max(n) - min(n), CASE WHEN count(*) = 1 THEN 0 ELSE -1 END)", cents="CASE WHEN count(*) > 1 THEN max(cents) - min(cents) END", buckets="''")} UNION ALL
    {_DISTRIBUTIONS.format(name="event.size.summary", step=DAY, count="sum(n)", cents="sum(cents)", buckets="''")}""")
def metric_rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms, exponential histograms and summaries: days of hours of minutes."""
    points = derived.metric_points(spark, sf_dir).filter("metric_name like 'event.size%'")
    return _shown(rollups.merged(rollups.merged(rollups.rollup(points, rollups.MINUTE), HOUR), DAY))


def _shown(rolled: DataFrame) -> DataFrame:
    buckets = F.array_join(F.flatten(F.transform("buckets", lambda b: F.transform(b["counts"], lambda c: c.cast("long").cast("string")))), ",")
    return rolled.select(
        "metric_name", "series_id", "bucket_start", "points", "min", "max", F.round("total", 2).alias("total"), F.col("last.value").alias("last"), F.round("grown", 2).alias("grown"), "count", "sum", buckets.alias("buckets"),
    )


#: A range whose ends and steps fit no level.
_ODD = D10 + 1234 * 10**9 + 567


def _levels(points: DataFrame) -> dict[int, DataFrame]:
    """Minutes and hours of the points, written once, as a job keeps them."""
    minutes = cut(rollups.rollup(points, rollups.MINUTE))
    return {rollups.MINUTE: minutes, HOUR: cut(rollups.merged(minutes, HOUR))}


def _rolled(name: str, metric: str, key: str, agg: str | None, low: int, step: int, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = derived.metric_points(spark, sf_dir).filter(F.col("metric_name") == metric)
        found = rollups.query_rollups(points, _levels(points), rollups.series_of(points), metric, low, D20, step, agg, [key])
        return found.withColumn("value", F.round("value", 6))


_rolled("rollup_counter_rate", "event.cents", "service.name", None, _ODD, _STEP, f"WITH {POINTS}, {rate_sql('sum', GROWN, _ODD, D20, _STEP)}")
_rolled("rollup_histogram_p95", "event.size", "event.type", "p95", D10, DAY, _percentile(95))
_rolled("rollup_gauge_max", "event.value", "service.name", "max", JAN, _STEP, _gauge("max").replace(str(FEB), str(D20)))


@query("series_dictionary", f"""WITH {POINTS} SELECT 'event.value' AS metric_name, user_id, count(*) AS points, min(t) AS first FROM ev GROUP BY user_id""")
def series_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name = 'event.value'")
    return metrics.series_dictionary(points).select("metric_name", F.get_json_object("attributes", "$[0].value").cast("long").alias("user_id"), "points", "first")


@query("series_identity", f"""WITH {POINTS} SELECT count(DISTINCT user_id) AS ids, count(DISTINCT user_id) AS series, TRUE AS order_free FROM ev""")
def series_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name = 'event.value'")
    entries = lambda c: F.map_from_entries(F.reverse(F.map_entries(c)))
    turned = points.withColumn("attributes", entries("attributes")).withColumn("resource_attributes", entries("resource_attributes"))
    own, other = metrics.series_dictionary(points), metrics.series_dictionary(turned).select("series").withColumn("again", F.lit(True))
    both = own.join(other, "series", "left")
    return both.agg(F.count_distinct("series").alias("ids"), F.count(F.lit(1)).alias("series"), F.bool_and(F.coalesce("again", F.lit(False))).alias("order_free"))


GUARDED = f"""WITH {POINTS}, firsts AS (SELECT user_id, min(t) AS f FROM ev GROUP BY user_id), ranked AS (SELECT *, row_number() OVER (ORDER BY f, user_id) AS r FROM firsts)
    SELECT CASE WHEN r <= 20 THEN CAST(ev.user_id AS VARCHAR) ELSE '__overflow__' END AS series, count(*) AS points FROM ev JOIN ranked ON ranked.user_id = ev.user_id GROUP BY 1"""


@query("cardinality_guard", GUARDED)
def cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived.metric_points(spark, sf_dir).filter("metric_name = 'event.value'")
    return metrics.cardinality_guard(points, 20).groupBy("series").agg(F.count(F.lit(1)).alias("points"))
