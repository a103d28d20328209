"""The derived signals as SQL for the oracle: the same definitions as ``sources.derived``, scalars only."""

from __future__ import annotations

SPANS = """
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS n
    FROM lineitem
),
spans AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, '0' AS span_id, '' AS parent_span_id, 'order ' || o_orderpriority AS name, 'Server' AS kind,
           epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 AS t, CAST(round(o_totalprice * 1000) AS BIGINT) AS d,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Error' ELSE 'Unset' END AS status_code, '' AS status_message,
           'shop-' || substr(o_orderpriority, 1, 1) AS service_name, '1.' || CAST(year(o_orderdate) - 1995 AS VARCHAR) AS version,
           'order.status' AS k1, o_orderstatus AS v1, 'order.priority' AS k2, o_orderpriority AS v2
    FROM orders
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), CAST(n AS VARCHAR), CAST(CASE WHEN l_orderkey % 2 = 0 THEN n - 1 ELSE n // 2 END AS VARCHAR),
           'handle ' || l_returnflag || l_linestatus, CASE n % 3 WHEN 0 THEN 'Client' WHEN 1 THEN 'Server' ELSE 'Internal' END,
           epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 + n * 1000000, CAST(l_quantity AS BIGINT) * 1000000,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Error' WHEN l_returnflag = 'A' THEN 'Ok' ELSE 'Unset' END,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'item ' || CAST(l_partkey AS VARCHAR) || ' returned' ELSE '' END,
           'supplier-' || CAST(l_suppkey % 7 AS VARCHAR), '1.' || CAST(year(o_orderdate) - 1995 AS VARCHAR),
           'line.status', l_linestatus, 'line.flag', l_returnflag
    FROM numbered JOIN orders ON l_orderkey = o_orderkey
)"""

LOGS = """
logs AS (
    SELECT epoch_us(ts) * 1000 AS t, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_name,
           CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 ELSE 0 END AS severity_number,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'click' THEN 'debug' ELSE '' END AS severity_text,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'UNSET' END AS level,
           event_type || ' user ' || CAST(user_id AS VARCHAR) || ' value ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS body,
           CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 1500 AS VARCHAR) END AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
           event_type, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k,
           CASE WHEN user_id % 3 > 0 THEN 'prod' ELSE 'staging' END AS env
    FROM events
)"""

_SIZES = ", ".join(
    f"sum(count(*) FILTER (slot = {k})) OVER (PARTITION BY event_type, h // 24 ORDER BY h) AS c{k}" for k in range(8)
)
POINTS = f"""
ev AS (
    SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS t, CAST(round(value * 100) AS BIGINT) AS cents,
           epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 3600000000 AS h, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_name,
           CAST(1.0 < value AS INTEGER) + CAST(5.0 < value AS INTEGER) + CAST(10.0 < value AS INTEGER) + CAST(25.0 < value AS INTEGER)
           + CAST(50.0 < value AS INTEGER) + CAST(100.0 < value AS INTEGER) + CAST(250.0 < value AS INTEGER) AS slot
    FROM events
),
cum AS (
    SELECT *, sum(cents) OVER (PARTITION BY user_id, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS total FROM ev
),
sizes AS (
    SELECT event_type, h, h // 24 AS day, h * 3600000000000 + 3599000000000 AS t,
           sum(count(*)) OVER (PARTITION BY event_type, h // 24 ORDER BY h) AS n, sum(sum(cents)) OVER (PARTITION BY event_type, h // 24 ORDER BY h) AS cents,
           {_SIZES}
    FROM ev GROUP BY event_type, h
)"""
