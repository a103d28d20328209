"""Registered queries: a callable each, and the oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def ns(day: str) -> int:
    """Nanoseconds of midnight UTC."""
    from datetime import UTC, datetime

    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) * 1_000_000_000


#: Ranges that the queries use: a year of spans, its second half, a turn of the year, a month of logs, and some days of it.
Y96, Y97, MID96 = ns("1996-01-01"), ns("1997-01-01"), ns("1996-07-01")
TURN_FROM, TURN_TO = ns("1997-12-20"), ns("1998-01-20")
JAN, FEB = ns("2024-01-01"), ns("2024-02-01")
D10, D20 = ns("2024-01-10"), ns("2024-01-20")
HOUR, DAY = 3600 * 10**9, 86400 * 10**9
