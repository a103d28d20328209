"""Time ranges, buckets and partition predicates over nanoseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HOUR, NANOS

#: Steps that charts use, in seconds. Fixed values.
STEPS = (10, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400)


def nice_step(range_ns: int, points: int) -> int:
    """The smallest step (ns) that cuts the range into at most ``points``; the largest one if none does."""
    return next((s * NANOS for s in STEPS if range_ns // (s * NANOS) <= points), STEPS[-1] * NANOS)


def in_range(time: str, from_ns: int | None, to_ns: int | None) -> Column:
    """``from_ns <= time < to_ns``; a bound that is None is open."""
    out = F.lit(True)
    if from_ns is not None:
        out &= F.col(time) >= F.lit(from_ns).cast("long")
    if to_ns is not None:
        out &= F.col(time) < F.lit(to_ns).cast("long")
    return out


def bucket(time: str, from_ns: int, step_ns: int) -> Column:
    """The number of the step that ``time`` falls in, counted from ``from_ns``."""
    return F.expr(f"({time} - {from_ns}L) div {step_ns}L")


def bucket_start(number: str, from_ns: int, step_ns: int) -> Column:
    return F.lit(from_ns).cast("long") + F.col(number) * F.lit(step_ns).cast("long")


def timestamp(time: str) -> Column:
    """A timestamp to the microsecond, for partitions and watermarks."""
    return F.timestamp_micros(F.expr(f"{time} div 1000L"))


def utc_date(time: str) -> Column:
    """The UTC date of a time, whatever the session's time zone."""
    return F.date_from_unix_date(F.expr(f"cast(({time} - pmod({time}, {24 * HOUR}L)) div {24 * HOUR}L as int)"))


def utc_hour(time: str) -> Column:
    """The UTC hour of a time as two digits."""
    return F.lpad(F.expr(f"cast(pmod({time}, {24 * HOUR}L) div {HOUR}L as string)"), 2, "0")


def hour_number() -> Column:
    """Hours since the epoch of the partition columns ``date`` and ``hour``, which are UTC."""
    return F.unix_date("date").cast("long") * 24 + F.col("hour").cast("long")


def hours_between(from_ns: int | None, to_ns: int | None) -> Column:
    """The predicate on the partition columns ``date`` and ``hour`` of all hours that touch the range."""
    day = lambda ns: F.date_from_unix_date(F.lit(ns // (24 * HOUR)))
    out = F.lit(True)
    if from_ns is not None:
        out &= (hour_number() >= from_ns // HOUR) & (F.col("date") >= day(from_ns))
    if to_ns is not None:
        out &= (hour_number() <= (to_ns - 1) // HOUR) & (F.col("date") <= day(to_ns))
    return out


__all__ = ["HOUR", "NANOS", "bucket", "bucket_start", "hour_number", "hours_between", "in_range", "nice_step", "timestamp", "utc_date", "utc_hour"]
