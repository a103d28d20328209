"""All registered queries of the library."""

from __future__ import annotations

from . import alert_queries, log_queries, metric_queries, span_queries, storage_queries  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
