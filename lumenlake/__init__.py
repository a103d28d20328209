"""Telemetry analytics (logs, traces, metrics) as Spark DataFrame operators."""
