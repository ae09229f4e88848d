"""Runnable queries over the provided tables, grouped by theme."""

from skyledger.plans import anomaly_trace_queries, correlation_queries, dashboard_queries, detection_queries, normalize_queries, service_queries, sketch_queries, source_queries, streaming_queries  # noqa: F401
from skyledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
