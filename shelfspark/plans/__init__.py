"""Registered queries (``QUERIES``) and their DuckDB oracle SQL (``ORACLES``)."""

from shelfspark.plans import (  # noqa: F401  (registration)
    drift_queries,
    insight_queries,
    model_queries,
    profile_queries,
    source_queries,
    telemetry_queries,
    text_queries,
)
from shelfspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
