"""All registered queries."""

from logloom.plans import quality_queries, service_queries, source_queries, text_queries, triage_queries  # noqa: F401
from logloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
