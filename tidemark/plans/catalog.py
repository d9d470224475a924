"""Imports every module that registers queries."""

from tidemark.plans import event_queries, ml_queries, report_queries, source_queries, table_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
