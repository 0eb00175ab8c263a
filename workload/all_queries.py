"""Importing this module registers every query."""

from workload import applicant_queries, keyed_queries, list_queries, log_queries, stage_queries, text_queries, trend_queries  # noqa: F401
from workload.registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
