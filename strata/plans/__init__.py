"""Queries over the driver's tables, registered by module."""

from strata.plans import change_and_text, code_graph, reading_queries, replies_and_drafts, settings_and_plans  # noqa: F401
from strata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
