"""All registered queries: importing a module of queries registers them."""

from __future__ import annotations

from echoline.plans import domain_queries, queries, relation_queries, signal_queries, study_queries  # noqa: F401
from echoline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
