"""All queries of the procurement engine and their SQL counterparts."""

from provender.plans import aggregates, loading, matching, scalars, scenarios, tables  # noqa: F401
from provender.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
