"""All registered queries of the library."""

from __future__ import annotations

from turnpike.plans import aggregates, audits, fitted, joined, relational, temporal
from turnpike.plans.registry import ORACLES, QUERIES, Query

__all__ = ["aggregates", "audits", "fitted", "joined", "relational", "temporal"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
