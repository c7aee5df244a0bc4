"""All named queries: importing the modules below registers them."""

from __future__ import annotations

from quarry.plans import bookkeeping, campaigns, evaluation, eventlog, grouping, judgments, listings, reaching, relational, scoring, searching, signals, warmindex  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
