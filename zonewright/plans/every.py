"""All queries of the engine and their SQL."""

from __future__ import annotations

from zonewright.plans import catalogue, judgements, round_trips  # noqa: F401, they register their queries
from zonewright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
