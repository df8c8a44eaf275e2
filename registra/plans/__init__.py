"""Registered queries and their DuckDB equivalents, by area."""

from __future__ import annotations

from . import filtering, jobs, statistics
from .base import ORACLES, QUERIES, Query

__all__ = ["Query", "filtering", "jobs", "oracles", "queries", "statistics"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
