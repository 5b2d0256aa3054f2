"""All registered queries."""

from __future__ import annotations

from . import curve_queries, gap_queries, live_queries, more_queries  # noqa: F401  they register their queries
from .queries import flagship
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
