"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from wayfold.plans import robot  # noqa: F401  registers its queries
from wayfold.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
