"""Queries over the test tables, each with SQL that gives the same rows."""

from . import captured  # noqa: F401  adds its queries
from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
