"""Operators of a training-data pipeline. Nothing outside this package imports it but the entry module."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
