"""Registered queries over the given tables, and SQL that gives the same rows."""

from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
