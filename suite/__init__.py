"""Queries that run every operator over the given tables, each with the SQL that checks it."""

from suite import aggregates, checks, fills, plans, shape, tables, values  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
