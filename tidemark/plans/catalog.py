"""Registered queries and their DuckDB equivalents."""

from tidemark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
