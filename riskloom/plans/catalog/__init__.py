"""Registered queries and the SQL they are checked against."""

from . import facts, features, learning, sources, streams, trust  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
