"""Registered queries with the SQL that checks them."""

from .registry import QUERIES, SQL
from . import catalog, chunks, records, scoring, searches, texts  # noqa: F401  (registration)

__all__ = ["QUERIES", "SQL"]
