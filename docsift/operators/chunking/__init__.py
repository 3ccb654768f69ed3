"""Chunkers: one document row in, chunk rows out, without a shuffle.

Every chunker takes a DataFrame with ``doc_id`` and ``text`` and returns
``doc_id, pos, level, clause_number, title, parent, preserved, text``.
"""

from .registry import METHODS, available_methods, chunk, default_methods

__all__ = ["METHODS", "available_methods", "chunk", "default_methods"]
