"""Chunking methods by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ...functions.text import preprocess
from ...functions.vectors import hashing_embed
from . import meaning, structure
from .base import flat_chunks
from .splitter import splitter


def _recursive(docs: DataFrame, factory=None) -> DataFrame:
    return flat_chunks(docs, splitter()(F.col("text")))


def _structural(docs: DataFrame, factory=None) -> DataFrame:
    return structure.structural(docs)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "hierarchical": _structural,
    "recursive": _recursive,
    "semantic": meaning.semantic,
    "structural": _structural,
    "agentic": meaning.agentic,
    "cluster": meaning.cluster,
}


def available_methods() -> list[str]:
    return list(METHODS)


def default_methods() -> list[str]:
    return [m for m in ("hierarchical", "semantic", "structural") if m in METHODS]


def chunk(docs: DataFrame, method: str, factory=hashing_embed, clean: bool = True) -> DataFrame:
    """Chunk ``docs(doc_id, text)`` with a named method and label the rows with it."""
    if method not in METHODS:
        raise ValueError(f"unknown chunking method: {method}")
    if clean:
        docs = docs.select("doc_id", preprocess(F.col("text")).alias("text"))
    return METHODS[method](docs, factory).withColumn("chunking_method", F.lit(method))
