"""Phrase search: shared 1..5-word n-grams, longer ones weigh more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import words
from ..functions.tokens import hashed_ngrams
from ..session import fits_broadcast, localized, small_side
from . import grams
from .layout import spread, unfold
from .ranking import fixed, merged, top_with_range


def _words(c: Column) -> Column:
    return words(F.lower(c))


def _raw(corpus: DataFrame, queries: DataFrame, upto: int) -> DataFrame:
    """``query_id, id, score``: summed length of the n-grams both sides share, pair by pair.

    For query sets that tasks can't hold: both sides are hashed and joined.
    """
    asked = (
        unfold(queries, ["query_id"], hashed_ngrams(_words(F.col("text")), upto, sizes=True), "g")
        .groupBy("query_id", F.col("g.gram").alias("gram")).agg(F.sum("g.n").alias("w"))
    )
    asked, _ = localized(asked)
    rows = spread(corpus.select("id", "text"), "id").select("id", hashed_ngrams(_words(F.col("text")), upto).alias("grams"))
    every = unfold(rows, ["id"], "grams", "gram")
    # A document sits in one task, so its partial sum is complete before the shuffle.
    return every.join(asked, "gram").groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def _held(corpus: DataFrame, queries: DataFrame, asked: grams.Asked, k: int | None, keep: list[str]) -> DataFrame:
    rows = grams.documents(corpus, asked, _words, keep)
    return grams.scored(rows, asked, (asked.times * asked.size).astype(float), lambda tf, dl: tf, k, dict(queries.dtypes)["query_id"], bool(keep))


def scores(corpus: DataFrame, queries: DataFrame, upto: int = 5) -> DataFrame:
    """``query_id, id, score``: 0.2 n per pair of equal n-grams, divided by the query's best."""
    asked = grams.ask(queries, _words, upto)
    raw = _raw(corpus, queries, upto) if asked is None else _held(corpus, queries, asked, None, [])
    best = raw.groupBy("query_id").agg(F.max("score").alias("best"))
    rows = raw.join(small_side(best, fits_broadcast(queries)), "query_id")
    return rows.select("query_id", "id", fixed(F.col("score") / F.col("best"), 9).alias("score"))


def top(corpus: DataFrame, queries: DataFrame, k: int, upto: int = 5, key: Column | None = None) -> DataFrame:
    """Best ``k`` per query; with ``key``, of documents with equal keys only the best one counts."""
    distinct = key is not None
    if distinct:
        corpus = corpus.select("id", "text", key.alias("_key"))
    asked = grams.ask(queries, _words, upto)
    if asked is not None:
        rows = merged(_held(corpus, queries, asked, k, ["_key"] * distinct), k, distinct)
    else:
        found = _raw(corpus, queries, upto)
        rows = top_with_range(found.join(corpus.select("id", "_key"), "id") if distinct else found, k, distinct)
    return rows.select("query_id", "id", fixed(F.col("score") / F.col("high"), 9).alias("score"), "rank")
