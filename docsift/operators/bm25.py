"""BM25 over a whole corpus for a whole query table.

Definition: idf = ln((N - df + .5) / (df + .5)), negative values replaced by a
quarter of the mean idf over the vocabulary; k1 = 1.5, b = 0.75; query tokens count
as often as they occur.

Plan: one pass over the corpus finds the queries' n-grams (``grams``) and stages them, one
row per document; document frequencies and scores come from these rows, and tasks keep
their best k per query. Query sets that tasks can't hold take the other way: n-grams are
64-bit hashes made inside the document's row, those the queries hold are counted there
and joined by token, which leaves hot tokens to the adaptive skew join. The mean idf,
which takes the frequency of every n-gram of the corpus, is only counted when a query
token occurs in more than half of the documents, and then on hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import hashed_ngrams
from ..functions.text import word_tokens
from ..session import localized, small_side
from . import grams
from .layout import spread, unfold
from .numbering import staged
from .ranking import fixed, merged, scale, top_k, top_with_range

K1, B, FLOOR = 1.5, 0.75, 0.25

# Marks of the two corpus totals inside the vocabulary; no token starts with a blank.
DOCS, LENGTH = " docs", " length"


def tokenized(corpus: DataFrame, tokens: Column) -> DataFrame:
    """``id, dl, tokens`` for documents that have any text."""
    # The explicit null test keeps later joins from adding their own to one reader only,
    # which would stop readers from sharing an exchange.
    rows = spread(corpus.select("id", "text").filter(F.col("id").isNotNull() & (F.trim("text") != "")), "id")
    return rows.select("id", tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def vocabulary(corpus: DataFrame, tokens: Column) -> DataFrame:
    """``token, n``: document frequency of every token, and two marked rows with the
    number of documents and their summed length.

    It depends on the corpus only: write it to a table and pass it to ``scores`` to
    spare later searches this pass.
    """
    toks = tokenized(corpus, tokens)
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(DOCS), F.lit(LENGTH)))
    n = F.when(F.col("token") == LENGTH, F.col("dl")).otherwise(1)
    return unfold(toks, ["dl"], marked, "token").groupBy("token").agg(F.sum(n).alias("n"))


@dataclass
class Weights:
    """What scoring needs of a corpus: totals and ``token, idf`` of query tokens."""

    docs: int
    mean_length: float
    mean_idf: float
    idf: DataFrame


def _hashes(corpus: DataFrame, tokens, upto: int) -> DataFrame:
    """``id, dl, keys``: documents with any text and their hashed n-grams."""
    return tokenized(corpus, hashed_ngrams(tokens(F.col("text")), upto)).withColumnRenamed("tokens", "keys")


def mean_of(docs: int, corpus: DataFrame, tokens, upto: int, vocab: DataFrame | None) -> float:
    """Mean idf over the vocabulary: looked up in ``vocab``, or counted on the corpus."""
    if vocab is None:
        spread_of = grams.frequencies(corpus, tokens, upto)
    else:
        spread_of = vocab.filter(~F.col("token").isin(DOCS, LENGTH)).groupBy("n").agg(F.count("*").alias("m"))
    raw = F.log(F.lit(docs) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    return spread_of.agg(F.sum(raw * F.col("m")) / F.sum("m")).first()[0] or 0.0


def weigh(rows: DataFrame, tf: DataFrame, words: DataFrame, mean_idf: Callable[[int], float]) -> Weights:
    """Totals, and the idf of the query tokens, whose document frequencies come from their counts ``tf``."""
    docs, length = rows.agg(F.count("*"), F.sum("dl")).first()
    raw = F.log(F.lit(docs) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    df = staged(tf.groupBy("token").agg(F.count("*").alias("n")))
    mean = mean_idf(docs) if 2 * (df.agg(F.max("n")).first()[0] or 0) > docs else 0.0
    idf = words.join(df, "token").select("token", F.when(raw < 0, F.lit(FLOOR * mean)).otherwise(raw).alias("idf"))
    return Weights(docs, (length or 0) / max(docs, 1), mean, idf)


class Held:
    """A query set that every task holds, and the documents' n-grams of it."""

    def __init__(self, corpus: DataFrame, asked: grams.Asked, tokens, upto: int, vocab: DataFrame | None, keep: list[str]):
        self.asked, self.rows = asked, staged(grams.documents(corpus, asked, tokens, keep))
        self.docs, length = self.rows.agg(F.count("*"), F.sum("dl")).first()
        df = np.zeros(len(asked.keys), np.int64)
        # One row per asked n-gram at most.
        for r in self.rows.select(F.explode("nodes").alias("node")).groupBy("node").count().collect():
            df[r["node"]] = r["count"]
        raw = np.log(self.docs - df + 0.5) - np.log(df + 0.5)
        self.mean_idf = mean_of(self.docs, corpus, tokens, upto, vocab) if 2 * df.max(initial=0) > self.docs else 0.0
        self.weight = asked.times * np.where(raw < 0, FLOOR * self.mean_idf, raw)[asked.node]
        self.mean_length = (length or 0) / max(self.docs, 1)

    def scored(self, k: int | None, query_type: str, distinct: bool = False) -> DataFrame:
        mean = max(self.mean_length, 1e-9)
        share = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        return grams.scored(self.rows, self.asked, self.weight, share, k, query_type, distinct)


def _asked(queries: DataFrame, tokens, upto: int) -> DataFrame:
    queries = queries.filter(F.col("query_id").isNotNull())
    return unfold(queries, ["query_id"], hashed_ngrams(tokens(F.col("text")), upto), "token").groupBy("query_id", "token").agg(
        F.count("*").alias("qtf")
    )


def _scores(corpus: DataFrame, asked: DataFrame, small: bool, tokens, upto: int, vocab: DataFrame | None) -> tuple[DataFrame, Weights]:
    words = small_side(asked.select("token").distinct(), small)
    rows = _hashes(corpus, tokens, upto)
    hits = unfold(rows, ["id", "dl"], "keys", "token").join(words, "token", "left_semi")
    # A document's tokens are in one task, so they are counted there before they move.
    tf = staged(hits.groupBy("id", "dl", "token").agg(F.count("*").alias("tf")))
    weights = weigh(rows, tf, words, lambda docs: mean_of(docs, corpus, tokens, upto, vocab))
    per_token = asked.join(small_side(weights.idf, small), "token").select(
        "query_id", "token", (F.col("qtf") * F.col("idf")).alias("w")
    )
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(weights.mean_length)))
    pairs = tf.select("id", "token", part.alias("part")).join(small_side(per_token, small), "token")
    found = pairs.groupBy("id", "query_id").agg(fixed(F.sum(F.col("part") * F.col("w"))).alias("score"))
    return found.select("query_id", "id", "score"), weights


def scores(corpus: DataFrame, queries: DataFrame, tokens=word_tokens, vocab: DataFrame | None = None, upto: int = 1) -> DataFrame:
    """``query_id, id, score`` for every pair that shares a token.

    ``corpus(id, text)``, ``queries(query_id, text)``; ``tokens`` maps a text column
    to its token array, ``upto`` is the longest n-gram that counts as a token.
    """
    held = grams.ask(queries, tokens, upto)
    if held is not None:
        return Held(corpus, held, tokens, upto, vocab, []).scored(None, dict(queries.dtypes)["query_id"])
    return _scores(corpus, *localized(_asked(queries, tokens, upto)), tokens, upto, vocab)[0]


def top(corpus: DataFrame, queries: DataFrame, k: int, tokens=word_tokens,
        vocab: DataFrame | None = None, norm: str = "min_max", upto: int = 1, key: Column | None = None) -> DataFrame:
    """Best ``k`` documents per query with a score scaled over the whole corpus.

    Documents without a shared token score 0 and fill up a list that has too few
    hits, smallest id first. ``norm``: ``min_max``, ``max`` or ``raw``. With ``key``, a
    digest of the text, of documents with equal keys only the best one counts.
    """
    distinct = key is not None
    if distinct:
        corpus = corpus.select("id", "text", key.alias("_key"))
    held = grams.ask(queries, tokens, upto)
    if held is not None:
        base = Held(corpus, held, tokens, upto, vocab, ["_key"] * distinct)
        docs, mean_idf, kind = base.docs, base.mean_idf, dict(queries.dtypes)["query_id"]
        # A query without tokens has no list.
        asked, small = corpus.sparkSession.createDataFrame([(held.ids[i],) for i in np.unique(held.query)], f"query_id {kind}"), True
        if mean_idf >= 0:
            best = merged(base.scored(k, kind, distinct), k, distinct)
        else:
            found = base.scored(None, kind)
    else:
        asked, small = localized(_asked(queries, tokens, upto))
        found, weights = _scores(corpus, asked, small, tokens, upto, vocab)
        docs, mean_idf = weights.docs, weights.mean_idf
    if held is None or mean_idf < 0:
        if mean_idf < 0:
            found = _all_pairs(found, asked, corpus)
        if distinct:
            found = found.join(corpus.select("id", "_key"), "id")
        best = top_with_range(found, k, distinct)
    # At most k rows per query from here on.
    best, zero, short = staged(best), F.lit(0.0), F.col("hits") < docs
    bounds = {
        "low": F.when(short, F.least(F.coalesce("low", zero), zero)).otherwise(F.col("low")),
        "high": F.when(short, F.greatest(F.coalesce("high", zero), zero)).otherwise(F.col("high")),
    }
    columns = ["query_id", "id", *["_key"] * distinct, "score", "rank"]
    full = best.groupBy("query_id").agg(F.count("*").alias("_full"), *[F.max(c).alias(c) for c in ("hits", "low", "high")])
    spans = asked.select("query_id").distinct().join(full, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hits", "_full")})
    lacking, fits = localized(spans.filter(short & (F.col("_full") < k)).withColumns(bounds))
    rows = best.withColumns(bounds).select(*columns, "low", "high")
    if not lacking.isEmpty():
        few = rows.select(*columns).join(lacking.select("query_id"), "query_id", "left_semi")
        few = _filled(few, lacking.select("query_id"), corpus, k, distinct).join(small_side(lacking.select("query_id", "low", "high"), fits), "query_id")
        rows = rows.join(lacking.select("query_id"), "query_id", "left_anti").unionByName(few)
    scaled = {
        "min_max": scale(F.col("score"), F.col("low"), F.col("high")),
        "max": F.when(F.col("high") > 0, fixed(F.col("score") / F.col("high"))).otherwise(F.col("score")),
        "raw": F.col("score"),
    }[norm]
    return rows.select("query_id", "id", "rank", scaled.alias("score"), F.col("score").alias("original_score"))


def _all_pairs(found: DataFrame, asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Scores of every document, 0 without a shared token.

    Only for a vocabulary whose tokens occur in most documents on average: scores can
    then be negative and documents without any hit rank above them.
    """
    ids = asked.agg(F.sort_array(F.collect_set("query_id"))).scalar()
    every = corpus.filter(F.trim("text") != "").select("id", F.explode_outer(ids).alias("query_id"))
    rows = every.filter(F.col("query_id").isNotNull()).join(found, ["query_id", "id"], "left")
    return rows.select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _filled(rows: DataFrame, lacking: DataFrame, corpus: DataFrame, k: int, distinct: bool) -> DataFrame:
    """Lists with fewer than ``k`` hits get documents of score 0, found among the 2k smallest ids
    (with ``distinct``, among the smallest ids of the 2k texts that begin first)."""
    every = corpus.filter(F.trim("text") != "").select("id", *["_key"] * distinct)
    if distinct:
        every = every.groupBy("_key").agg(F.min("id").alias("id"))
    firsts = every.orderBy("id").limit(2 * k).agg(F.sort_array(F.collect_list(F.struct(*["id", "_key"][: 1 + distinct])))).scalar()
    fill = lacking.select("query_id", F.explode_outer(firsts).alias("_first")).select("query_id", "_first.*")
    same = ["query_id", "_key" if distinct else "id"]
    fill = fill.join(rows.select(*same), same, "left_anti").withColumn("score", F.lit(0.0))
    return top_k(rows.drop("rank").unionByName(fill), k, ["query_id"])


def search(corpus: DataFrame, queries: DataFrame, k: int, key: Column, tokens=word_tokens,
           vocab: DataFrame | None = None, upto: int = 5) -> DataFrame:
    """Keyword search: the best ``k`` different texts by n-gram BM25."""
    return top(corpus, queries, k, tokens, vocab, upto=upto, key=F.md5(key))
