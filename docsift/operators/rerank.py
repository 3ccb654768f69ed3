"""Second-stage ranking of bounded candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import legal
from ..functions.binding import let
from ..functions.text import dedup_key, words
from ..functions.tokens import QUESTION_WORDS, expand_query, key_terms
from .ranking import fixed, keep_first, top_k

# Phrases that mark a definition, and cues near an exact phrase.
DEFINITION_CUES = [
    " is a ", " is an ", " refers to ", " means ", " defined as ", " definition ", " problem that ",
    " arises in ", " applications ",
]
NEAR_CUES = [" is ", " is a ", " is an ", " arises ", " problem "]


def _has_any(c: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in cues])


def query_features(queries: DataFrame) -> DataFrame:
    """``query_id, terms, phrases`` over a query and its phrasings."""
    every = F.concat(F.array("text"), expand_query(F.col("text")))
    terms = F.array_distinct(F.flatten(F.transform(every, key_terms)))

    def opening(q: Column) -> Column:
        ws = F.filter(words(F.lower(q)), lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_WORDS))
        heads = lambda a: F.array_compact(F.array(
            *[F.when(F.size(a) >= need, F.array_join(F.slice(a, 1, n), " ")) for n, need in ((2, 2), (3, 2), (4, 4))]
        ))
        return let(ws, heads)

    phrases = F.array_distinct(F.flatten(F.transform(every, opening)))
    return queries.select("query_id", terms.alias("terms"), phrases.alias("phrases"))


def keyword_boost(candidates: DataFrame, features: DataFrame) -> DataFrame:
    """Lift scores by key terms, definition cues and exact phrases; cap at 1.

    ``candidates(query_id, id, text, score)`` is a bounded list per query. One row
    stays per text.
    """
    rows = candidates.withColumnRenamed("score", "original_score").join(features, "query_id")
    rows = rows.withColumn("_low", F.lower("text"))
    low = F.col("_low")
    hits = F.size(F.filter("terms", lambda t: low.contains(t)))
    phrase = F.get(F.filter("phrases", lambda p: low.contains(p)), F.lit(0))
    rows = rows.withColumns({"keyword_matches": hits, "_phrase": phrase})
    at = F.instr(low, F.col("_phrase")) - 1
    begin = F.greatest(at - 50, F.lit(0))
    context = F.substring(low, begin + 1, at - begin + F.length("_phrase") + 50)
    exact = F.when(F.col("_phrase").isNull(), 0.0).when(_has_any(context, NEAR_CUES), 0.4).otherwise(0.3)
    score = (
        F.col("original_score") + F.least(F.col("keyword_matches") * 0.1, F.lit(0.3))
        + F.when(_has_any(low, DEFINITION_CUES), 0.2).otherwise(0.0) + exact
    )
    rows = rows.withColumn("score", fixed(F.least(score, F.lit(1.0)))).withColumn(
        "_head", F.md5(dedup_key(F.col("text")))
    )
    rows = keep_first(rows, ["query_id", "_head"], [F.col("score").desc(), F.col("id")])
    return rows.drop("_head", "_low", "_phrase", "terms", "phrases")


def legal_boost(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Add contract features and ``final_score = score x boost`` to candidates with text."""
    rows = candidates.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    t, q = F.col("text"), F.col("_query")
    return rows.withColumns({
        "clause_type": legal.clause_type(t), "section_id": legal.section_id(t),
        "is_obligation": legal.is_obligation(t), "party_relevance": fixed(legal.party_relevance(t, q)),
        "final_score": fixed(F.col("score") * legal.boost(t, q), 9),
    }).drop("_query")


def by_document(candidates: DataFrame, k: int, documents: int) -> DataFrame:
    """Best documents by their best chunk, an equal share of chunks from each.

    Candidates are a bounded list per query, so the windows stay small.
    """
    per_doc = max(1, k // documents)
    docs = candidates.groupBy("query_id", "file_name").agg(F.max("score").alias("document_score"))
    docs = top_k(docs, documents, ["query_id"], "document_score", "file_name")
    rows = candidates.join(docs.drop("rank"), ["query_id", "file_name"])
    rows = top_k(rows, per_doc, ["query_id", "file_name"]).drop("rank")
    return top_k(rows, k, ["query_id"])


def weighted_web(pairs: DataFrame) -> DataFrame:
    """0.4 x BM25 (already divided by its maximum) + 0.6 x cosine moved to 0..1."""
    score = F.col("bm25") * 0.4 + (F.col("cosine") + 1) / 2 * 0.6
    # Both parts carry six decimals, so the sum is ranked at nine.
    return pairs.withColumn("score", fixed(score, 9))

