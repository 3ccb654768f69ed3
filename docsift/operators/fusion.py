"""Fusing ranked lists. Lists are stacked and summed per key, never joined pairwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import fixed, keep_first, top_k

RRF_K = 60


def stacked(lists: Sequence[tuple[str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """Union of named result lists with a ``method`` column."""
    out = None
    for name, df in lists:
        part = df.select(*columns).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_rrf(lists: Sequence[tuple[str, DataFrame]], weights: Sequence[float] | None = None,
                 k: int = RRF_K) -> DataFrame:
    """``query_id, id, score, methods``: sum of weight / (k + rank) over the lists."""
    weights = weights or [1.0] * len(lists)
    total = sum(weights)
    weights = [w / total for w in weights] if total > 0 else [1.0 / len(lists)] * len(lists)
    rows = stacked(lists, ["query_id", "id", "rank"])
    share = None
    for (name, _), w in zip(lists, weights):
        test = F.col("method") == name
        share = F.when(test, w) if share is None else share.when(test, w)
    return rows.groupBy("query_id", "id").agg(
        fixed(F.sum(share / (F.col("rank") + k)), 9).alias("score"),
        F.sort_array(F.collect_set("method")).alias("methods"),
    )


def rrf_by_text(semantic: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse two lists ``query_id, id, key, rank, score`` on their text key.

    The best rank of a text in each list counts. ``weighted_score`` is the 0.6/0.4
    mean of the scaled scores, over the lists that hold the text.
    """
    cols = ["query_id", "id", "key", "rank", "score"]
    rows = stacked([("semantic", semantic), ("keyword", keyword)], cols)

    def pick(method: str, c: str) -> Column:
        return F.min_by(F.when(F.col("method") == method, F.col(c)), F.when(F.col("method") == method, F.col("rank")))

    grouped = rows.groupBy("query_id", "key").agg(
        pick("semantic", "rank").alias("semantic_rank"), pick("keyword", "rank").alias("bm25_rank"),
        pick("semantic", "score").alias("_s"), pick("keyword", "score").alias("_b"),
        pick("semantic", "id").alias("_si"), pick("keyword", "id").alias("_bi"),
    )
    one = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    weight = F.when(F.col("_s").isNotNull(), 0.6).otherwise(0.0) + F.when(F.col("_b").isNotNull(), 0.4).otherwise(0.0)
    mixed = F.coalesce(F.col("_s") * 0.6, F.lit(0.0)) + F.coalesce(F.col("_b") * 0.4, F.lit(0.0))
    return grouped.select(
        "query_id", F.coalesce("_si", "_bi").alias("id"), "key",
        fixed(one("semantic_rank") + one("bm25_rank"), 9).alias("score"),
        fixed(mixed / weight).alias("weighted_score"), "semantic_rank", "bm25_rank",
    )


def hybrid(semantic: DataFrame, lexical: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Fuse two id-ranked lists and keep the better of two texts that start alike.

    ``texts(id, head)`` holds the first 200 characters of each candidate.
    """
    rows = stacked([("semantic", semantic), ("lexical", lexical)], ["query_id", "id", "rank"])
    rank = lambda m: F.min(F.when(F.col("method") == m, F.col("rank")))
    fused = rows.groupBy("query_id", "id").agg(rank("semantic").alias("rank_semantic"), rank("lexical").alias("rank_lexical"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF_K), F.lit(0.0))
    fused = fused.withColumn("score", fixed(part("rank_semantic") + part("rank_lexical"), 9))
    fused = fused.join(texts, "id")
    fused = keep_first(fused, ["query_id", "head"], [F.col("score").desc(), F.col("id")])
    return top_k(fused.drop("head"), k, ["query_id"])

