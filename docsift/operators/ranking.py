"""Ranks, top-k, normalisation, keep-first, thresholds.

Windows are only opened per query (or per document and query) with a ``rank <= k``
filter on top, which Spark turns into a per-task top-k before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Scores are ranked at this many decimals so that the order in which partial sums
# meet cannot change a result; ties go to the smaller id.
DIGITS = 6


def fixed(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def ranked(df: DataFrame, by: list[str], score: str = "score", tie: str = "id", out: str = "rank") -> DataFrame:
    order = [F.col(score).desc(), F.col(tie).asc()]
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    return ranked(df, by, score, tie).filter(F.col("rank") <= k)


def min_max(df: DataFrame, by: list[str], score: str = "score", out: str = "score") -> DataFrame:
    """Scale a bounded result list to 0..1; equal scores all become 1."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, scale(F.col(score), low, high))


def scale(s: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise(fixed((s - low) / (high - low)))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark keeps one row per key and task before the shuffle."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def distinct_texts(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """First row (smallest id) per text key over a whole table.

    Only a 32-byte digest and the id are shuffled, combined map-side, so a text that
    makes up a third of the table costs one row per task. The winners come back by
    a join on the unique id.
    """
    digests = df.select(F.sha2(key, 256).alias("_key"), F.col(id_col).alias("_id"))
    winners = digests.groupBy("_key").agg(F.min("_id").alias(id_col)).select(id_col)
    return df.join(winners, id_col, "left_semi")


def confident(df: DataFrame, threshold: float, by: list[str], fallback: int = 3, score: str = "score") -> DataFrame:
    """Rows at or above a score; where a query has none, its best three, flagged."""
    w = W.partitionBy(*by)
    some = F.max(F.when(F.col(score) >= threshold, 1).otherwise(0)).over(w)
    df = ranked(df, by, score).withColumn("_some", some)
    keep = ((F.col("_some") == 1) & (F.col(score) >= threshold)) | ((F.col("_some") == 0) & (F.col("rank") <= fallback))
    return df.filter(keep).withColumn("low_confidence", F.col("_some") == 0).drop("_some")


def top_with_range(df: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """Best ``k`` of ``query_id, id, score`` with ``hits, low, high`` over all rows of the query.

    With ``distinct``, the best row of each ``_key`` counts.

    One pass: every task keeps its best k per query and the count and range of what
    it saw, so the scored pairs are neither sorted nor shuffled nor computed a second
    time for their range. The window sees k rows per query and task.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
        if distinct:
            order = order.drop_duplicates(["query_id", "_key"])
        return order.groupby("query_id", sort=False).head(k)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            part = pdf.groupby("query_id")["score"].agg(hits="size", low="min", high="max")
            if seen is not None:
                part = pd.concat([seen, part]).groupby(level=0).agg(hits=("hits", "sum"), low=("low", "min"), high=("high", "max"))
            seen = part
            held = best(pdf if held is None else pd.concat([held, pdf]))
        if held is not None:
            out = held.join(seen, on="query_id")
            # The count of a task is carried by one row per query.
            out["hits"] = out["hits"].where(~out.duplicated("query_id"), 0)
            yield out

    types = dict(df.dtypes)
    schema = f"query_id {types['query_id']}, id {types['id']}, {'_key string, ' * distinct}score double, hits long, low double, high double"
    rows = df.select("query_id", "id", *["_key"] * distinct, F.col("score").cast("double")).mapInPandas(shrink, schema)
    return merged(rows, k, distinct)


def merged(parts: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """Ranks 1 to ``k`` from the tasks' best, with ``hits, low, high`` over all pairs of the query."""
    w = W.partitionBy("query_id")
    rows = parts.withColumns({"hits": F.sum("hits").over(w), "low": F.min("low").over(w), "high": F.max("high").over(w)})
    if distinct:
        rows = keep_first(rows, ["query_id", "_key"], [F.desc("score"), F.col("id")])
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
