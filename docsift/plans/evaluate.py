"""Evaluation: question sets, the method grid, retrieval metrics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip, word_tokens
from ..operators.layout import unfold

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_similarity"]


def fallback_questions(docs: DataFrame) -> DataFrame:
    """A question and expected answer from the first sentence of a document."""
    head = F.substring("text", 1, 500)
    first = strip(F.substring_index(head, ".", 1))
    rows = docs.filter(F.length("text") > 100).select("doc_id", first.alias("expected_answer"))
    question = F.concat(
        F.lit("What does the document say about "), F.substring("expected_answer", 1, 50), F.lit("?")
    )
    return rows.filter(F.length("expected_answer") > 20).select("doc_id", question.alias("query"), "expected_answer")


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of short value lists (methods, modes, models).

    The lists are held as one array each and exploded, so no join is planned.
    """
    out = axes[0]
    for axis in axes[1:]:
        name = axis.columns[0]
        values = axis.agg(F.sort_array(F.collect_set(name))).scalar()
        out = out.withColumn(name, F.explode(values))
    return out


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: hit, reciprocal rank of the first relevant row, precision at ``k``.

    ``results(query_id, id, rank)``, ``relevant(id)``.
    """
    flag = relevant.select("id").distinct().withColumn("_rel", F.lit(1))
    rows = results.filter(F.col("rank") <= k).join(flag, "id", "left")
    rel = F.coalesce("_rel", F.lit(0))
    return rows.groupBy("query_id").agg(
        F.max(rel).alias("hit"),
        F.round(F.coalesce(F.max(F.when(rel == 1, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.sum(rel) / k, 6).alias("precision"),
    )


def token_f1(pairs: DataFrame, expected: str, generated: str, keys: list[str]) -> DataFrame:
    """``keys, f1``: F1 of the tokens two texts share, repeats included; 0 where they share none.

    Tokens of both sides are stacked and counted per key, so long answers cost no more
    than their tokens.
    """
    side = lambda c, n: unfold(pairs, keys, word_tokens(F.coalesce(c, F.lit(""))), "token").withColumn("_side", F.lit(n))
    stacked = side(expected, 0).unionByName(side(generated, 1))
    count = lambda n: F.count(F.when(F.col("_side") == n, 1))
    each = stacked.groupBy(*keys, "token").agg(count(0).alias("_a"), count(1).alias("_b"))
    sums = each.groupBy(*keys).agg(F.round(2.0 * F.sum(F.least("_a", "_b")) / F.sum(F.col("_a") + F.col("_b")), 6).alias("f1"))
    return pairs.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def long_form(rows: DataFrame, ids: list[str], metrics: list[str] = METRICS) -> DataFrame:
    present = [m for m in metrics if m in rows.columns]
    return rows.unpivot(ids, present, "metric", "value")


def metric_summary(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and the best and worst combination per metric.

    ``long(combination, metric, value)``; the smaller name wins a tie.
    """
    value = F.col("value")
    rows = long.groupBy("metric").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.min(F.when(value.isNotNull(), F.struct((-value).alias("v"), "combination"))).alias("b"),
        F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), "combination"))).alias("w"),
    )
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "metric", r("mean"), r("std"), r("min"), r("max"), F.col("b.combination").alias("best"),
        F.col("w.combination").alias("worst"),
    )


def score_bin(value: Column, low: float = 0.33, high: float = 0.66) -> Column:
    return F.when(value < low, "Low").when(value < high, "Medium").otherwise("High")


def heat_map(rows: DataFrame, key: str, metric: str) -> DataFrame:
    return rows.groupBy(key).agg(F.round(F.avg(metric), 6).alias("value")).withColumn("bin", score_bin(F.col("value")))
