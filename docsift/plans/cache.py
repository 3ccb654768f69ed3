"""A search behind a result cache that is a table.

One row holds a query's results: key, engine, time and the ranked results. Rows are only
added, each run in a folder of its own, so a run that is lost leaves no half results and
two runs don't disturb each other; of several rows of a key the newest counts, and only
while it is fresh.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.filters import fresh
from ..operators.numbering import staged
from ..operators.ranking import top_k
from ..functions.text import strip

RESULTS = "array<struct<rank: int, id: long, score: double>>"


def cache_key(text: Column, engine: str, mode: str) -> Column:
    return F.concat_ws("_", strip(text), F.lit(engine), F.lit(mode))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``key, ts, results`` of all runs; no rows before the first."""
    try:
        return spark.read.schema(f"key string, ts timestamp, results {RESULTS}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"key string, ts timestamp, results {RESULTS}")


def newest(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest fresh row of each key; of rows of one time, the larger results."""
    return rows.filter(fresh(F.col("ts"), now, hours)).groupBy("key").agg(F.max(F.struct("ts", "results")).alias("r")).select("key", "r.results")


def append(found: DataFrame, now: Column, path: str) -> None:
    """Add ``found(key, rank, id, score)`` to the cache; a key has k results at most."""
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"))
    rows = found.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("results"))
    rows.select("key", now.cast("timestamp").alias("ts"), "results").write.mode("errorifexists").parquet(f"{path}/run={uuid.uuid4().hex}")


def cached_search(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], path: str, k: int, engine: str, mode: str, now: Column,
                  rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None, hours: int = 24) -> DataFrame:
    """``query_id, id, rank, score, cached``: results from the cache, or searched and stored.

    ``search(queries, n)`` gives ``query_id, id, score`` lists; with ``rerank(found, queries)``,
    which scores them anew, three times as many results are asked for as are kept. Equal
    queries are searched once. Queries without text have no results; queries that
    find nothing are not stored.
    """
    asked = staged(queries.filter(strip(F.col("text")) != "").select("query_id", "text").withColumn("key", cache_key(F.col("text"), engine, mode)))
    known = staged(newest(read(queries.sparkSession, path), now, hours).join(asked.select("key").distinct(), "key", "left_semi"))
    missing = asked.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("text", "query_id").alias("text"))
    missing = staged(missing.withColumnRenamed("key", "query_id"))
    hits = known.select("key", F.explode("results").alias("r")).select("key", "r.id", "r.rank", "r.score", F.lit(True).alias("cached"))
    if not missing.isEmpty():
        found = search(missing, 3 * k if rerank else k)
        found = rerank(found, missing) if rerank else found
        found = staged(top_k(found.select("query_id", "id", "score"), k, ["query_id"]).withColumnRenamed("query_id", "key"))
        append(found, now, path)
        hits = hits.unionByName(found.select("key", F.col("id").cast("long").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(False).alias("cached")))
    return asked.select("query_id", "key").join(hits.filter(F.col("rank") <= k), "key").drop("key")
