"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.llm import mixing, neardup, queries, toxicity
from docsift.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts; it learns from the folder's labels."""
    own = [f"own_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*own)
    text = own[docs.columns.index("text")]
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(rows, model, text=text).filter("score < 0.5").drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the smallest id.

    Documents without an id belong to no group and stay.
    """
    copies = neardup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, F.expr("doc_id = _copy"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return queries.token_digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("byte_bpe", encode)]

# A network's scores and the encoding of words are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
