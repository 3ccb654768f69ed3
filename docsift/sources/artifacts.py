"""Stored key-value maps and entity graphs as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

DOC_STATUS = (
    "struct<status:string,chunks_count:bigint,chunks_list:array<string>,content_summary:string,"
    "content_length:bigint,created_at:string,updated_at:string,file_path:string,track_id:string,"
    "metadata:struct<processing_start_time:bigint,processing_end_time:bigint>>"
)
CHUNK_LINKS = "struct<chunk_ids:array<string>,count:bigint,create_time:bigint,update_time:bigint,_id:string>"
SEPARATOR = "<SEP>"


def kv_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value.*`` of a JSON file that holds one map."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v"))
    return rows.select("key", "v.*")


def relation_links(rows: DataFrame, *keep: str) -> DataFrame:
    """``source, target, chunk_id`` from relation keys ``a<SEP>b``."""
    ends = F.split("key", SEPARATOR)
    return rows.select(*keep, ends[0].alias("source"), ends[1].alias("target"), F.explode("chunk_ids").alias("chunk_id"))


def graph_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files (``path, content``) with their data as maps."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        ns = "{http://graphml.graphdrawing.org/xmlns}"
        for pdf in batches:
            for content in pdf["content"]:
                root = ElementTree.fromstring(content)
                names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
                rows = [
                    {"kind": kind, "id": e.get("id"), "source": e.get("source"), "target": e.get("target"),
                     "data": {names.get(d.get("key"), d.get("key")): d.text or "" for d in e.iter(f"{ns}data")}}
                    for kind in ("node", "edge") for e in root.iter(f"{ns}{kind}")
                ]
                yield pd.DataFrame(rows, columns=["kind", "id", "source", "target", "data"])

    rows = files.select("content").mapInPandas(
        parse, "kind string, id string, source string, target string, data map<string,string>"
    )
    nodes = rows.filter(F.col("kind") == "node").select("id", "data")
    edges = rows.filter(F.col("kind") == "edge").select(
        "source", "target", F.col("data")["weight"].try_cast("double").alias("weight"), "data"
    )
    return nodes, edges
