"""Ingest files as they arrive, skipping those already stored.

The batch rule "a file with chunks is not ingested again" becomes a micro-batch
anti-join against the chunk table; each batch is one append keyed by its id, so a
batch that is replayed after a failure overwrites its own folder only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.numbering import max_number
from ..plans.ingest import ingest, new_documents


def stored_chunks(spark, table: str, before: int) -> DataFrame | None:
    """Chunks of the batches before this one."""
    try:
        return spark.read.parquet(table).filter(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest_stream(docs: DataFrame, table: str, checkpoint: str, methods: list[str] | None = None) -> StreamingQuery:
    """Start ingesting ``docs(doc_id, source_file, text, upload_timestamp)``; runs until what is there is done."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = stored_chunks(batch.sparkSession, table, batch_id)
        start = 1
        if stored is not None:
            batch = new_documents(batch, stored)
            start = stored.agg(max_number()).first()[0] + 1
        chunks = ingest(batch, methods, start=start)
        chunks.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
