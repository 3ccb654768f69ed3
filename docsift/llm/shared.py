"""Small helpers of this subpackage: staged tables and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir

# Rows that a per-source or per-word table may have to be sent to every executor.
BROADCAST_ROWS = 100_000

# White space of the word patterns below: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder; later steps read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``staged``, but as compressed Parquet, for tables as large as the corpus."""
    path = new_folder(df, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(df: DataFrame, name: str) -> str:
    """A path, not yet there, in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if a count shows that it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``, however the batches cut them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        other = np.flatnonzero(pa.compute.not_equal(keys, keys[-1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(key)[0] != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
