"""Vectors in blocks: every query block meets every candidate block, once per task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import staged

CANDIDATES = 4096  # rows of a candidate block
QUERIES = 1024  # rows of a query block


def usable(embedding: Column | str, zero: bool) -> Column:
    """Neither null nor empty, without null or non-finite components, and not all zero unless ``zero``."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, bad)
    return good if zero else good & F.exists(e, lambda x: x != 0)


def packed(rows: DataFrame, block: str) -> DataFrame:
    """One row per block and dimension: ``<block>, dim, ids, data`` (binary columns of numbers)."""
    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        data = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        data = data.reshape(len(order), -1)[order]
        return pa.table({
            block: t.column(block)[:1], "dim": t.column("dim")[:1], "ids": pa.array([t.column("id").to_numpy()[order].astype(np.int64).tobytes()], pa.binary()),
            "data": pa.array([data.tobytes()], pa.binary())})

    return rows.groupBy(block, "dim").applyInArrow(pack, f"{block} int, dim int, ids binary, data binary")


def unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), -1)


class Blocks:
    """A search's sides in blocks of bounded size, staged.

    ``queries`` are rows of the table whose id is divisible by ``every``, one per id (the
    smallest vector where an id repeats); candidates are all rows. Vectors meet only
    those of their own length.
    """

    def __init__(self, table: DataFrame, every: int, vec_id: str, embedding: str, zero: bool, value: Callable[[Column], Column]):
        cast = F.col("e").cast("array<double>")
        rows = table.select(table[vec_id].cast("long").alias("id"), table[embedding].alias("e")).filter("id IS NOT NULL")
        rows = rows.withColumn("e", cast).filter(usable("e", zero)).select("id", value(F.col("e")).alias("v"))
        rows = rows.withColumn("dim", F.size("v"))
        asked = rows.filter(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
        n, m = rows.count(), asked.count()
        self.n_candidates, self.n_queries = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(m / QUERIES))
        deal = lambda k: F.pmod(F.xxhash64("id", "v"), F.lit(k)).cast("int")
        self.candidates = staged(packed(rows.withColumn("cb", deal(self.n_candidates)), "cb"))
        self.queries = staged(packed(asked.withColumn("qb", deal(self.n_queries)), "qb"))

    def met(self, queries: DataFrame | None = None) -> DataFrame:
        """``cb, qb, dim, ids, data, q_ids, q_data`` for all pairs of blocks (and more columns of ``queries``).

        The pairs are keyed before the join, so they spread over the tasks; a block is
        copied once for each block of the other side.
        """
        queries = self.queries if queries is None else queries
        left = self.candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(self.n_queries - 1))))
        right = queries.withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
        right = right.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(self.n_candidates - 1))))
        return left.join(right, ["cb", "qb", "dim"])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that only one pair of blocks is unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
