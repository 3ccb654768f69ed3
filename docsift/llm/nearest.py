"""Nearest neighbours by a block matrix join on int8 codes.

Every vector becomes 8-bit codes and a scale. A tile's products of codes are whole
numbers, exact in single precision, and give the distance between the coded vectors; with
both vectors' coding errors, that bounds the true distance from both sides. A pair whose
lower bound is above the k-th smallest upper bound of its query in the tile cannot be
among the k nearest there; what is left is computed again in double precision, and
each tile's best go into one heap per query and task. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .vectors import Blocks, each, unpacked

TILE = 256  # queries of a tile


def coded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (-127..127), scale, coding error and squared length of the codes, per row."""
    scale = np.abs(data).max(1) / 127
    scale[scale < 1e-300] = 1.0  # codes are 0, all is error
    codes = np.rint(data / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(data - codes * scale[:, None], axis=1)
    return codes, scale, error, (codes.astype(np.int32) ** 2).sum(1)


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two coded tiles.

    Where components are so large that squares overflow, nothing is known of a pair.
    """
    (qc, qs, qe, qn), (cc, cs, ce, cn) = q, c
    product = qc.astype(np.float32) @ cc.astype(np.float32).T  # exact: below 2^24 up to 1,040 dimensions
    square = (qs**2 * qn)[:, None] + (cs**2 * cn)[None, :] - 2 * product * (qs[:, None] * cs[None, :])
    # Rounding of the sums above, and of the product in longer vectors.
    size = (qs**2 * qn)[:, None] + (cs**2 * cn)[None, :]
    loose = size * (1e-12 if qc.shape[1] <= 1040 else 1e-5)
    error = qe[:, None] + ce[None, :]
    low, high = np.sqrt(np.maximum(square - loose, 0)) - error, np.sqrt(np.maximum(square + loose, 0)) + error
    slack = 1e-12 * (1 + high)
    low, high = low - slack, high + slack
    unknown = ~(np.isfinite(low) & np.isfinite(high))
    return np.where(unknown, -np.inf, low), np.where(unknown, np.inf, high)


def distances(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows to ``q``, squares summed in order, as anyone would; by parts of the
    largest difference where squares leave the range of doubles."""
    apart = c - q
    out = np.sqrt(np.cumsum(apart**2, axis=1)[:, -1])
    odd = np.flatnonzero(~((out > 1e-150) & (out < 1e150)))
    if len(odd):
        most = np.abs(apart[odd]).max(axis=1)
        parts = np.divide(apart[odd], most[:, None], out=np.zeros_like(apart[odd]), where=(most > 0)[:, None] & np.isfinite(most)[:, None])
        out[odd] = np.where(np.isfinite(most), most * np.sqrt(np.cumsum(parts**2, axis=1)[:, -1]), np.inf)
    return out


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, coded_c: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query, ids and distances of its ``k`` nearest in the tile, nearest first."""
    with np.errstate(all="ignore"):
        low, high = bounds(coded(q), coded_c)
    for i in range(len(q_ids)):
        own = ids == q_ids[i]
        reach = np.where(own, np.inf, high[i])
        limit = np.partition(reach, k - 1)[k - 1] if len(reach) > k else np.inf
        left = np.flatnonzero((low[i] <= limit) & ~own)
        with np.errstate(all="ignore"):
            exact = distances(c[left], q[i])
        order = np.lexsort((ids[left], exact))[:k]
        yield int(q_ids[i]), ids[left][order], exact[order]


def nearest(table: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query by Euclidean distance.

    Queries are the rows whose id is divisible by ``every``, against all rows but those
    with the query's id; ties go to the smaller id. Null, empty and zero vectors, vectors
    with null or non-finite components and rows without an id take no part; vectors of
    different lengths are not compared. Repeated candidates count as often as they occur,
    a repeated query once; no row with the query's id is its candidate. Components of any
    finite size take part (a distance beyond the doubles is infinite). Fewer candidates
    than ``k`` give fewer rows, none give none.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for row in each(batches):
            ids, c = unpacked(row["ids"], row["data"])
            q_ids, q = unpacked(row["q_ids"], row["q_data"])
            with np.errstate(all="ignore"):
                coded_c = coded(c)
            for lo in range(0, len(q_ids), TILE):
                for query, found, score in best_of_tile(q_ids[lo : lo + TILE], q[lo : lo + TILE], ids, c, coded_c, k):
                    heap = heaps.setdefault(query, [])
                    for s, v in zip(score.tolist(), found.tolist()):
                        item = (-s, -v)  # the worst of the kept is on top
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
                        else:
                            break
        rows = [(q, -v, -s) for q, heap in heaps.items() for s, v in heap]
        a, b, s = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    blocks = Blocks(table, every, vec_id, embedding, zero=False, value=lambda e: e)
    rows = blocks.met().select("ids", "data", "q_ids", "q_data").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
