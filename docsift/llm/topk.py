"""Exact top-k by three phases with a uniform threshold.

A vector's components are dealt into ``LISTS`` lists; a list scores every candidate by its
part of the product. First, each block names the best of every list, and their whole
scores give a k-th best, so a cutoff that is safe for all blocks. A candidate that
reaches the cutoff has at least ``cutoff / LISTS`` in some list. Second, with the
cutoffs known everywhere, each list gives all its entries from there on. Third, the
entries' parts in the other lists are looked up, and those whose whole score reaches the
cutoff are ranked. Nothing that could be among the best is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import staged
from .vectors import Blocks, each, unpacked

LISTS = 2
TILE = 256
EXACT = 2.0**53


def parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Scores of every list: whole numbers, computed in doubles where these are exact."""
    edges = np.linspace(0, q.shape[1], min(LISTS, q.shape[1]) + 1).astype(int)
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT
    if not safe:
        q, c = q.astype(object), c.astype(object)  # Python's whole numbers; rare
        q, c = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(c)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:])]


LOW, HIGH = -(2**63), 2**63 - 1


def long(score) -> int:
    """A whole number as a long; the nearest one where it is beyond."""
    return min(HIGH, max(LOW, int(score)))


def local_lists(k: int):
    """Phase 1: each query's best whole scores among the best of every list of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            ids, c = unpacked(row["ids"], row["data"])
            q_ids, q = unpacked(row["q_ids"], row["q_data"])
            out_q, out_s = [], []
            for lo in range(0, len(q_ids), TILE):
                scores = parts(q[lo : lo + TILE], c)
                whole = sum(scores)
                for i, query in enumerate(q_ids[lo : lo + TILE]):
                    named = [np.argpartition(s[i], -k - 1)[-k - 1 :] if len(ids) > k + 1 else np.arange(len(ids)) for s in scores]
                    named = np.unique(np.concatenate(named))
                    best = np.sort(whole[i][named[ids[named] != query]])[-k:]
                    out_q += [query] * len(best)
                    out_s += best.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(list(map(long, out_s)), pa.int64())], ["id", "score"])

    return run


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: entries from the uniform threshold on, with their whole scores."""
    for row in each(batches):
        ids, c = unpacked(row["ids"], row["data"])
        q_ids, q = unpacked(row["q_ids"], row["q_data"])
        cutoffs = dict(zip(np.frombuffer(row["c_ids"], np.int64).tolist(), np.frombuffer(row["cutoffs"], np.int64).tolist())) if row["c_ids"] else {}
        out = []
        for lo in range(0, len(q_ids), TILE):
            scores = parts(q[lo : lo + TILE], c)
            least = np.array([cutoffs.get(int(x), LOW) for x in q_ids[lo : lo + TILE]], scores[0].dtype)
            free = np.array(least <= LOW, bool)  # no cutoff, or one at the longs' end
            some = np.zeros(scores[0].shape, bool) | free[:, None]
            for s in scores:
                some |= np.array(s * len(scores) >= least[:, None], bool)
            i, j = np.nonzero(some)
            whole = sum(s[i, j] for s in scores)
            kept = (np.array(whole >= least[i], bool) | free[i]) & (ids[j] != q_ids[lo + i])
            out.append((q_ids[lo + i[kept]], ids[j[kept]], whole[kept]))
        a, b, s = (np.concatenate([x[n] for x in out]) for n in range(3)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(map(long, s)), pa.int64())], ["query_id", "vec_id", "score"])


def top_products(table: DataFrame, k: int = 20, every: int = 20, factor: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query.

    A component x counts as floor(factor * x). Queries are the rows whose id is divisible
    by ``every``, against all rows but those with the query's id; ties go to the smaller
    id. Null and empty vectors, vectors with null or non-finite components and rows
    without an id take no part; vectors of different lengths are not compared. Repeated
    candidates count as often as they occur, a repeated query once; no row with the
    query's id is its candidate. Products are exact whatever their size; a score beyond
    the longs is the nearest long, and a component beyond the doubles after ``factor`` is the
    largest double. Fewer candidates than ``k`` give fewer rows, none give none.
    """
    most = 1.7976931348623157e308

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x * factor, F.lit(most)), F.lit(-most))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    blocks = Blocks(table, every, vec_id, embedding, zero=True, value=lambda e: F.transform(e, whole))
    lists = blocks.met().select("ids", "data", "q_ids", "q_data").mapInArrow(local_lists(k), "id long, score long")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score")))
    cutoffs = lists.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).select("id", "score")

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"qb": t.column("qb")[:1], "c_ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "cutoffs": pa.array([t.column("score").to_numpy().tobytes()], pa.binary())})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["qb"], np.int32)), pa.array(ids)], ["qb", "id"])

    where = blocks.queries.select("qb", "ids").mapInArrow(members, "qb int, id long")
    known = where.join(cutoffs, "id").groupBy("qb").applyInArrow(gather, "qb int, c_ids binary, cutoffs binary")
    told = staged(blocks.queries.join(known, "qb", "left"))
    rows = blocks.met(told).select("ids", "data", "q_ids", "q_data", "c_ids", "cutoffs").mapInArrow(entries, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
