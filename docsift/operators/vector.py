"""Exact vector search: matrix products over Arrow batches against a block of queries.

A block of query vectors is checked for size and travels with the task; each task
keeps only its best k per query, so the shuffle carries k rows per query and task
however large the table is. More queries than one block holds never reach the driver:
both sides are packed in blocks and staged, and tasks meet stretches of query blocks
with stretches of the table, a pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .grams import CELLS, best_cells, places
from .layout import spread, tasks
from .numbering import staged
from .ranking import DIGITS, keep_first, min_max, top_k

# Query vectors per block.
BLOCK = 2_000
# Rows of a block of the table, and how many of its blocks and of its tasks' shares one task holds.
ROWS, BLOCKS, SHARES = 4_096, 64, 8


def _scorer(ids: list, matrix: np.ndarray, k: int | None, keep: list[str], group: str | None, distinct: bool):
    unit = matrix / np.where(np.linalg.norm(matrix, axis=1, keepdims=True) == 0, 1, np.linalg.norm(matrix, axis=1, keepdims=True))

    code = {q: i for i, q in enumerate(ids)}
    own = np.array([code.get(q, len(ids)) for q in ids], int)

    def rows(pdf: pd.DataFrame, scores: np.ndarray, r: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        """Long form of the picked (row, query) cells."""
        out = pdf.iloc[r].reset_index(drop=True)
        out.insert(0, "query_id", [ids[i] for i in q])
        out["score"] = np.round(scores[r, q], DIGITS) + 0.0
        return out

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
        by = ["query_id", *([group] if group else [])]
        if distinct:
            order = order.drop_duplicates([*by, "_key"])
        return order.groupby(by, sort=False, dropna=False).head(k)

    def reached(held: pd.DataFrame) -> np.ndarray:
        """The k-th best score of each query, -inf where there are fewer rows."""
        at = np.array([code.get(i, len(ids)) for i in held["query_id"]], int)
        low = np.full(len(ids) + 1, np.inf)
        np.minimum.at(low, at, held["score"].to_numpy())
        # A repeated query has one list; one that is not found again (no id) has no bound.
        full = np.where(np.bincount(at, minlength=len(ids) + 1) >= k, low, -np.inf)
        full[len(ids)] = -np.inf
        return full[own]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        floor = np.full(len(ids), -np.inf)
        step = max(1, CELLS // max(1, len(ids)))
        for pdf in (b.iloc[lo : lo + step] for b in batches if ids for lo in range(0, len(b), step)):
            v = np.stack(pdf["vec"].to_numpy()).astype(float)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            scores = v @ unit.T / np.where(length == 0, 1, length)
            pdf = pdf[["id", *keep]].reset_index(drop=True)
            if k is None:
                yield rows(pdf, scores, *np.divmod(np.arange(scores.size), len(ids)))
                continue
            if not group and held is not None:
                # Only what reaches a query's k-th best so far (before rounding) can be among its best.
                r, q = np.nonzero(scores >= floor - 10.0**-DIGITS)
                if len(r) <= 4 * k * len(ids):
                    if len(r):
                        held = best(pd.concat([held, rows(pdf, scores, r, q)]))
                        floor = reached(held)
                    continue
            scores = np.round(scores, DIGITS) + 0.0
            # The best k of their query (and group) in this block.
            place = places(pdf["id"])
            keys = pd.factorize(pdf["_key"], use_na_sentinel=False)[0] if distinct else None
            found = []
            for at in pdf.groupby(group, sort=False, dropna=False).indices.values() if group else [np.arange(len(pdf))]:
                r, q = best_cells(scores[at], place[at], k, keys[at] if distinct else None)
                found.append((at[r], q))
            part = rows(pdf, scores, *map(np.concatenate, zip(*found)))
            held = best(part if held is None else pd.concat([held, part]))
            if not group:
                floor = reached(held)
        if held is not None:
            yield held

    return score


def _search(corpus: DataFrame, queries: DataFrame, k: int | None, group: str | None = None, distinct: bool = False) -> DataFrame:
    keep = [c for c in corpus.columns if c not in ("id", "vec")]
    fields = ", ".join(f"`{c}` {t}" for c, t in corpus.select("id", *keep).dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {fields}, score double"
    corpus = corpus.filter(F.col("vec").isNotNull())
    queries = queries.select("query_id", "vec").filter(F.col("vec").isNotNull())
    block = queries.limit(BLOCK + 1).toPandas()
    if len(block) > BLOCK:
        return _met(corpus, queries, schema, k, keep, group, distinct)
    matrix = np.stack(block["vec"].to_numpy()).astype(float) if len(block) else np.zeros((0, 1))
    return spread(corpus, "id").mapInPandas(_scorer(block["query_id"].tolist(), matrix, k, keep, group, distinct), schema)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``rows, dim, data``: up to ``size`` rows without their vectors, and these as numbers in one binary."""
    names = [c for c in rows.columns if c != "vec"]
    kind = "f4" if dict(rows.dtypes)["vec"] == "array<float>" else "f8"
    fields = ", ".join(f"`{c}`: {t}" for c, t in rows.select(*names).dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, size) for b in batches for lo in range(0, b.num_rows, size)):
            vec = batch.column("vec")
            dims = pc.unique(pc.list_value_length(vec)).to_pylist()
            if len(dims) > 1:
                raise ValueError(f"vectors of different lengths: {dims}")
            data = vec.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            own = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(own)], own), pa.array(dims, pa.int32()), pa.array([data], pa.binary())], ["rows", "dim", "data"])

    return rows.select(*names, "vec").mapInArrow(pack, f"rows array<struct<{fields}>>, dim int, data binary")


def _met(corpus: DataFrame, queries: DataFrame, fields: str, k: int | None, keep: list[str], group: str | None, distinct: bool) -> DataFrame:
    """Scores of queries that one block does not hold; every block of queries meets every block of rows.

    A task holds its share of the packed rows, which is bounded, and one block of queries with its best rows.
    """
    kinds = ["f4" if dict(df.dtypes)["vec"] == "array<float>" else "f8" for df in (queries, corpus)]
    # As few tasks as hold the rows, so that blocks are full; the table's share of one is bounded by bytes and by blocks.
    cores, n, m = queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // BLOCK), -(-corpus.count() // ROWS)
    asked = spread(queries, "query_id").coalesce(max(cores, min(tasks(queries) or n, n)))
    found = spread(corpus.select("id", *keep, "vec"), "id").coalesce(max(1, min(m, max((tasks(corpus) or 0) // SHARES, -(-m // BLOCKS)))))
    asked = _packed(asked, BLOCK).withColumnsRenamed({"rows": "asked", "dim": "width", "data": "matrix"})
    asked = staged(asked.withColumn("block", F.monotonically_increasing_id()))
    found = staged(_packed(found, ROWS))
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in queries.sparkSession.createDataFrame([], fields).schema])

    def numbers(data: pa.Scalar, width: pa.Scalar, kind: str) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), kind).reshape(-1, max(1, width.as_py()))

    def block(row: dict) -> pd.DataFrame:
        own = row["rows"].values
        return pa.Table.from_arrays(own.flatten(), [f.name for f in own.type]).to_pandas().assign(vec=list(numbers(row["data"], row["dim"], kinds[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ({c: b.column(c)[i] for c in b.schema.names} for b in batches for i in range(b.num_rows))
        for _, same in groupby(pairs, lambda row: row["block"].as_py()):
            first = next(same)
            ids = [r["query_id"] for r in first["asked"].as_py()]
            ids = [tuple(i.values()) if isinstance(i, dict) else i for i in ids]
            score = _scorer(ids, numbers(first["matrix"], first["width"], kinds[0]).astype(float), k, keep, group, distinct)
            for best in score(map(block, chain([first], same))):
                yield from pa.Table.from_pandas(best, schema=out, preserve_index=False).to_batches()

    # The product streams the rows of the right side for each row of the left one.
    return asked.crossJoin(found.hint("shuffle_replicate_nl")).mapInArrow(run, fields)


def scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of every query with every row; follow it with a top-k per query or group.

    ``corpus(id, vec, …)`` and ``queries(query_id, vec)``; other corpus columns are kept.
    """
    return _search(corpus, queries, None)


def top(corpus: DataFrame, queries: DataFrame, k: int, group: str | None = None, distinct: bool = False) -> DataFrame:
    """Best ``k`` rows per query by cosine, or per query and value of ``group``: ``query_id, id, score, rank``.

    With ``distinct``, of rows with an equal ``_key`` only the best one counts (the smaller
    id where scores are equal); tasks keep k different keys per query.
    """
    rows, by = _search(corpus, queries, k, group, distinct), ["query_id", *([group] if group else [])]
    if distinct:
        rows = keep_first(rows, [*by, "_key"], [F.desc("score"), F.col("id")])
    return top_k(rows, k, by)


def distance_score(cosine):
    """Score of a store that reports cosine distance: max(0, 1 - distance / 2)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - cosine) / 2)


def normalised(results: DataFrame) -> DataFrame:
    """Scale the candidates of each query to 0..1 and keep what they had."""
    return min_max(results.withColumn("original_score", F.col("score")), ["query_id"])


def centroids(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Mean vector per key.

    Elements are averaged one by one under (key, position): partial sums are formed
    before the shuffle, so a key with most of the rows still moves one row per
    element and task. The regrouped list has one entry per dimension.
    """
    cells = df.select(key, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(key).agg(F.transform(pairs, lambda p: p["m"]).alias(vec))
