"""Results of several engines ranked by words, by meaning or by both at once.

Both scores of a pair meet in the task that holds the document: the documents' query
words (``grams``) and vectors are staged in one row, and a batch's scores are two dense
blocks of which only the best k per query leave. No list of all pairs is put out or ranked,
but for a sum over places, which takes whole lists; their places move as packed numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import word_tokens
from ..session import fits_broadcast, small_side
from . import bm25, grams, vector
from .fusion import RRF_K
from .numbering import number_rows, staged
from .ranking import DIGITS, top_k

# Shares of words and meaning in a weighted rank.
WORDS, MEANING = 0.4, 0.6
# Places of a list that are sorted at once, those of a packed row, and rows of a packed batch.
PART, PACK, ROWS = 1 << 18, 1 << 9, 1 << 11


def by_words(corpus: DataFrame, queries: DataFrame, k: int, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``query_id, id, score, rank``: the best by BM25, whose highest score counts as 1."""
    return bm25.top(corpus.select("id", "text"), queries, k, tokens, norm="max").select("query_id", "id", "score", "rank")


def by_meaning(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the best by cosine."""
    return vector.top(corpus.select("id", "vec"), queries, k).select("query_id", "id", "score", "rank")


def by_both(corpus: DataFrame, queries: DataFrame, k: int, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``query_id, id, score, bm25_score, embedding_score, rank`` by the weighted mean of both.

    ``corpus(id, text, vec)``, ``queries(query_id, text, vec)``. Word scores are divided by
    the query's highest one, cosines scaled to 0..1. Documents without text are no results;
    a missing or zero vector has cosine 0 and is scored by its words. Ties go to the smaller
    id. More queries than a task can hold are searched in blocks, each a scan of its own.
    """
    queries = queries.filter(F.col("query_id").isNotNull()).select("query_id", "text", "vec")
    parts = [_block(corpus, block, asked, k, tokens) for block, asked in _blocks(queries, tokens)]
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"])


def _blocks(queries: DataFrame, tokens, n: int = 1) -> list[tuple[DataFrame, grams.Asked]]:
    """The queries in blocks whose words and vectors a task can hold."""
    size, most = queries.count(), queries.agg(F.max(F.size(tokens(F.col("text"))))).first()[0] or 0
    if most > grams.ASKED:
        raise ValueError(f"a query of {most} words is longer than the {grams.ASKED} that a task holds")
    while True:
        blocks = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
        held = [grams.ask(b, tokens, 1) for b in blocks]
        if all(a is not None and (len(a.ids) <= vector.BLOCK or n > 2 * size) for a in held):
            return [(b, a) for b, a in zip(blocks, held) if a.ids] or [(blocks[0], held[0])]
        n *= 2


def _cells(corpus: DataFrame, queries: DataFrame, asked: grams.Asked, tokens, keep: list[str]):
    """Staged documents with the columns ``keep``, how many they are, and a task function that
    scores their batches: the batch, its rows, and their word scores and cosines, not rounded."""
    kind = dict(queries.dtypes)["query_id"]
    base = bm25.Held(corpus.select("id", "text", F.col("vec").cast("array<double>").alias("vec"), *keep), asked, tokens, 1, None, ["vec", *keep])
    # One row per query of the block.
    best = dict(base.scored(1, kind).groupBy("query_id").agg(F.max("high")).collect())
    best = np.array([best.get(q) or 0.0 for q in asked.ids])
    vecs = {r["query_id"]: r["vec"] for r in queries.select("query_id", "vec").collect()}
    dim = max((len(v) for v in vecs.values() if v is not None), default=0)
    unit = _unit([vecs[q] for q in asked.ids], dim)
    weight, mean = base.weight, max(base.mean_length, 1e-9)

    def share(tf, dl):
        return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, slice, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at, words, _ in grams.dense(asked, weight, share, batch):
                words = np.where(best > 0, words / np.where(best > 0, best, 1), words)
                # Without any query vector, all cosines are 0.
                vec = _unit(batch.column("vec")[at].to_pylist() if dim else [None] * len(words), dim)
                yield batch, at, words, vec @ unit.T

    return base.rows.select("id", "vec", *keep, "dl", "nodes", "times"), base.docs, cells


def _block(corpus: DataFrame, queries: DataFrame, asked: grams.Asked, k: int, tokens) -> DataFrame:
    kind = dict(queries.dtypes)["query_id"]
    rows, _, cells = _cells(corpus, queries, asked, tokens, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, ids = grams.Best(k, False), np.arange(len(asked.ids))
        for batch, at, words, near in cells(batches):
            words, near = np.round(words, DIGITS) + 0.0, (np.round(near, DIGITS) + 1) / 2
            both = np.round(words * WORDS + near * MEANING, 9)
            table = pa.table({"id": batch.column("id")[at], "row": pa.array(range(len(words)))}).to_pandas()
            held = grams.Best(k, False)
            held.add_block(table, both, np.ones_like(both, dtype=bool), list(ids))
            if held.held is not None:
                q, r = held.held["query_id"].to_numpy(int), held.held["row"].to_numpy(int)
                top.add(held.held.assign(bm25_score=words[r, q], embedding_score=near[r, q]).drop(columns="row"))
        if top.held is not None and len(top.held):
            found = top.held
            columns = [pa.array([asked.ids[q] for q in found["query_id"]], schema.field(0).type), pa.array(found["id"], schema.field(1).type)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found[c].to_numpy(float)) for c in schema.names[2:]]], schema=schema)

    fields = f"query_id {kind}, id {dict(corpus.dtypes)['id']}, score double, bm25_score double, embedding_score double"
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in corpus.sparkSession.createDataFrame([], fields).schema])
    return rows.mapInArrow(run, fields)


def by_places(corpus: DataFrame, queries: DataFrame, k: int, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``query_id, url, score, rank``: a url's sum of 1 / (60 + place) over its results and both lists.

    ``corpus(id, text, vec, url)``, ``queries(query_id, text, vec)``. Every document with text has a
    place in the list by words and in the one by cosine, ties by the smaller id, so places are those
    of whole lists. Queries without words have none. Ties of sums go to the smaller url.

    Documents and urls are numbered in their order, and a place in a list is a number: score and
    document. Such numbers leave a task packed by query and stretch of the list, are sorted a stretch
    at a time, and the shares of its places, summed by url, leave packed by query and range of urls.
    """
    queries = queries.filter(F.col("query_id").isNotNull()).select("query_id", "text", "vec")
    urls = staged(number_rows(corpus.select("url").distinct(), ["url"], start=0, out="_url"))
    keys = number_rows(corpus.select("id", "url"), ["id"], start=0, out="_id").join(small_side(urls, fits_broadcast(urls)), "url")
    keys = staged(keys.select("id", "_id", "_url"))
    size, small = keys.count(), fits_broadcast(keys)
    rows = corpus.select("id", "text", "vec").join(small_side(keys, small), "id")
    parts = [_places(rows, block, asked, k, tokens, size.bit_length()) for block, asked in _blocks(queries, tokens)]
    # At most k rows per query from here on.
    best = staged(top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"], tie="_url"))
    return urls.join(small_side(best, fits_broadcast(best)), "_url").select("query_id", "url", "score", "rank")


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Scaled by a power of ten and rounded as SQL does, halves away from zero."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x))


def _packed(parts: Iterator[tuple[tuple[int, ...], tuple[np.ndarray, ...]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Numbers and arrays as rows of bounded size, a row's arrays as bytes."""
    held = []
    for numbers, arrays in parts:
        held += [(*numbers, *[x[lo : lo + PACK].tobytes() for x in arrays]) for lo in range(0, len(arrays[0]), PACK)]
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)


def _groups(batches: Iterator[pa.RecordBatch], n: int, *kinds) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """Sorted rows of ``_packed``, with ``n`` numbers: the arrays of a group at a time."""
    group, held = None, []
    for batch in batches:
        for *numbers, at in zip(*[c.to_pylist() for c in batch.columns[:n]], range(batch.num_rows)):
            if group != numbers:
                if held:
                    yield tuple(group), [np.concatenate(x) for x in zip(*held)]
                group, held = numbers, []
            held.append([np.frombuffer(c[at].as_py(), kind) for c, kind in zip(batch.columns[n:], kinds)])
    if held:
        yield tuple(group), [np.concatenate(x) for x in zip(*held)]


def _places(corpus: DataFrame, queries: DataFrame, asked: grams.Asked, k: int, tokens, bits: int) -> DataFrame:
    """Each url range's best ``k`` of a block of queries: ``query_id, _url, score``."""
    rows, docs, cells = _cells(corpus, queries, asked, tokens, ["_id", "_url"])
    some, most = np.unique(asked.query), PART
    many = max(1, -(-docs // most))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """List, its numbers (documents by queries), and the documents' urls."""
        for batch, at, words, near in cells(batches):
            page, url = (batch.column(c)[at].to_numpy() for c in ("_id", "_url"))
            for i, x in enumerate((words, near)):
                yield i, (-_half_up(x[:, some], DIGITS).astype(np.int64) << bits) + page[:, None], url

    # Where the lists are cut into stretches: a sample of documents sets the ends, and all are counted.
    ends, before = np.zeros((2, len(some), 0), np.int64), np.zeros((2, len(some), 1), np.int64)
    if many > 1:
        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, keys, _ in keyed(batches):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([keys.tobytes()])], ["list", "keys"])

        # Some hundred numbers per stretch and list, whose ends only balance the tasks.
        sample = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(max(1, most // 256))) == 0).mapInArrow(drawn, "list long, keys binary").collect()
        seen = [np.concatenate([np.frombuffer(r["keys"], np.int64).reshape(-1, len(some)) for r in sample if r["list"] == i] or [np.zeros((1, len(some)), np.int64)]) for i in (0, 1)]
        ends = np.stack([np.sort(x, axis=0)[np.arange(1, many) * len(x) // many].T for x in seen])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, len(some), many), np.int64)
            for i, keys, _ in keyed(batches):
                for q in range(len(some)):
                    n[i, q] += np.bincount(np.searchsorted(ends[i, q], keys[:, q], "right"), minlength=many)
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], ["n"])

        n = sum(np.frombuffer(r["n"], np.int64).reshape(2, len(some), many) for r in rows.mapInArrow(counted, "n binary").toLocalIterator())
        before = np.cumsum(n, axis=2) - n

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], tuple[np.ndarray, ...]]]:
        for i, keys, url in keyed(batches):
            for q in range(len(some)):
                part = np.searchsorted(ends[i, q], keys[:, q], "right")
                for p in np.unique(part):
                    yield (q, i, int(p)), (keys[part == p, q], url[part == p])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], tuple[np.ndarray, ...]]]:
        for (q, i, p), (keys, url) in _groups(batches, 3, np.int64, np.int64):
            share = 1.0 / (RRF_K + 1 + before[i, q, p] + np.arange(len(keys)))
            names, where = np.unique(url[np.argsort(keys, kind="stable")], return_inverse=True)
            sums = np.bincount(where, share, len(names))
            for r in np.unique(names // most):
                yield (q, int(r)), (names[names // most == r], sums[names // most == r])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (q, _), (url, share) in _groups(batches, 2, np.int64, np.float64):
            names, where = np.unique(url, return_inverse=True)
            score = _half_up(np.bincount(where, share, len(names)), 9) / 1e9
            best = np.lexsort((names, -score))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([asked.ids[some[q]]] * len(best), schema.field(0).type), pa.array(names[best]), pa.array(score[best])], schema=schema)

    fields = f"query_id {dict(queries.dtypes)['query_id']}, _url long, score double"
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in corpus.sparkSession.createDataFrame([], fields).schema])
    by = ["query", "list", "part"]
    found = rows.mapInArrow(lambda b: _packed(dealt(b), [*by, "keys", "urls"]), "query long, list long, part long, keys binary, urls binary")
    found = found.repartition(*by).sortWithinPartitions(*by)
    by = ["query", "range"]
    found = found.mapInArrow(lambda b: _packed(shares(b), [*by, "urls", "shares"]), "query long, range long, urls binary, shares binary")
    return found.repartition(*by).sortWithinPartitions(*by).mapInArrow(totals, fields)


def _unit(vectors: list, dim: int) -> np.ndarray:
    """Rows of length 1; missing and zero vectors stay zero."""
    out = np.array([np.zeros(dim) if v is None else v for v in vectors], float).reshape(len(vectors), dim)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)
