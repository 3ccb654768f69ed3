"""Query n-grams in documents, and what documents score by them, in one pass each.

The n-grams of a bounded query set form a trie: every n-gram's beginning is one, too.
Its edges are sorted numbers, so a batch of documents walks it in numpy, all places at
once; places that leave the trie are gone for longer n-grams. Comparison is by the tokens
themselves, not by hashes. A document leaves as one row: its length and the nodes found.

Scores of a batch are a dense block, documents by queries. A task keeps its best k rows
per query, or the best row of k different texts, and the count and range of what it saw.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .layout import bounded, cuts, spread
from .ranking import DIGITS

# Query tokens, each with the n-grams that begin there, that a task may hold.
ASKED = 200_000
# Cells of a block of scores, and tokens that a task looks up at once.
CELLS, TOKENS = 1 << 20, 1 << 19


class Asked:
    """N-grams of a query set: ``ids`` of queries, and ``query, node, size, times`` of their n-grams."""

    def __init__(self, rows: list[tuple[object, list[str]]], upto: int):
        self.upto, self.ids = upto, list(dict.fromkeys(q for q, _ in rows))
        words = list(dict.fromkeys(w for _, ws in rows for w in ws))
        code, number = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(self.ids)}
        self.words, edges, counts = pa.array(words, pa.string()), {}, Counter()
        for q, ws in rows:
            for i in range(len(ws)):
                node = -1
                for n, w in enumerate(ws[i : i + upto], 1):
                    node = edges.setdefault((node + 1) * len(words) + code[w], len(edges))
                    counts[number[q], node, n] += 1
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        cells = np.array([(*c, n) for c, n in counts.items()], np.int64).reshape(-1, 4)
        self.query, self.node, self.size, self.times = cells.T

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Nodes behind ``node`` (-1: the root) by a word; -1 where there is none."""
        key = (node + 1) * len(self.words) + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def found(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``document, node, times`` of the n-grams in lists of tokens."""
        flat = lists.flatten()
        code = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), sizes)
        at = np.flatnonzero(code >= 0)
        node = np.full(len(at), -1, np.int64)
        seen = []
        for n in range(self.upto):
            if not len(self.keys) or not len(at):
                break
            node = self.step(node, code[at + n])
            inside = node >= 0
            at, node = at[inside], node[inside]
            seen.append(doc[at] * len(self.keys) + node)
            more = at + n + 1 < len(code)
            at, node = at[more], node[more]
            more = (doc[at + n + 1] == doc[at]) & (code[at + n + 1] >= 0)
            at, node = at[more], node[more]
        key, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64),) * 2
        return key // max(1, len(self.keys)), key % max(1, len(self.keys)), times


def ask(queries: DataFrame, tokens: Callable[[Column], Column], upto: int) -> Asked | None:
    """The queries' n-grams, or None if there are too many for every task to hold."""
    rows = queries.filter(F.col("query_id").isNotNull()).select("query_id", tokens(F.col("text")).alias("ws"))
    if (rows.agg(F.sum(F.greatest(F.size("ws"), F.lit(1)))).first()[0] or 0) > ASKED:
        return None
    return Asked([(r["query_id"], [w for w in r["ws"] or [] if w is not None]) for r in rows.collect()], upto)


def documents(corpus: DataFrame, asked: Asked, tokens: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """``id, dl, nodes, times`` and the columns ``keep`` of documents that have any text.

    ``dl`` counts all n-grams. Documents without asked n-grams have empty lists.
    """
    rows = spread(corpus.select("id", "text", *keep).filter(F.col("id").isNotNull() & (F.trim("text") != "")), "id")
    rows = rows.select("id", *keep, tokens(F.col("text")).alias("ws"))
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in bounded(b, "ws", TOKENS)):
            lists = batch.column("ws")
            doc, node, times = asked.found(lists)
            at = pa.array(np.searchsorted(doc, np.arange(len(lists) + 1)).astype(np.int32))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            dl = sum(np.maximum(n - i, 0) for i in range(asked.upto))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(dl), *[pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (node, times)]],
                [*names, "dl", "nodes", "times"])

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(run, f"{fields}, dl long, nodes array<int>, times array<int>")


def dense(asked: Asked, weight: np.ndarray, part: Callable[[np.ndarray, np.ndarray], np.ndarray], batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their scores by every query, and which of them share an n-gram.

    ``weight`` belongs to the cells of ``asked``, ``part`` is a node's share by times and
    length of the document.
    """
    order = np.argsort(asked.node, kind="stable")
    cell_query, cell_weight = asked.query[order], weight[order]
    first = np.searchsorted(asked.node[order], np.arange(len(asked.keys) + 1))
    width = len(asked.ids)
    nodes = batch.column("nodes")
    doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(nodes).to_numpy(zero_copy_only=False))
    # Common n-grams belong to many queries, so a row counts by what it unfolds to.
    wide = np.bincount(doc, np.diff(first)[nodes.flatten().to_numpy(zero_copy_only=False)], batch.num_rows)
    for lo, hi in cuts(np.maximum(wide, width), CELLS):
        rows = batch.slice(lo, hi - lo)
        sizes = pc.list_value_length(rows.column("nodes")).to_numpy(zero_copy_only=False)
        node, times = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nodes", "times"))
        doc = np.repeat(np.arange(rows.num_rows), sizes)
        share = part(times.astype(float), rows.column("dl").to_numpy(zero_copy_only=False)[doc])
        n = first[node + 1] - first[node]
        at = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(doc, n) * width + cell_query[at]
        shape = (rows.num_rows, width)
        scores = np.bincount(cell, np.repeat(share, n) * cell_weight[at], minlength=shape[0] * width).reshape(shape)
        yield slice(lo, lo + rows.num_rows), np.round(scores, DIGITS) + 0.0, np.bincount(cell, minlength=shape[0] * width).reshape(shape) > 0


def reaching(scores: np.ndarray, k: int, keys: np.ndarray | None) -> np.ndarray:
    """Each query's k-th best score among different ``keys`` (all rows without); -inf where there are fewer."""
    if keys is not None:
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        scores = np.maximum.reduceat(scores[order], first, axis=0)
    if len(scores) <= k:
        return np.full(scores.shape[1], -np.inf)
    return np.partition(scores, -k, axis=0)[-k]


def places(ids: pd.Series) -> np.ndarray:
    """The place of each row in the order of its id."""
    out = np.empty(len(ids), np.int64)
    out[ids.reset_index(drop=True).sort_values(kind="stable").index] = np.arange(len(ids))
    return out


def best_cells(scores: np.ndarray, place: np.ndarray, k: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and query of each query's best ``k`` cells (of different ``keys``), ties by ``place``; -inf is none.

    Copies and ties are cut on numbers, before rows are made of them.
    """
    row, query = np.nonzero((scores > -np.inf) & (scores >= reaching(scores, k, keys)))
    order = np.lexsort((place[row], -scores[row, query], query))
    row, query = row[order], query[order]
    if keys is not None:
        first = np.sort(np.unique(query * (int(keys.max(initial=0)) + 1) + keys[row], return_index=True)[1])
        row, query = row[first], query[first]
    near = np.arange(len(query)) - np.searchsorted(query, query) < k
    return row[near], query[near]


class Best:
    """The best ``k`` rows of each query so far; with a column ``_key``, the best row of k keys."""

    def __init__(self, k: int, distinct: bool):
        self.k, self.distinct, self.held = k, distinct, None

    def add_block(self, table: pd.DataFrame, scores: np.ndarray, inside: np.ndarray, ids: list) -> None:
        """Rows of ``table`` by their scores for every query, where ``inside`` is set."""
        if not len(table):
            return
        scores = np.where(inside, scores, -np.inf)
        keys = pd.factorize(table["_key"], use_na_sentinel=False)[0] if self.distinct else None
        row, query = best_cells(scores, places(table["id"]), self.k, keys)
        part = table.iloc[row].reset_index(drop=True)
        part.insert(0, "query_id", pd.Series(ids, dtype=None).iloc[query].to_numpy())
        self.add(part.assign(score=scores[row, query]))

    def add(self, part: pd.DataFrame) -> None:
        rows = part if self.held is None else pd.concat([self.held, part], ignore_index=True)
        rows = rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
        if self.distinct:
            rows = rows.drop_duplicates(["query_id", "_key"])
        self.held = rows.groupby("query_id", sort=False).head(self.k)


def scored(rows: DataFrame, asked: Asked, weight: np.ndarray, part: Callable, k: int | None, query_type: str, distinct: bool = False) -> DataFrame:
    """``query_id, id, score`` of all pairs that share an n-gram; with ``k``, each task's best
    (of different ``_key`` if ``distinct``) with ``hits, low, high`` over the pairs it saw."""
    kinds = dict(rows.dtypes)
    fields = f"query_id {query_type}, id {kinds['id']}" + ", _key string" * distinct + ", score double"
    ids = pd.Series(asked.ids)
    names = ["id"] + ["_key"] * distinct

    def picked(table: pd.DataFrame, scores: np.ndarray, pick: np.ndarray) -> pd.DataFrame:
        row, query = np.nonzero(pick)
        out = table.iloc[row].reset_index(drop=True)
        out.insert(0, "query_id", ids.iloc[query].to_numpy())
        return out.assign(score=scores[row, query])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hits, low, high = Best(k or 0, distinct), np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        for batch in batches:
            for at, scores, inside in dense(asked, weight, part, batch):
                table = pa.table([batch.column(c)[at] for c in names], names).to_pandas()
                if k is None:
                    yield from pa.Table.from_pandas(picked(table, scores, inside), preserve_index=False).to_batches()
                    continue
                hits += inside.sum(axis=0)
                low = np.minimum(low, np.where(inside, scores, np.inf).min(axis=0))
                high = np.maximum(high, np.where(inside, scores, -np.inf).max(axis=0))
                best.add_block(table, scores, inside, asked.ids)
        if best.held is not None and len(best.held):
            query = best.held["query_id"].map({q: i for i, q in enumerate(asked.ids)}).to_numpy()
            out = best.held.assign(hits=hits[query], low=low[query], high=high[query])
            # The count of a task is carried by one row per query.
            out["hits"] = out["hits"].where(~out.duplicated("query_id"), 0)
            yield from pa.Table.from_pandas(out, schema=schema, preserve_index=False).to_batches()

    spark = rows.sparkSession
    if k is not None:
        fields += ", hits long, low double, high double"
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], fields).schema])
    cols = ["id", *["_key"] * distinct, "dl", "nodes", "times"]
    return rows.filter(F.size("nodes") > 0).select(*cols).mapInArrow(run, fields)


PARTS = 4096  # ranges of hashes, so that what a task sums up stays small
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    """Every bit of 64-bit numbers spread over the whole."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _batch_frequencies(lists: pa.Array, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a batch's n-grams and the number of its documents that hold each."""
    coded = lists.flatten().dictionary_encode()
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    words = words[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists), dtype=np.uint64), sizes)
    found, h, at = [], words, np.arange(len(words))
    for n in range(1, upto + 1):
        if n > 1:
            at = at[at + n - 1 < len(words)]
            at = at[doc[at + n - 1] == doc[at]]
            h = _spread(h[: len(words) - n + 1] * _STEP + words[n - 1 :])
        own = h[at]
        _, once = np.unique(_spread(own + _spread(doc[at] + np.uint64(1))), return_index=True)
        found.append(own[once])
    return np.unique(np.concatenate(found), return_counts=True)


def _narrow(values: np.ndarray, starts: list[int] | None = None) -> np.ndarray:
    """Numbers as rows of bytes, without the high ones that all of them lack; what stands at ``starts`` is not needed."""
    values = values.astype("<u8")
    if starts is not None:
        values[[i for i in starts if i < len(values)]] = 0
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width])


def _wide(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers that ``_narrow`` packed."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        rows = np.frombuffer(data, np.uint8).reshape(n, -1)
        out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel()


def packed(h: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Ranges of sorted hashes ``h`` and their counts ``n``."""
    edges = np.searchsorted(h, np.arange(PARTS, dtype=np.uint64) << np.uint64(52)).tolist() + [len(h)]
    steps, counts = _narrow(np.diff(h, prepend=h[:1]), starts=edges[:-1]), _narrow(n)
    width = bytes([counts.shape[1]])
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield part, h[a : a + 1].astype("<u8").tobytes() + steps[a + 1 : b].tobytes(), width + counts[a:b].tobytes()


def unpacked(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A range's hashes, from the first one and the steps to the others, and their counts, from their width and bytes."""
    size = (len(n) - 1) // n[0]
    steps = np.concatenate([np.frombuffer(h[:8], "<u8"), _wide(h[8:], size - 1)])
    return np.cumsum(steps, dtype=np.uint64), _wide(n[1:], size).astype(np.int64)


def frequencies(corpus: DataFrame, tokens: Callable[[Column], Column], upto: int) -> DataFrame:
    """``n, m``: how many different n-grams occur in how many documents, counted on 64-bit hashes.

    Hashes move as packed ranges, counted per batch before they do: sorted, so that a hash is the step
    from the one before, in as many bytes as the batch's longest step takes.
    """
    rows = spread(corpus.select("id", "text").filter(F.col("id").isNotNull() & (F.trim("text") != "")), "id").select(tokens(F.col("text")).alias("ws"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in bounded(b, "ws", TOKENS)):
            h, n = _batch_frequencies(batch.column(0), upto)
            columns = list(zip(*packed(h, n))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "h", "n"])

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        h, n = (np.concatenate(x) for x in zip(*held))
        h, where = np.unique(h, return_inverse=True)
        return [(h, np.bincount(where, n, len(h)).astype(np.int64))]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, sums = None, [], Counter()

        def close() -> None:
            if held:
                sums.update(dict(zip(*(x.tolist() for x in np.unique(add(held)[0][1], return_counts=True)))))

        for batch in batches:
            for p, h, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != part:
                    close()
                    part, held = p, []
                held.append(unpacked(h, n))
                if len(held) > 64:
                    held = add(held)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["n", "m"])

    ranges = rows.mapInArrow(count, "part int, h binary, n binary")
    parts = ranges.repartition("part").sortWithinPartitions("part").mapInArrow(total, "n long, m long")
    return parts.groupBy("n").agg(F.sum("m").alias("m"))
