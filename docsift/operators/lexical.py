"""Keyword search by substring: match ratio, frequency and position.

A keyword consists of letters, digits and underscores, so it can only stand inside one run
of those. The automaton therefore runs once per distinct run of a batch, not over the
texts; what it finds goes back to the documents by the runs' numbers and places.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import SPACES
from ..functions.tokens import keywords
from ..session import localized
from .grams import CELLS, Best
from .layout import bounded, spread, unfold
from .ranking import DIGITS, fixed, keep_first, top_k

# Distinct keywords one automaton holds; larger sets are searched block by block.
BLOCK = 100_000
# Bytes of texts that a task searches at once, and runs whose keywords it remembers.
BYTES, RUNS = 2 << 20, 200_000


@lru_cache(maxsize=1)
def _inside() -> np.ndarray:
    """Which code points are letters, numbers or underscores."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    out[ord("_")] = True
    return out


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    """Which code points are white space."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in SPACES]] = True
    return out


def _starts(inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where runs of true values begin; none reaches over the beginning of a text."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[first[first < len(inside)]] = False
    return np.flatnonzero(inside & ~before)


def _runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word characters of all texts, coded, the row of each and its place in the text;
    and the number of words between white space of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    whole = "".join(texts.to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    inside = _inside()[points]
    start = _starts(inside, first)
    spoken = np.searchsorted(_starts(~_blank()[points], first), np.append(first, len(points)))
    # Everything else becomes a blank, and the runs are what stands between blanks.
    data = np.frombuffer(whole.encode(), np.uint8).copy()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(lead, len(data)))
    data[np.repeat(~inside, width)] = 0x20
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    blanked = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(data)])
    runs = pc.ascii_split_whitespace(blanked).flatten()
    runs = runs.filter(pc.greater(pc.binary_length(runs), 0)).dictionary_encode()
    row = np.searchsorted(first, start, "right") - 1
    return runs, row, start - first[row], np.diff(spoken)


class Finder:
    """Documents of a batch -> the keywords in them, with first position and count.

    Occurrences of one keyword that overlap each other count once, as ``str.count`` does.
    """

    def __init__(self, keys: list[str]):
        self.n, self.machine = len(keys), ahocorasick.Automaton()
        for i, key in enumerate(keys):
            self.machine.add_word(key, (i, key))
        self.machine.make_automaton()
        self._forget()

    def _forget(self) -> None:
        """Runs seen before have a number; what they hold stands in ``cells``, up to ``ends`` of the number."""
        self.known: dict[str, int] = {}
        self.cells, self.ends = array("q"), array("q", [0])

    def of_run(self, run: str) -> Iterator[tuple[int, int, int]]:
        """Keyword, first position and count in one run."""
        seen: dict[int, list[int]] = {}
        for end, (key, text) in self.machine.iter(run):
            begin = end - len(text) + 1
            if key not in seen:
                seen[key] = [begin, 1, end]
            elif begin > seen[key][2]:
                seen[key][1:] = [seen[key][1] + 1, end]
        return ((key, begin, n) for key, (begin, n, _) in seen.items())

    def of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keyword, first position and count of what the runs hold, and where each run's begin; runs seen before are looked up."""
        if len(self.known) > RUNS:
            self._forget()
        for run in runs:
            if run not in self.known:
                self.known[run] = len(self.known)
                for x in self.of_run(run):
                    self.cells.extend(x)
                self.ends.append(len(self.cells) // 3)
        number = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        # Copies, as an array that is looked into can't grow.
        ends, cells = np.array(self.ends, np.int64), np.array(self.cells, np.int64).reshape(-1, 3)
        n = ends[number + 1] - ends[number]
        first = np.concatenate([[0], np.cumsum(n)])
        return cells[np.repeat(ends[number] - first[:-1], n) + np.arange(first[-1])], first

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, keyword, first, n`` in order of row, and the words of each text."""
        runs, row, place, spoken = _runs(texts)
        code = runs.indices.to_numpy(zero_copy_only=False)
        cells, first = self.of_runs(runs.dictionary.to_pylist())
        n = first[code + 1] - first[code]
        at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        where = np.repeat(place, n) + cells[at, 1]
        # Runs come in order, so the first of a pair is its first position.
        pair, once, back = np.unique(np.repeat(row, n) * self.n + cells[at, 0], return_index=True, return_inverse=True)
        return pair // self.n, pair % self.n, where[once], np.bincount(back, cells[at, 2], len(pair)).astype(np.int64), spoken


def _matcher(keys: list[str], names: list[str]):
    """Task function: documents -> their columns ``names``, their words, and a row for each keyword in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(keys) if keys else None
        for batch in (part for b in batches for part in bounded(b, "text", BYTES)) if finder else ():
            row, key, first, n, spoken = finder.found(batch.column("text"))
            out = [*[batch.column(c) for c in names], pa.array(spoken.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(row)) for c in out], pa.array(keys, pa.string()).take(pa.array(key)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                [*names, "words", "keyword", "first", "n"])

    return run


class Asked:
    """Keywords of a bounded query set: ``keys``, the queries' ``ids`` and number of keywords with repeats."""

    def __init__(self, rows: list):
        self.keys, self.ids = sorted({r["keyword"] for r in rows}), list(dict.fromkeys(r["query_id"] for r in rows))
        number, query = {key: i for i, key in enumerate(self.keys)}, {q: i for i, q in enumerate(self.ids)}
        self.total = np.zeros(len(self.ids), np.int64)
        self.total[[query[r["query_id"]] for r in rows]] = [r["k"] for r in rows]
        cells = np.array(sorted((number[r["keyword"]], query[r["query_id"]], r["times"]) for r in rows), np.int64).reshape(-1, 3)
        self.first, self.query, self.times = np.searchsorted(cells[:, 0], np.arange(len(self.keys) + 1)), cells[:, 1], cells[:, 2]

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut to what a task searches and scores at once."""
        step = max(1, CELLS // (4 * len(self.ids)))
        for batch in batches:
            for part in bounded(batch, "text", BYTES):
                yield from (part.slice(lo, step) for lo in range(0, part.num_rows, step))

    def found(self, batch: pa.RecordBatch, finder: Finder) -> tuple[np.ndarray, ...]:
        """``cell, times, n, at, key`` in order of row and keyword, where a cell is row times queries
        plus query; and the words of each text."""
        row, key, at, n, spoken = finder.found(batch.column("text"))
        many = self.first[key + 1] - self.first[key]
        inner = np.repeat(self.first[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cell = np.repeat(row, many) * len(self.ids) + self.query[inner]
        return cell, self.times[inner], np.repeat(n, many), np.repeat(at, many), np.repeat(key, many), spoken


def _arrow(df: DataFrame, fields: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in df.sparkSession.createDataFrame([], fields).schema])


def _best(rows: DataFrame, asked: Asked, k: int, position: bool, distinct: bool, query_type: str) -> DataFrame:
    """Each task's best ``k`` per query; scores of a batch are a dense block, documents by queries."""
    names, kinds, width = ["id", *["_key"] * distinct], dict(rows.dtypes), len(asked.ids)
    schema = f"query_id {query_type}, id {kinds['id']}, {'_key string, ' * distinct}score double"
    arrow = _arrow(rows, schema)

    def scored(batch: pa.RecordBatch, finder: Finder) -> tuple[np.ndarray, np.ndarray]:
        cell, times, n, at, _, spoken = asked.found(batch, finder)
        add = lambda w: np.bincount(cell, w, batch.num_rows * width).reshape(batch.num_rows, width)
        hits, found, places = add(times), add(times * n), add(times * at)
        often = found / np.maximum(spoken, 1)[:, None]
        score = hits / asked.total * 0.5 + often * (0.3 if position else 0.5)
        if position:
            chars = batch.column("chars").to_numpy(zero_copy_only=False)[:, None]
            score += np.maximum((chars - places / np.maximum(hits, 1)) / np.maximum(chars, 1), 0.0) * 0.2
        return np.round(np.minimum(score, 1.0), DIGITS), hits > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, best = Finder(asked.keys), Best(k, distinct)
        for part in asked.parts(batches):
            scores, inside = scored(part, finder)
            best.add_block(pa.table([part.column(c) for c in names], names).to_pandas(), scores, inside, asked.ids)
        if best.held is not None:
            yield from pa.Table.from_pandas(best.held, schema=arrow, preserve_index=False).to_batches()

    return rows.mapInArrow(run, schema)


def _pairs(rows: DataFrame, asked: Asked, keep: list[str], names: bool, query_type: str) -> DataFrame:
    """What a document and a query share, pair by pair, summed in the document's task; nothing is shuffled."""
    columns, kinds = ["id", *keep, "chars"], dict(rows.dtypes)
    schema = f"query_id {query_type}, k long, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    schema += ", words int, hits long, occurrences long, positions long" + ", matched_keywords array<string>" * names
    arrow = _arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(asked.keys)
        ids, keys = pa.array(asked.ids, arrow.field("query_id").type), pa.array(asked.keys, pa.string())
        for part in asked.parts(batches):
            cell, times, n, at, key, spoken = asked.found(part, finder)
            # A stable order leaves the keywords of a pair in theirs.
            order = np.argsort(cell, kind="stable")
            pair, start = np.unique(cell[order], return_index=True)
            if not len(pair):
                continue
            row, query = np.divmod(pair, len(asked.ids))
            sums = [np.add.reduceat(x[order], start) for x in (times, times * n, times * at)]
            out = [ids.take(pa.array(query)), pa.array(asked.total[query]), *[part.column(c).take(pa.array(row)) for c in columns]]
            out += [pa.array(spoken[row].astype(np.int32)), *map(pa.array, sums)]
            if names:
                ends = pa.array(np.append(start, len(order)).astype(np.int32))
                out.append(pa.ListArray.from_arrays(ends, keys.take(pa.array(key[order]))))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _documents(corpus: DataFrame, keep: list[str]) -> DataFrame:
    docs = spread(corpus.select("id", "text", *keep), "id").select("id", *keep, F.lower("text").alias("text"))
    return docs.withColumn("chars", F.length("text"))


def matches(corpus: DataFrame, keys: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``id, chars, words, keyword, first, n`` (and columns ``keep``) for each keyword found in a text."""
    columns = ["id", *(keep or []), "chars"]
    docs = _documents(corpus, keep or [])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", words int, keyword string, first int, n int"
    found = None
    for block in _blocks(keys):
        rows = docs.mapInArrow(_matcher(block, columns), schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def _blocks(keys: DataFrame) -> list[list[str]]:
    """The keywords in blocks of bounded size; one empty block when there are none."""
    head = [r["keyword"] for r in keys.limit(BLOCK + 1).collect()]
    if len(head) <= BLOCK:
        return [head]
    n = -(-keys.count() // BLOCK)
    part = lambda b: keys.filter(F.pmod(F.xxhash64("keyword"), F.lit(n)) == b)
    return [[r["keyword"] for r in part(b).collect()] for b in range(n)]


def _asked(queries: DataFrame) -> DataFrame:
    """``query_id, keyword, times, k``: a query's keywords, and how many it has with repeats."""
    return (
        unfold(queries, ["query_id"], keywords(F.col("text")), "keyword")
        .groupBy("query_id", "keyword").agg(F.count("*").alias("times"))
        .withColumn("k", F.sum("times").over(W.partitionBy("query_id")))
    )


def _held(queries: DataFrame) -> Asked | None:
    """The queries' keywords, or None if there are none or too many for every task to hold."""
    rows = _asked(queries).limit(BLOCK + 1).collect()
    return Asked(rows) if 0 < len(rows) <= BLOCK else None


def _score(position: bool) -> Column:
    ratio = F.col("hits") / F.col("k")
    frequency = F.col("occurrences") / F.greatest("words", F.lit(1))
    early = F.greatest((F.col("chars") - F.col("positions") / F.col("hits")) / F.col("chars"), F.lit(0.0))
    return ratio * 0.5 + frequency * 0.3 + early * 0.2 if position else ratio * 0.5 + frequency * 0.5


def _joined(corpus: DataFrame, queries: DataFrame, keep: list[str], names: bool) -> DataFrame:
    """What a document and a query share, for query sets that tasks can't hold."""
    asked, _ = localized(_asked(queries))
    found = matches(corpus, asked.select("keyword").distinct(), keep)
    # A document's matches are in one task, so its sums are complete before they move.
    return found.join(asked, "keyword").groupBy("query_id", "k", "id", *keep, "chars", "words").agg(
        F.sum("times").alias("hits"),
        F.sum(F.col("times") * F.col("n")).alias("occurrences"),
        F.sum(F.col("times") * F.col("first")).alias("positions"),
        *[F.sort_array(F.collect_set("keyword")).alias("matched_keywords")] * names,
    )


def scores(corpus: DataFrame, queries: DataFrame, position: bool = True, keep: list[str] | None = None, names: bool = True) -> DataFrame:
    """``query_id, id, score, keyword_matches, matched_keywords``; texts without a hit are left out.

    A keyword a query repeats counts as often. Without ``position`` the frequency
    part weighs one half instead. Columns ``keep`` of the corpus stay; ``names=False``
    leaves the matched keywords out. A bounded query set is scored where the documents are;
    a larger one is joined by keyword.
    """
    keep = keep or []
    held = _held(queries)
    if held is not None:
        hit = _pairs(_documents(corpus, keep), held, keep, names, dict(queries.dtypes)["query_id"])
    else:
        hit = _joined(corpus, queries, keep, names)
    return hit.select(
        "query_id", "id", *keep, fixed(F.least(_score(position), F.lit(1.0))).alias("score"),
        F.col("hits").alias("keyword_matches"), *["matched_keywords"] * names,
    )


def top(corpus: DataFrame, queries: DataFrame, k: int, position: bool = True, key: Column | None = None) -> DataFrame:
    """Best ``k`` per query; with ``key``, of documents with equal keys only the best one counts.

    A bounded query set is scored where the documents are; a larger one is joined by keyword.
    """
    distinct = key is not None
    if distinct:
        corpus = corpus.select("id", "text", key.alias("_key"))
    held = _held(queries)
    if held is not None:
        rows = _best(_documents(corpus, ["_key"] * distinct), held, k, position, distinct, dict(queries.dtypes)["query_id"])
    else:
        rows = scores(corpus, queries, position, ["_key"] * distinct, names=False).drop("keyword_matches")
    if distinct:
        rows = keep_first(rows, ["query_id", "_key"], [F.desc("score"), F.col("id")])
    return top_k(rows, k, ["query_id"]).drop("_key")
