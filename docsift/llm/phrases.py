"""Phrase collocations by prefix-free parsing.

Pieces of text are parsed into chunks that end where the last words' hash says so, thus
at the same places wherever a passage occurs, and that begin with the words of the window
that ended the chunk before. A chunk is kept once with its frequency, so repeated passages
are counted once, weighted. Phrases are counted inside the distinct chunks; one that lies
within the overlap belongs to the chunk before, so each occurrence counts once.

Most phrases are rare. A first pass over the dictionary sums phrases by hash into a table
of at most 2^MOST_BITS buckets; only phrases of buckets that reach the least frequency are
counted by their words in the second. The table is the only thing that every task gets.
Beyond some billions of different phrases most buckets reach it, and the second pass
moves most phrases: then it costs more, and counts the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import gathered, pack, unpack
from .segments import Words, byte_values, buffer_of, hashes, mixed, separators, stretches
from .shared import stored

LONGEST = 4  # words of a phrase
OVERLAP = LONGEST - 1  # words of the window, and of the overlap
MODULUS = 16  # a window in so many ends a chunk
FORCED = 256  # words after which a chunk ends in any case
STRETCH = 1 << 22  # bytes of texts parsed at a time
BLOCK = 1 << 22  # bytes of chunks counted at a time
HELD = 1 << 21  # buckets of earlier blocks that wait to be put out together
RANGE_BITS = 12  # the table's parts: 4,096
LEAST_BITS, MOST_BITS = 18, 28
FULL = 255  # buckets count no further

# What parts pieces, [.,;:!?\x0A-\x0D], and words, [\x20\x09].
PARTS = separators((0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
GAPS = PARTS | separators((0x20, 0x20), (0x09, 0x09))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def parsed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts: their words, whether an overlap leads, the text's row, and the number of new words."""
    words = Words(texts, GAPS)
    n = len(words.start)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    upto = np.zeros(len(words.data) + 1, np.int32)
    np.cumsum(PARTS[words.data], out=upto[1:])
    opens = np.ones(n, bool)  # first words of pieces
    opens[1:] = (row[1:] != row[:-1]) | (upto[words.start[1:]] != upto[words.end[:-1]])
    place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    window = words.hash * _MIX[0]
    for back in range(1, OVERLAP):
        window[back:] += words.hash[:-back] * _MIX[back]
    ends = (mixed(window) % np.uint64(MODULUS) == 0) & (place >= OVERLAP - 1)
    ends |= place % FORCED == FORCED - 1
    ends[:-1] |= opens[1:]
    ends[-1] = True
    last = np.flatnonzero(ends)
    new = np.concatenate([[0], last[:-1] + 1])
    led = ~opens[new]
    start = words.start[new - OVERLAP * led]
    size = words.end[last] - start
    data = gathered(LOWER[words.data], start, size)
    chunks = pa.Array.from_buffers(pa.large_string(), len(last), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)])
    return chunks, led, row[new], last - new + 1


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct chunks of each stretch of texts."""
    for batch in batches:
        langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
        for lo, hi in stretches(texts.cast(pa.large_binary()), STRETCH):
            chunks, led, row, new = parsed(texts[lo:hi])
            if not len(chunks):
                continue
            coded, lang = chunks.dictionary_encode(), langs.indices.to_numpy(zero_copy_only=False)[lo:hi][row].astype(np.int64)
            key = (coded.indices.to_numpy(zero_copy_only=False) * np.int64(len(langs.dictionary)) + lang) * 2 + led
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[first])), pa.array(led[first]), chunks.take(pa.array(first)).cast(pa.string()), pa.array(new[first].astype(np.int32)),
                 pa.array(times)], ["lang", "led", "chunk", "new", "n"])


class Block:
    """Words of distinct chunks, coded, and the phrases that end in them."""

    def __init__(self, table: pa.Table):
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lists = pc.ascii_split_whitespace(table.column("chunk").combine_chunks().cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        self.langs, self.words = langs.dictionary, coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        at = lists.offsets.to_numpy(zero_copy_only=False)
        sizes = np.diff(at)
        chunk = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = np.arange(len(chunk), dtype=np.int32) - (at[:-1] - at[0]).astype(np.int32)[chunk]
        led = table.column("led").to_numpy()
        self.own = self.place >= OVERLAP * led[chunk]  # not of the overlap
        self.times = table.column("n").to_numpy()[chunk]
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[chunk]

    def ends(self, size: int) -> np.ndarray:
        """Where a phrase of so many words ends."""
        return np.flatnonzero(self.own & (self.place >= size - 1))

    def hashed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size of phrases from two words on: where they end, and their hashes."""
        table = byte_values(False)
        of = lambda values: hashes(table[buffer_of(values)[0]], buffer_of(values)[1][:-1], buffer_of(values)[1][1:])
        words, h = of(self.words)[self.code], of(self.langs)[self.lang]
        h = mixed(h + words)
        for size in range(2, LONGEST + 1):
            longer = np.zeros_like(h)
            longer[1:] = mixed(h[:-1] * _MIX[0] + words[1:])
            h = longer
            at = self.ends(size)
            yield size, at, h[at]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("chunk").nbytes
        if size >= BLOCK:
            yield Block(pa.Table.from_batches(held))
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield Block(pa.Table.from_batches(held))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    order = np.argsort(keys, kind="stable")  # merges what is sorted
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def bucket_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = bits - RANGE_BITS

        def packed(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            edges = np.searchsorted(keys, np.arange((1 << RANGE_BITS) + 1) << inner)
            rows = [(r, pack(np.diff(keys[a:b], prepend=r << inner)), pack(times[a:b]))
                    for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "steps", "times"])

        none = np.zeros(0, np.int32)
        held = none, none
        for block in blocks(batches):
            for _, at, h in block.hashed():
                found = summed((h >> np.uint64(64 - bits)).astype(np.int32), block.times[at])
                keys, times = summed(*(np.concatenate(x) for x in zip(held, found)))
                held = keys, np.minimum(times, FULL).astype(np.int32)
            if len(held[0]) >= HELD:
                yield packed(*held)
                held = none, none
        if len(held[0]):
            yield packed(*held)

    return run


def full_buckets(bits: int, least: int):
    """Rows sorted by part; one row of bits for each, set where the bucket reaches ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, np.zeros(1 << (bits - RANGE_BITS), np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if part is not None:
                        yield row()
                    part = r["part"]
                    sums[:] = 0
                sums[np.cumsum(unpack(r["steps"]), dtype=np.int64)] += unpack(r["times"])
        if part is not None:
            yield row()

    return run


def phrase_counts(table, bits: int):
    """Phrases of full buckets and all words, with their counts in each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = table.value
        for block in blocks(batches):
            own = block.ends(1)
            found = [(1, own)]
            for size, at, h in block.hashed():
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                found.append((size, at[(full[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1]))
            for size, at in found:
                # Numbers of the phrases, exactly: those of their beginnings and the next word.
                number = block.lang[at].astype(np.int64)
                for back in range(size - 1, -1, -1):
                    _, number = np.unique(number * len(block.words) + block.code[at - back], return_inverse=True)
                _, first = np.unique(number, return_index=True)
                times = np.zeros(len(first), np.int64)
                np.add.at(times, number, block.times[at])
                at = at[first]
                phrase = [block.words.take(pa.array(block.code[at - back])).cast(pa.large_string()) for back in range(size - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*phrase, pa.scalar(" ", pa.large_string())) if size > 1 else phrase[0]
                for lo in range(0, len(at), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([block.langs.take(pa.array(block.lang[at[part]])), pa.array(np.full(len(at[part]), size, np.int32)),
                                                      phrase[part].cast(pa.string()), pa.array(times[part])], ["lang", "size", "phrase", "n"])

    return run


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, led, chunk, new, n``: distinct chunks and how often each occurs, stored.

    ``led`` chunks begin with an overlap of three words; ``new`` is the number of others.
    """
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text")).filter("text IS NOT NULL")
    found = rows.mapInArrow(parse, "lang string, led boolean, chunk string, new int, n long")
    return stored(found.groupBy("lang", "led", "chunk").agg(F.first("new").alias("new"), F.sum("n").alias("n")))


def counts(chunks: DataFrame, least: int) -> DataFrame:
    """``lang, size, phrase, f``: all words, and the phrases that occur ``least`` times or more.

    Stored, with the words of rare phrases left out; rare words stay.
    """
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("new")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length()))
    sums = chunks.mapInArrow(bucket_counts(bits), "part int, steps binary, times binary")
    full = sums.repartition("part").sortWithinPartitions("part").mapInArrow(full_buckets(bits, min(least, FULL)), "part int, bits binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    width = len(table) >> RANGE_BITS
    for row in full.toLocalIterator():  # of fixed size: 32 MB at most
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    found = chunks.mapInArrow(phrase_counts(spark.sparkContext.broadcast(table), bits), "lang string, size int, phrase string, n long")
    found = found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    return stored(found.filter((F.col("size") == 1) | (F.col("f") >= least)))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to 4 words.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the two parts of its weakest
    cut, ``n`` the language's words, ``score`` is 2,000,000 a / (l + r), rounded down. A phrase
    within a longer one that has at least 80 % of its occurrences is left out. Texts are
    lowered (A-Z) and parted at ``.,;:!?`` and line ends; phrases don't reach over those.

    Null and empty texts have no words; a null language is ``und``; repeated rows count
    again; an empty table gives no rows. Other columns are not read. Ties go to more
    occurrences, then to the phrase's bytes.
    """
    known = counts(dictionary(docs, text, lang), least)
    words = known.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    big = known.filter(F.col("f") >= least)
    long = big.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("_left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        of = big.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = cuts.join(of, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter phrase inside a longer one.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = long.filter("size > 2").select(F.col("lang").alias("_lang"), F.col("a").alias("_longer"), F.explode(inner).alias("_part"))
    inside = inside.groupBy("_lang", "_part").agg(F.max("_longer").alias("_longer"))
    kept = scored.join(inside, F.expr("lang = _lang AND phrase = _part"), "left")
    kept = kept.filter(F.col("_longer").isNull() | (exact("_longer") * 100 < exact("a") * 80))
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    rows = kept.withColumn("rank", best.cast("long")).filter(F.col("rank") <= top).join(words.withColumnRenamed("lang", "_of"), F.expr("lang = _of"))
    return rows.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
