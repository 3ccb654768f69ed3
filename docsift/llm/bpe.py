"""Byte-level BPE over a whole corpus: every distinct word is encoded once.

Texts are cut into pre-tokens (here: words) in numpy. A block of documents keeps each
document as the numbers of its words in order - the positions - and sends its distinct
words, dealt by their hash, to the task that owns them. There a word is encoded once,
however many blocks sent it, and its ids go back to each of those blocks, where the
documents are put together by position. A frequent word travels once per block, so no
word is hot; blocks and buckets travel as compressed columns of numbers.

The documents are read twice (for their words, for their positions) rather than staged:
positions are as large as the corpus. A block is named by a digest of its contents, and
positions without their words end the job, so an input that changes between the two
readings is noticed.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .segments import buffer_of, hashes, mixed

PIECE = 1 << 18  # bytes cut into words at a time
BLOCK_WORDS = 1_000_000  # words after which a block ends
ROW_WORDS = 200_000  # words of documents that one row holds

# Code points with the Unicode property White_Space (fixed values).
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random number of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kinds[c] = LETTER if major == "L" else NUMBER
    for low, high in SPACES:
        kinds[low : high + 1] = SPACE
    return kinds, mixed(np.arange(1, 0x110001, dtype=np.uint64))


def word_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``borders`` are where texts begin.

    The pattern: 's 't 're 've 'm 'll 'd, runs of letters, of numbers or of other signs,
    each with a space before it, and white space. White space before something else
    leaves its last character over; a space then belongs to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kinds = tables()[0][points]
    first = np.zeros(n + 3, bool)
    first[borders[borders < n]] = True
    first[n:] = True
    kind, point = np.full(n + 3, SPACE, np.uint8), np.zeros(n + 3, points.dtype)
    kind[:n], point[:n] = kinds, points
    turn = first[:n].copy()
    turn[0] = True  # a piece begins with a text or with white space behind something else
    turn[1:] |= kinds[1:] != kinds[:-1]
    white = kinds == SPACE
    spaced = np.zeros(n, bool)  # behind a space of the same text
    spaced[1:] = (points[:-1] == 32) & ~first[1:n]
    # The last of a run of white space, if the text goes on.
    last = white & ~first[1 : n + 1] & (kind[1 : n + 1] != SPACE)
    starts = (turn & (white | ~spaced)) | last
    marks = np.flatnonzero((points == 39) & turn & ~spaced)
    if len(marks):
        a, b = point[marks + 1], point[marks + 2]
        one = ~first[marks + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~first[marks + 1] & ~first[marks + 2] & (
            ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        starts[marks[one | two] + 1] = False
        for at in (marks[one] + 2, marks[two] + 3):
            at = at[~first[at] & (kind[at] == LETTER)]
            starts[at] = True
    return starts


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end with a text or before white space."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + PIECE, n)
        k = int(np.searchsorted(at, hi, "right")) - 1
        if hi < n and at[k] > lo:
            hi = int(at[k])
        elif hi < n:  # inside one text: look for a space behind a character that is none
            end, hi = int(at[k + 1]), end if (end := int(at[k + 1])) <= hi else hi
            while hi < end:
                part = data[hi - 1 : min(hi + PIECE, end)]
                ok = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 127))
                if len(ok):
                    hi += int(ok[0])
                    break
                hi = min(hi + PIECE, end)
        yield lo, hi
        lo = hi


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, where words begin and end in them, the words' hashes, and each row's first word."""
    data, at = buffer_of(texts)
    values, starts, ends, found = tables()[1], [], [], []
    for lo, hi in pieces(data, at):
        part = data[lo:hi]
        inner = at[(at >= lo) & (at < hi)] - lo
        if part.max() < 128:
            points, places = part, None
        else:
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
            places = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
            inner = np.searchsorted(places, inner)
        s = np.flatnonzero(word_starts(points, inner))
        e = np.append(s[1:], len(points))
        found.append(hashes(values[points], s, e))
        starts.append((s if places is None else places[s]) + lo)
        ends.append((e if places is None else places[e]) + lo)
    none = np.zeros(0, np.int64)
    starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    return data, starts, ends, np.concatenate([none.astype(np.uint64), *found]), np.searchsorted(starts, at)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte columns."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=4 * n + 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` one behind the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return data[at]


class Block:
    """Documents of one stretch of a task's input."""

    def __init__(self, keep_words: bool):
        self.keep, self.digest = keep_words, hashlib.blake2b(digest_size=16)
        self.docs: list[tuple[pa.Array, np.ndarray]] = []  # ids and words per document
        self.hashes: list[np.ndarray] = []
        self.seen = np.zeros(0, np.uint64)
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hash, bytes, size
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, starts, ends, found, first = cut(texts)
        self.digest.update(len(texts).to_bytes(8, "little"))
        # Where one text ends and the next begins decides on the words, too.
        self.digest.update(pa.compute.binary_length(texts).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).tobytes())
        self.digest.update(data)
        self.size += len(found)
        self.hashes.append(found)
        if self.keep:
            new, where = np.unique(found, return_index=True)
            fresh = ~np.isin(new, self.seen, assume_unique=True)
            new, where = new[fresh], where[fresh]
            size = ends[where] - starts[where]
            self.words.append((new, gathered(data, starts[where], size), size))
            self.seen = np.concatenate([self.seen, new])
        else:
            self.docs.append((ids, np.diff(first)))

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in order, and each one's number; frequent words get small numbers."""
        known, counts = np.unique(np.concatenate(self.hashes), return_counts=True)
        number = np.empty(len(known), np.int64)
        number[np.lexsort((known, -counts))] = np.arange(len(known))
        return known, number


def blocks(batches: Iterator[pa.RecordBatch], keep_words: bool) -> Iterator[Block]:
    block = Block(keep_words)
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            # As many rows as stay near ROW_WORDS, counted in bytes.
            sizes = pa.compute.binary_length(batch.column(1)[lo:].cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
            n = max(1, int(np.searchsorted(np.cumsum(sizes), 5 * ROW_WORDS)))
            block.add(batch.column(0)[lo : lo + n], batch.column(1)[lo : lo + n])
            lo += n
            if block.size >= BLOCK_WORDS:
                yield block
                block = Block(keep_words)
    if block.hashes:
        yield block


# Kinds of rows that meet at a block: ids of its words, its documents.
WORDS, DOCS = 0, 1


def distinct_words(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, True):
            known, number = block.numbered()
            found, data, size = (np.concatenate(x) for x in zip(*block.words))
            at = np.argsort(found)
            start, size = (np.cumsum(size) - size)[at], size[at]
            owner = (known % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((number, owner))
            edges = np.searchsorted(owner[order], np.arange(n_buckets + 1))
            out = []
            for b in range(n_buckets):
                part = order[edges[b] : edges[b + 1]]
                if len(part):
                    words = gathered(data, start[part], size[part]).tobytes()
                    steps = np.diff(number[part], prepend=0)
                    out.append((b, block.digest.digest(), pack(steps), pack(size[part]), zstandard.ZstdCompressor(level=3).compress(words)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "block", "steps", "sizes", "words"])

    return run


def meeting(block: bytes, kind: int, part: int, ids: pa.Array, a: bytes, b: bytes, c: bytes) -> pa.RecordBatch:
    """One row of what meets at a block."""
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.binary()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()),
         pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in (a, b, c)]],
        ["block", "kind", "part", "ids", "a", "b", "c"])


def positions(id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, False):
            known, number = block.numbered()
            for i, ((ids, lengths), found) in enumerate(zip(block.docs, block.hashes)):
                codes = number[np.searchsorted(known, found)]
                yield meeting(block.digest.digest(), DOCS, i, ids.cast(id_type), pack(lengths), pack(codes), b"")

    return run


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_encoders: dict[tuple, tiktoken.Encoding] = {}


def encoder(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    """The merges of one word, built once per worker."""
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


# What cut() implements (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encode_words(ranks, id_type: pa.DataType) -> Callable:
    """Rows sorted by bucket; every distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, bucket, known = encoder(ranks.value, PATTERN).encode_ordinary, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                raw = zstandard.ZstdDecompressor().decompress(row["words"])
                ends = np.cumsum(unpack(row["sizes"]), dtype=np.int64).tolist()
                lists, lo = [], 0
                for hi in ends:
                    word = raw[lo:hi]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = merge(word.decode())
                    lists.append(ids)
                    lo = hi
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((i for ids in lists for i in ids), np.int64, int(counts.sum()))
                yield meeting(row["block"], WORDS, bucket, pa.nulls(0, id_type), row["steps"], pack(counts), pack(flat))

    return run


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the words' rows first: ids of every document by position."""
    block, bucket, numbers, counts, flats, look = None, None, [], [], [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            if row["block"].as_py() != block:
                block, bucket, numbers, counts, flats, look = row["block"].as_py(), None, [], [], [], None
            if row["kind"].as_py() == WORDS:
                if row["part"].as_py() == bucket:
                    continue  # from another block with the same texts
                bucket = row["part"].as_py()
                numbers.append(np.cumsum(unpack(row["a"].as_py()), dtype=np.int64))
                counts.append(unpack(row["b"].as_py()).astype(np.int64))
                flats.append(unpack(row["c"].as_py()))
                continue
            if look is None:
                look = Lookup(numbers, counts, flats)
                numbers, counts, flats = [], [], []
            ids, lengths = row["ids"].values, unpack(row["a"].as_py()).astype(np.int64)
            found, sizes = look.ids(unpack(row["b"].as_py()))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
            for lo, hi in slices(np.diff(ends)):
                offsets = (ends[lo : hi + 1] - ends[lo]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[ends[lo] : ends[hi]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], lists], ["doc_id", "ids"])


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ROW_WORDS values each."""
    group = np.cumsum(sizes) // ROW_WORDS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


class Lookup:
    """Ids of the words of one block by their numbers."""

    def __init__(self, numbers: list[np.ndarray], counts: list[np.ndarray], flats: list[np.ndarray]):
        number, count = np.concatenate([np.zeros(0, np.int64), *numbers]), np.concatenate([np.zeros(0, np.int64), *counts])
        self.flat = np.concatenate([np.zeros(0, np.uint32), *flats])
        self.count, self.start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        if len(number) and (number.max() >= len(number) or len(np.unique(number)) < len(number)):
            raise RuntimeError("words of a block are missing: the documents changed while they were read")
        self.count[number] = count
        self.start[number] = np.cumsum(count) - count

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) and words.max() >= len(self.count):
            raise RuntimeError("words of a block are missing: the documents changed while they were read")
        sizes = self.count[words]
        return gathered(self.flat, self.start[words], sizes), sizes


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, without special tokens.

    With ``decoded``, ``decode`` runs on the ids in the same workers and adds its column.

    ``ranks_path`` is a file of base64 tokens and ranks; words are cut by ``PATTERN``.
    Null and empty texts have no ids (an empty list); null ids, repeated ids and repeated
    rows each give their own row; an empty table gives none. Other columns are not read.
    Memory follows a block's distinct words and the longest text, not the corpus.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary file
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = rows.mapInArrow(distinct_words(buckets), "bucket int, block binary, steps binary, sizes binary, words binary")
    meet = f"block binary, kind int, part int, ids array<{kind}>, a binary, b binary, c binary"
    owned = words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    encoded = owned.mapInArrow(encode_words(ranks, id_type), meet)
    both = rows.mapInArrow(positions(id_type), meet).unionByName(encoded)
    return both.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(
        (lambda batches: decoder(ranks)(assemble(batches))) if decoded else assemble, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decoder(ranks) -> Callable:
    """Joins ids (second column) with the tokens' bytes, by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for token, rank in ranks.value.items():
            table[rank] = token
        table = pa.array([*table, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            nothing = pa.scalar(len(table) - 1, flat.type)
            tokens = table.take(flat.fill_null(nothing))
            ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            at = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), tokens.buffers()[2]])
            if lists.null_count:
                texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``decoded`` (binary): ids joined with the tokens' bytes.

    The table of tokens is bounded by the vocabulary, so every task has it and joins by
    place. A null list stays null, a null id has no bytes, and an id that is no token
    ends the job.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(decoder(ranks), f"doc_id {kind}, ids array<int>, decoded binary")
