"""Best-fit packing of tokenized documents after a dominance reduction.

How documents are packed depends on their lengths alone, and there are no more lengths
than tokens in a sequence. One pass tokenizes the documents and counts lengths; the
packing is worked out on that histogram, many equal sequences at a time; and documents,
numbered within their length, look up their place. Nothing that grows with the corpus
leaves the tasks.

The reduction follows Martello and Toth: for a document j, a set F of at most three
documents (j among them) is fixed for good if every set with j that fits can be exchanged
for F without losing room: each of F's members stands for members that are together no
larger. What is left is packed best-fit, longest first.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import gathered
from .segments import stretches
from .shared import stored

CAPACITY = 4096  # tokens of a sequence
END = 1  # id behind every document
STRETCH = 1 << 23  # bytes of texts tokenized at a time
JOINED = 100  # new words given to the tokenizer in one string
KNOWN = 500_000  # words whose ids a worker remembers

# A word of letters without combining marks before and after lowering (U+0130 has one), and what is cut off behind it (fixed values).
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,;:!?]*$"
TAIL = ".,;:!?"

Pattern = tuple[tuple[int, int], ...]  # lengths and how often each occurs


def tokenizer(path: str, special: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not special
    return found


class Words:
    """Ids of words, remembered by a worker from task to task."""

    held: dict[tuple[str, bool], "Words"] = {}

    def __init__(self, path: str, special: bool):
        found = tokenizer(path, special)
        self.encode, self.known = found.encode_batch_fast, {}
        # Tokens with which a word ends.
        self.last = np.zeros(max(found.get_vocab().values(), default=0) + 1, bool)
        self.last[[i for token, i in found.get_vocab().items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, special: bool) -> "Words":
        return cls.held.get((path, special)) or cls.held.setdefault((path, special), cls(path, special))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them, one word behind the other."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        # Strings of letters are one word each, so they can be told apart in a joined text.
        single = [w for w in new if w.isalpha()]
        self.learn([w for w in new if not w.isalpha()], 1)
        self.learn(single, JOINED)
        found = [self.known[w] for w in words]
        return np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")

    def learn(self, words: list[str], joined: int) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            texts = [" ".join(part[i : i + joined]) for i in range(0, len(part), joined)]
            for i, e in zip(range(0, len(part), joined), self.encode(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                if joined == 1:
                    self.known[part[i]] = ids.tobytes()
                    continue
                ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                if len(ends) != len(part[i : i + joined]):  # a letter that lowering parts
                    self.learn(part[i : i + joined], 1)
                    continue
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part[i : i + joined], [0, *ends], ends))


def token_ids(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one behind the other, and how many each has.

    No token of this kind of vocabulary reaches over white space, so distinct words are
    encoded once. Plain words are lowered and parted from the signs behind them first,
    which the tokenizer does anyway; all others go to it as they stand.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = lists.flatten().dictionary_encode()
    each = coded.dictionary
    plain = pc.match_substring_regex(each, PLAIN)
    core = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(each, TAIL)), each)
    cut = pc.subtract(pc.binary_length(each), pc.binary_length(core)).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(cut > 0)
    tails = [s[-n:] for s, n in zip(each.take(pa.array(ends)).to_pylist(), cut[ends].tolist())]
    parts = pa.concat_arrays([core, pa.array(tails, core.type)]).dictionary_encode()
    counts, flat = words.ids(parts.dictionary.to_pylist())
    starts, where = np.cumsum(counts) - counts, parts.indices.to_numpy(zero_copy_only=False)
    # The core's and the tail's ids of every distinct word (the tail may be empty).
    pair = np.full((len(each), 2), -1, np.int64)
    pair[:, 0], pair[ends, 1] = where[: len(each)], where[len(each) :]
    sizes = np.where(pair < 0, 0, counts[pair] if len(counts) else 0)
    flat = gathered(flat, np.where(pair < 0, 0, starts[pair] if len(starts) else 0).ravel(), sizes.ravel())
    counts = sizes.sum(axis=1)
    starts, codes = np.cumsum(counts) - counts, coded.indices.to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(counts[codes])])
    at = lists.offsets.to_numpy(zero_copy_only=False)
    return gathered(flat, starts[codes], counts[codes]), np.diff(upto[at - at[0]])


def cut_pieces(path: str, special: bool, capacity: int, end: int, keep_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = Words.of(path, special), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).cast(id_type), batch.column(1)
            for lo, hi in stretches(texts.cast(pa.large_binary()), STRETCH):
                flat, sizes = token_ids(texts[lo:hi], words)
                flat = np.insert(flat, np.cumsum(sizes), end).astype("<u4")
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                raw = memoryview(flat).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                # Places among this task's pieces of the same length.
                order = np.argsort(length, kind="stable")
                inner = length[order]
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.searchsorted(inner, inner) + seen[inner]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [ids[lo:hi].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                           pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_place"]
                if keep_ids:
                    at = pa.array(np.concatenate([first, [len(flat)]]).astype(np.int32))
                    columns, names = [*columns, pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def partner(sizes: list[int], counts: dict[int, int], j: int, room: int) -> int | None:
    """The longest other document that fits beside ``j``."""
    at = bisect_right(sizes, room) - 1
    while at >= 0 and counts[sizes[at]] <= (sizes[at] == j):
        at -= 1
    return sizes[at] if at >= 0 else None


def best_pair(sizes: list[int], counts: dict[int, int], j: int, room: int) -> tuple[int, int] | None:
    """The two other documents that together leave the least room beside ``j``; the longer one first."""
    left = {s: counts[s] - (s == j) for s in sizes if s <= room}
    here = [s for s in sizes if s <= room and left[s] > 0]
    low, high, best = 0, len(here) - 1, None
    while low <= high:
        total = here[low] + here[high]
        if low == high and left[here[low]] < 2:
            break
        if total <= room:
            if best is None or total > sum(best):
                best = (here[high], here[low])
            low += 1
        else:
            high -= 1
    return best


def smallest(sizes: list[int], counts: dict[int, int], j: int, n: int, above: int = 0) -> list[int]:
    """The ``n`` shortest other documents that are longer than ``above``."""
    out: list[int] = []
    for at in range(bisect_right(sizes, above), len(sizes)):
        out += [sizes[at]] * min(n - len(out), counts[sizes[at]] - (sizes[at] == j))
        if len(out) == n:
            break
    return out


def dominating(sizes: list[int], counts: dict[int, int], j: int, capacity: int) -> list[int] | None:
    """Documents that may share a sequence with ``j`` for good; None if no set is proven.

    With at most k others beside ``j``: k = 0, nothing; k = 1 or no room left, the longest
    partner; k = 2, the longest partner if no pair is longer together, or the fullest pair
    if it holds the longest partner and no pair that fits has both members longer than
    its shorter one.
    """
    room = capacity - j
    longest = partner(sizes, counts, j, room)
    if longest is None:
        return [j]
    few = smallest(sizes, counts, j, 3)
    most = sum(sum(few[: i + 1]) <= room for i in range(len(few)))
    if most == 1 or longest == room:
        return [j, longest]
    if most > 2:
        return None
    a, b = best_pair(sizes, counts, j, room)
    if longest >= a + b:
        return [j, longest]
    above = smallest(sizes, counts, j, 2, b)
    if a == longest and (len(above) < 2 or sum(above) > room):
        return [j, a, b]
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Sequences fixed by dominance (how many of each), and the documents that are left.

    A proof for one document holds for its equals while the documents of the set last:
    fewer others only take alternatives away.
    """
    counts, fixed = {s: n for s, n in counts.items() if n > 0}, []
    sizes, changed = sorted(counts), True
    while changed:
        changed = False
        for j in reversed(list(sizes)):
            while counts.get(j):
                chosen = dominating(sizes, counts, j, capacity)
                if chosen is None:
                    break
                each = Counter(chosen)
                times = min(counts[s] // n for s, n in each.items())
                fixed.append((times, tuple(sorted(each.items(), reverse=True))))
                changed = True
                for s, n in each.items():
                    counts[s] -= n * times
                    if not counts[s]:
                        del counts[s]
                        del sizes[bisect_left(sizes, s)]
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Longest documents first, each into the fullest sequence with room for it.

    Sequences with the same room are handled together; one takes as many documents of
    a length as fit before the next does, for it stays the fullest.
    """
    open_, rooms, done = {}, [], []

    def put(room: int, times: int, pattern: Pattern) -> None:
        if room == 0:
            done.append((times, pattern))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((times, pattern))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                times, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, times, pattern = capacity, left, ()
            q = min(room // s, left)
            used = min(times, left // q)
            if times > used and pattern:
                put(room, times - used, pattern)
            put(room - q * s, used, (*pattern, (s, q)))
            left -= used * q
    return done + [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``length, first, each, sequence, offset``: the documents of a length from number
    ``first`` on go, ``each`` at a time, into the sequences from ``sequence`` on, from
    ``offset`` on. The list is bounded by the capacity, not by the documents.

    Lengths are from 1 to ``capacity``; no documents make no sequences.
    """
    fixed, rest = reduce(counts, capacity)
    out, number, sequence = [], Counter(), 0
    for times, pattern in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, each in pattern:
            out.append((length, number[length], each, sequence, offset))
            number[length] += times * each
            offset += length * each
        sequence += times
    return sorted(out)


def placed(rows: list[tuple[int, int, int, int, int]], names: list[str]):
    table = np.array(rows, np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            found = table[np.searchsorted(key, (length << 48) + number, "right") - 1]
            inner = number - found[:, 1]
            sequence, offset = found[:, 3] + inner // found[:, 2], found[:, 4] + inner % found[:, 2] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text",
         special: bool = True, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``), one row per piece.

    A document is its text's ids and ``end`` behind them; longer ones than ``capacity``
    are cut into pieces of that many. Pieces fill sequences from offset 0 without gaps.
    The vocabulary is one whose tokens end at white space and which lowers texts;
    ``special`` tells whether the strings of its special tokens count as these in a text,
    as the tokenizers library takes them unless told otherwise. The file lies on every
    worker.

    Null and empty texts are a document of the end's id alone; null ids, repeated ids and
    repeated rows are documents of their own; an empty table gives no rows. Other columns
    are not read. Memory follows the longest text.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    cut = cut_pieces(tokenizer_path, special, capacity, end, ids, to_arrow_type(rows.schema["doc_id"].dataType))
    own = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(cut, own + ", _part int, _place long" + ", ids array<int>" * ids))
    # Numbers within a length: those of the tasks before, and the place within the task.
    cells = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")
    cells = stored(cells.withColumn("_before", before))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most one row per length
    numbered = pieces.join(cells.select("length", "_part", "_before"), ["length", "_part"]).withColumn("_number", F.col("_before") + F.col("_place"))
    names = [x.split()[0] for x in own.split(", ")] + ["ids"] * ids
    return numbered.select(*names, "_number").mapInArrow(placed(plan(counts, capacity), names), own + ", ids array<int>" * ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the sequences themselves, from ``pack(..., ids=True)``; each fits its capacity."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"), F.transform("m", lambda x: x["doc_id"]).alias("doc_ids"))
