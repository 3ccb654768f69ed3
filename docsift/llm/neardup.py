"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one document from the start.
Every tree branches the documents by chosen minwise tokens: a node picks positions of the
MinHash sketch, and documents with the same token at a position share a child. The first
levels pick two positions each, further levels ``positions_for`` many, so a pair at the
threshold has 1.6 children or more on average and survives any number of levels, although
unrelated documents part. Nodes with few documents are compared exhaustively on sketches,
and what may be similar is confirmed on the full sets; larger nodes branch again.
Independent trees are repeated until a pair at the threshold, after however many levels,
is missed at most once in ``1 / miss``.

A large group of near copies never parts. Its node is therefore dealt into blocks that
all hold one common document: each block is confirmed exhaustively, which ties the group
together. If only few documents stand outside a node's largest component then, they are
compared with all others, in blocks; otherwise the node branches, and a child whose
documents are all tied already is dropped. A node whose children together have no fewer
pairs than it has itself (many documents that are alike, but below the threshold) gains
nothing from branching: every two of its blocks are compared. So no node emits its pairs,
no task holds an unbounded node, and sets of one component are never compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from . import segments
from .components import components, contracted
from .shared import grouped, staged

POSITIONS = 128  # of the sketch
LEVELS = 2  # taken in one step, with two positions a node
NODE = 400  # documents of a node that is compared exhaustively
NODE_SHINGLES = 4_000_000  # and their shingles, unless they are only two
REST = 3000  # documents besides the largest component of a node that is compared exhaustively as well
CHILDREN = 1.6  # of a pair at the threshold, on average, in a node that branches again
DEPTH = 24  # levels after which what is still large is compared block by block
FILTER_BITS = 1 << 23  # of the bitmap that keeps other documents' texts where they are; 1 MB
SLACK = 0.2  # by which a sketch may show less than the threshold; five deviations

_rng = np.random.default_rng(20240501)
_FACTORS = (_rng.integers(0, 2**31, POSITIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_TERMS = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint64).astype(np.uint32)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one document."""
    h = np.sort(segments.windows(words, k))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of a set under every one of POSITIONS functions."""
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 256):
        part = folded[at : at + 256]
        np.minimum(low, (part[:, None] * _FACTORS + _TERMS).min(0), out=low)
    return low


def trees_for(threshold: float, miss: float) -> int:
    """Trees after which a pair at the threshold is missed with chance ``miss`` at most.

    A tree keeps a pair that further levels keep (the fixed point of their recursion, so it
    holds for any depth) and that the first LEVELS levels keep.
    """
    kept = 1.0
    for _ in range(1000):
        kept = 1 - (1 - threshold * kept) ** positions_for(threshold)
    for _ in range(LEVELS):
        kept = 1 - (1 - threshold * kept) ** 2
    return math.ceil(math.log(miss) / math.log(1 - kept))


def positions_for(threshold: float) -> int:
    """Positions a node of further levels branches by: a pair at the threshold has CHILDREN or more."""
    return math.ceil(CHILDREN / threshold - 1e-9)


def leaves(sketch: np.ndarray, trees: int) -> np.ndarray:
    """Keys of the nodes that a document reaches after LEVELS levels of every tree."""
    paths, at = np.arange(1, trees + 1, dtype=np.uint64), 0
    for _ in range(LEVELS):
        n = 2 * len(paths)
        tokens = sketch[np.arange(at, at + n) % POSITIONS].astype(np.uint64)
        paths = segments.mixed(np.repeat(paths, 2) * np.uint64(0x9E3779B97F4A7C15) + (tokens << np.uint64(8)) + np.arange(n, dtype=np.uint64) % 2)
        at += n
    return paths


def describe(k: int, trees: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sketches, keys = [], [], [], []
            for lo, hi in segments.stretches(batch.column(1)):
                words = segments.Words(batch.column(1)[lo:hi], segments.WHITE)
                for _, s in words.rows():
                    found = shingle_set(words.hash[s], k)
                    counts.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    low = minwise(found) if len(found) else None
                    sketches.append(None if low is None else low.astype(np.uint8).tobytes())
                    keys.append(None if low is None else leaves(low, trees).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sketch", "leaves"])

    return run


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` items' component under the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def likely(threshold: float) -> Callable:
    """Rows (node, rep, n, sketch) sorted by node -> (part, rep) of documents that may be linked."""
    least = (threshold - SLACK) * POSITIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "node"):
            node, rep, n = (t.column(c).to_numpy() for c in ("node", "rep", "n"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            a, b, step = [], [], 1
            while True:
                i = np.flatnonzero(node[step:] == node[:-step]) if step < len(node) else np.zeros(0, np.int64)
                if not len(i):
                    break
                j = i + step
                near = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[near], j[near]
                for lo in range(0, len(i), 1 << 16):
                    x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                    alike = (sketch[x] == sketch[y]).sum(1) >= least
                    a.append(x[alike])
                    b.append(y[alike])
                step += 1
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            label = linked(len(node), a, b)
            rows = np.unique(np.concatenate([a, b]))
            rows = rows[np.lexsort((rep[rows], label[rows]))]
            edges = np.flatnonzero(np.diff(label[rows], prepend=-1, append=-1))
            parts, reps = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                members = rep[rows[lo:hi]]
                parts += [hashlib.blake2b(members.tobytes(), digest_size=16).digest()] * len(members)
                reps.append(members)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.int64), *reps]), pa.int64())], ["part", "rep"])

    return run


def confirmed(k: int, percent: int) -> Callable:
    """Rows (part, rep, label, text) sorted by part -> links (a, b) on the full sets between labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "part"):
            part, rep, label = t.column("part").combine_chunks(), t.column("rep").to_numpy(), t.column("label").to_numpy()
            cuts = np.flatnonzero(pa.compute.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)) + 1
            edges, out = [0, *cuts.tolist(), len(part)], []
            for lo, hi in zip(edges, edges[1:]):
                sets = []
                text = pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("text")[lo:hi].chunks])
                for a, b in segments.stretches(text):
                    words = segments.Words(text[a:b], segments.WHITE)
                    sets += [shingle_set(words.hash[s], k) for _, s in words.rows()]
                out += stars(rep[lo:hi], label[lo:hi], list(links(sets, label[lo:hi], percent)))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def stars(rep: np.ndarray, known: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs' components, labels included, as edges from each member to the smallest."""
    if not pairs:
        return []
    names, at = np.unique(np.concatenate([rep, known]), return_inverse=True)
    own, label = at[: len(rep)], at[len(rep) :]
    i, j = np.array(pairs).T
    # A linked document stands for its label, too.
    tied = np.unique(np.concatenate([i, j]))
    root = linked(len(names), np.concatenate([own[i], own[tied]]), np.concatenate([own[j], label[tied]]))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return list(zip(names[moved].tolist(), names[root[moved]].tolist()))


def links(sets: list[np.ndarray], known: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that link different labels; sets of one label, known or found, are not compared.

    One set's members are marked and counted in all sets at once.
    """
    size = np.array([len(s) for s in sets])
    _, label, count = np.unique(known, return_inverse=True, return_counts=True)
    whole, member = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    marked = np.zeros(len(whole), np.int32)
    # Every pair of two labels has an end outside the most frequent one.
    todo = np.flatnonzero(label != np.argmax(count))
    done = np.zeros(len(sets), bool)
    for i in todo:
        done[i] = True
        near = 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        others = np.flatnonzero(near & (size > 0) & ~done & (label != label[i])) if size[i] else todo[:0]
        if not len(others):
            continue
        own = member[begin[i] : begin[i] + size[i]]
        marked[own] = 1
        if 2 * len(others) > len(sets) and size.min() > 0:
            both = np.add.reduceat(marked[member], begin)[others]
        else:
            part = np.concatenate([member[begin[j] : begin[j] + size[j]] for j in others])
            both = np.add.reduceat(marked[part], np.cumsum(size[others]) - size[others])
        marked[own] = 0
        for j in others[100 * both >= percent * (size[i] + size[others] - both)]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield i, j


def ties(rows: DataFrame) -> DataFrame:
    """(part, rep): large nodes dealt into blocks, each with the node's first document."""
    count = F.ceil(F.greatest(F.col("c") / NODE, F.col("s") / NODE_SHINGLES))
    rows = rows.withColumn("blocks", count)
    part = F.unhex(F.md5(F.concat_ws("/", "node", "block").cast("binary")))
    members = rows.withColumn("block", F.pmod(F.xxhash64("rep", "node"), "blocks"))
    firsts = rows.groupBy("node").agg(F.min("rep").alias("rep"), F.first("blocks").alias("blocks"))
    firsts = firsts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select(part.alias("part"), "rep").unionByName(firsts.select(part.alias("part"), "rep"))


def rest_of(rows: DataFrame) -> DataFrame:
    """(node, top, b, bs): each large node's largest component, and documents and shingles besides it."""
    each = rows.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    return each.groupBy("node").agg(F.max_by("component", F.struct("c", "component")).alias("top"), (F.sum("c") - F.max("c")).alias("b"),
                                    (F.sum("s") - F.max_by("s", F.struct("c", "component"))).alias("bs"))


def crossed(rows: DataFrame) -> DataFrame:
    """(part, rep, label): a large node's largest component in blocks, the rest with each of them."""
    rows = rows.withColumn("blocks", F.ceil(F.greatest((F.col("c") - F.col("b")) / F.greatest(F.lit(NODE), F.col("b")), (F.col("s") - F.col("bs")) / NODE_SHINGLES)))
    place = F.pmod(F.xxhash64("rep", "node"), "blocks")
    blocks = F.when(F.col("component") == F.col("top"), F.array(place)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.explode(blocks))
    return rows.select(F.unhex(F.md5(F.concat_ws("/", "node", "block").cast("binary"))).alias("part"), "rep", F.col("component").alias("label"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(part, rep, label): every two blocks of a large node together, so that all its pairs meet.

    Blocks are as large as those of ``crossed``, as each text is needed in every block pair.
    """
    count = F.ceil(F.greatest(F.col("c") / max(NODE, REST), 2 * F.col("s") / NODE_SHINGLES))
    rows = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("rep", "node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.unhex(F.md5(F.concat_ws("/", "node", F.least("block", "other"), F.greatest("block", "other")).cast("binary")))
    return rows.select(part.alias("part"), "rep", F.col("component").alias("label"))


def possibly(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id may be in ``wanted``, by a bitmap of FILTER_BITS hashed ids.

    The bitmap's size is fixed, so every task can have it; only what passes is shuffled.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    maps = wanted.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    rows = texts.withColumn("h", place).withColumn("bucket", F.bitmap_bucket_number("h"))
    rows = rows.join(F.broadcast(maps), "bucket").withColumn("bit", F.bitmap_bit_position("h"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 + 1 as int), 1)), 16, 10) as int)")
    inside = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return rows.filter(inside).drop("h", "bucket", "bits", "bit")


def leaf_places(leaf: Column, trees: int) -> Column:
    """Positions on the way to a leaf, by its index among ``leaves``."""
    return F.array(F.floor(leaf / 2), leaf + 2 * trees).cast("array<int>")


def branch(rows: DataFrame, first: DataFrame, positions: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Children of large nodes whose documents are not all in one component yet, and the
    rows of nodes whose children have no fewer pairs than they have.

    ``used`` holds the positions on a node's way, which would not part its documents.
    """
    if "used" in rows.columns:
        held = rows.join(first.select("rep", "sketch"), "rep")
    else:
        held = rows.join(first.select("rep", "sketch", "leaves"), "rep")
        held = held.withColumn("used", leaf_places(F.array_position("leaves", F.col("node")).cast("int") - 1, trees))
    free = F.array_except(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), F.transform("used", lambda p: F.pmod(p, F.lit(POSITIONS))))
    drawn = F.slice(F.array_sort(F.transform(free, lambda p: F.struct(F.xxhash64("node", p).alias("h"), p.alias("p")))), 1, positions)
    held = held.select(F.col("node").alias("parent"), "node", "rep", "n", "component", "c", "sketch", "used", F.explode(drawn["p"]).alias("p"))
    child = F.xxhash64("node", "p", F.substring("sketch", F.col("p") + 1, F.lit(1)))
    held = staged(held.select("parent", child.alias("node"), "rep", "n", "component", "c", F.array_append("used", F.col("p")).alias("used")))
    nodes = held.groupBy("parent", "node").agg(F.count("*").alias("own"), F.first("c").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    nodes = staged(nodes.filter("lo < hi"))
    pairs = F.sum(F.col("own").cast("double") * F.col("own"))
    alike = nodes.groupBy("parent").agg(pairs.alias("pairs"), F.first("c").alias("c")).filter("pairs >= double(c) * c").select("parent")
    alike = staged(alike)
    parted = nodes.select("parent", "node").join(alike, "parent", "left_anti")
    children = held.select("parent", "node", "rep", "n", "used").join(parted, ["parent", "node"], "left_semi").drop("parent")
    return children, rows.join(alike.withColumnRenamed("parent", "node"), "node", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    A-Z are lowered, words are runs of anything but white space, and a text's set holds
    its distinct ``k``-word shingles (a shorter text's whole sequence is one). Texts with
    ``100 * common >= percent * all`` shingles are linked; ``component_id`` is the smallest
    id that links reach, and the row with that id is ``kept``. A pair right at the limit
    is missed with chance ``miss`` at most; every link that is used has been confirmed on
    the full sets.

    Null texts and texts without words have no shingles and are linked with nothing. Rows
    without an id are linked with nothing, have no component and are kept. Rows that share
    an id are one document with several texts: all have its component. An empty table
    gives no rows. Other columns are not read. Ids must be whole numbers.
    """
    threshold, trees = percent / 100, trees_for(percent / 100, miss)
    positions = positions_for(threshold)
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    described = staged(texts.mapInArrow(describe(k, trees), "doc_id long, n long, digest binary, sketch binary, leaves array<long>"))
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    sets, none = described.filter(some), described.filter(~some)
    copies = staged(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    first = sets.join(copies.withColumnRenamed("digest", "d"), F.expr("digest = d AND doc_id = rep"))
    first = staged(first.select("rep", "n", "digest", "sketch", "leaves").dropDuplicates(["rep", "digest"]))
    texts = texts.withColumnRenamed("doc_id", "rep")
    rows, links, depth = first.select(F.explode("leaves").alias("node"), "rep", "n"), None, LEVELS

    def linked_by(parts: DataFrame, links: DataFrame | None) -> DataFrame:
        """``links`` and those found within ``parts``."""
        parts = staged(parts)
        meet = parts.join(possibly(texts, parts), "rep").select("part", "rep", "label", "text")
        found = meet.repartition("part").sortWithinPartitions("part", "rep").mapInArrow(confirmed(k, percent), "a long, b long")
        return staged(found if links is None else found.unionByName(links))

    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1")
        rows = staged(rows.join(sizes, "node"))
        small = f"c = 2 OR (c <= {NODE} AND s <= {NODE_SHINGLES})"
        large = rows.filter(f"NOT ({small})")
        near = rows.filter(small).select("node", "rep").join(first.select("rep", "n", "sketch"), "rep")
        parts = near.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(likely(threshold), "part binary, rep long")
        more = not large.isEmpty()
        parts = (parts.unionByName(ties(large)) if more else parts).distinct()
        links = linked_by(parts.withColumn("label", F.col("rep")), links)
        if not more:
            break
        labels = contracted(links, rounds=1).withColumnRenamed("node", "rep")
        large = large.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        large = staged(large.join(rest_of(large), "node").filter("b > 0"))
        ready = f"b <= {REST} AND bs <= {NODE_SHINGLES}"
        parts, large = crossed(large.filter(ready)), large.filter(f"NOT ({ready})")
        last = depth >= DEPTH
        links = linked_by(parts.unionByName(block_pairs(large)) if last else parts, links)
        if last or large.isEmpty():
            break
        rows, alike = branch(large, first, positions, trees)
        rows, alike, depth = staged(rows), staged(alike), depth + 1
        if not alike.isEmpty():
            links = linked_by(block_pairs(alike), links)
        if rows.isEmpty():
            break
    labels = components(links)
    classes = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = sets.select("doc_id", "n", "digest").join(classes, "digest").select("doc_id", "n", "component_id")
    rest = none.select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
