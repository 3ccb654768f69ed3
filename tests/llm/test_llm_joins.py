"""Near duplicates and vector searches against brute force."""

import random
import re

import numpy as np
import pytest

from docsift.llm import nearest, neardup, topk
from docsift.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def plain_components(rows, k, percent=80):
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}, {doc: len(s) for (doc, _), s in zip(rows, sets)}


def corpus(seed, groups, copies, length):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, length // 12))):
                text[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return rows


def test_trees_reach_the_recall():
    assert neardup.trees_for(0.8, 1e-4) == 4


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = corpus(1, 30, 4, 60) + [None, "", " \n", "one", "ONE", "one two", "a b c d e f", "a b c d e g"] + ["long " * 20_000, "long " * 20_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    got = neardup.near_duplicates(docs, k=k).collect()
    want, sizes = plain_components(rows, k)
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_large_nodes_are_settled(spark, monkeypatch):
    """Small limits send the groups through ties, crossed blocks, branches and block pairs."""
    rows = list(enumerate(corpus(2, 3, 60, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_components(rows, 2)
    for node, rest, depth in ((8, 500, 24), (8, 4, 24), (8, 0, 3)):
        monkeypatch.setattr(neardup, "NODE", node)
        monkeypatch.setattr(neardup, "REST", rest)
        monkeypatch.setattr(neardup, "DEPTH", depth)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=2).collect()} == want


def test_pairs_survive_many_levels(spark):
    """1,000 pairs at the threshold, each in one node of four trees; eight further levels."""
    rng, rows, sketches = np.random.default_rng(3), [], []
    for p in range(1000):
        one, two = rng.integers(0, 256, (2, neardup.POSITIONS), dtype=np.uint8)
        two = np.where(rng.random(neardup.POSITIONS) < 0.8, one, two)
        for rep, sketch in ((2 * p, one), (2 * p + 1, two)):
            sketches.append((rep, bytearray(sketch.tobytes())))
            rows += [(4 * p + tree, rep, 99, rep, 1000, []) for tree in range(4)]
    first = spark.createDataFrame(sketches, "rep long, sketch binary")
    nodes = spark.createDataFrame(rows, "node long, rep long, n long, component long, c long, used array<int>")
    for _ in range(8):
        nodes, alike = neardup.branch(nodes, first, neardup.positions_for(0.8), 4)
        nodes = neardup.staged(nodes.selectExpr("*", "rep AS component", "1000L AS c"))
        assert alike.isEmpty()
    lost = 1000 - nodes.selectExpr("rep div 2").distinct().count()
    assert lost <= 1


def test_alike_documents_are_compared_at_once(spark, monkeypatch):
    """Documents of one template below the threshold, which branching doesn't part, and pairs among them."""
    monkeypatch.setattr(neardup, "NODE", 8)
    monkeypatch.setattr(neardup, "REST", 0)
    asked, block_pairs = [], neardup.block_pairs
    monkeypatch.setattr(neardup, "block_pairs", lambda rows: asked.append(rows.count()) or block_pairs(rows))
    template = [f"s{i}" for i in range(80)]
    rows = [(i, " ".join(template + [f"d{i - i % 2 * (i < 40)}w{j}" for j in range(20)])) for i in range(120)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {i: i - i % 2 * (i < 40) for i in range(120)} and asked


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "x y z"), (3, "a b c"), (9, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(docs, k=2).collect())
    assert got[-1] == ("None", None, True)
    assert {x[1] for x in got[:-1]} <= {3, 5} and len(got) == 5
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    rows[40] = (40, rows[20][1])  # ties
    rows[41] = (41, rows[20][1])
    return rows


EXTRA = [(None, [1.0] * 6), (900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [None] + [1.0] * 5), (904, [float("inf")] * 6), (905, []), (906, [1.0, 2.0]), (920, [3.0, 4.0])]


def usable(v, zero):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("tile", [7, 256])
def test_nearest(spark, monkeypatch, tile):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr("docsift.llm.vectors.CANDIDATES", 50)
    rows = vectors(300, 6) + EXTRA
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = {}
    for r in nearest.nearest(table, k=5, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, v) for i, v in rows if i is not None and usable(v, False)]
    for q, v in good:
        if q % 20 == 0:
            near = sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), i) for i, w in good if i != q and len(w) == len(v))[:5]
            mine = sorted(got.get(q, []))
            assert [x[1] for x in mine] == [i for _, i in near] and np.allclose([x[2] for x in mine], [d for d, _ in near], rtol=1e-12)
    assert set(got) == {q for q, v in good if q % 20 == 0}
    assert nearest.nearest(table.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_products(spark, monkeypatch, scale):
    monkeypatch.setattr("docsift.llm.vectors.CANDIDATES", 50)
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v]) for i, v in vectors(200, 6, 1) + EXTRA]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk.top_products(table, k=7, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and usable(v, True)]
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:7]
            assert [(x[1], x[2]) for x in sorted(got.get(q, []))] == [(i, -s) for s, i in best]
    assert topk.top_products(table.limit(0)).count() == 0
