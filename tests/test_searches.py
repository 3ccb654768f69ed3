"""Lists of different texts, n-grams and keywords against brute force, and the result cache."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsift.functions.text import SPACES, WS, strip, word_tokens, words
from docsift.operators import bm25, grams, lexical, phrases, vector
from docsift.plans import cache, search


@pytest.fixture(scope="module")
def copies(spark):
    """Thirty copies of the best text, and six others."""
    texts = ["the client shall pay the fee"] * 30 + [f"the client shall pay {w}" for w in ("rent", "tax", "costs", "interest", "damages", "nothing now")]
    rows = [(i, t if i % 2 else f" {t.upper()}\n", "ab"[i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, file_name string")
    from docsift.functions.vectors import embed_udf, hashing_embed

    asked = spark.createDataFrame([(1, "client shall pay the fee")], "query_id long, text string")
    return tuple(d.withColumn("vec", embed_udf(hashing_embed)(F.col("text"))).cache() for d in (df, asked))


@pytest.mark.parametrize("mode", ["semantic", "bm25", "mixed"])
def test_lists_are_full_where_copies_abound(copies, mode):
    rows = search.search(*copies, mode, k=5).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and len({r["id"] // 30 * r["id"] for r in rows}) == 5 and rows[0]["id"] == 0


def test_hybrid_and_advanced_lists_are_full(copies):
    for rows in (search.hybrid(*copies, 5), search.advanced(*copies, search.SearchConfig(k=5))):
        ids = [r["id"] for r in rows.collect()]
        assert len(ids) == 5 and sum(i < 30 for i in ids) == 1


def test_hierarchical_gives_each_document_its_share(copies):
    rows = search.retrieve_hierarchical(*copies, search.SearchConfig(k=4, documents=2, threshold=0.0)).collect()
    assert Counter(r["file_name"] for r in rows) == {"a": 2, "b": 2}


def test_ngrams_are_counted_by_their_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(40)]
    asked = grams.Asked([(i, t.split()) for i, t in enumerate(texts[:7])], 3)
    every = lambda t: [tuple(t.split()[i : i + n]) for n in (1, 2, 3) for i in range(len(t.split()) - n + 1)]
    lists = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    doc, node, times = asked.found(lists)
    weight = Counter()
    for d, n, m in zip(doc.tolist(), node.tolist(), times.tolist()):
        for q, node_, t in zip(asked.query.tolist(), asked.node.tolist(), asked.times.tolist()):
            if node_ == n:
                weight[d, q] += m * t
    want = Counter()
    for d, text in enumerate(texts):
        for q in range(7):
            a, b = Counter(every(text)), Counter(every(texts[q]))
            want[d, q] = sum(n * b[g] for g, n in a.items())
    assert weight == want
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["n"]: r["m"] for r in grams.frequencies(df, words, 3).collect()}
    assert found == Counter(Counter(g for t in texts if t.strip() for g in set(every(t))).values())


def test_both_ways_of_scoring_agree(spark, monkeypatch):
    rng = random.Random(2)
    some = "pay fee client vendor shall the of".split()
    df = spark.createDataFrame([(i, " ".join(rng.choice(some) for _ in range(rng.randrange(20)))) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(some) for _ in range(4))) for i in range(6)], "query_id long, text string")
    ways = [lambda: bm25.top(df, asked, 7, word_tokens, upto=2, key=F.md5("text")), lambda: phrases.top(df, asked, 7, key=F.md5("text")),
            lambda: bm25.scores(df, asked), lambda: phrases.scores(df, asked), lambda: lexical.top(df, asked, 7, key=F.md5("text"))]
    held = [sorted(map(tuple, way().collect())) for way in ways]
    monkeypatch.setattr(grams, "ASKED", 0)
    monkeypatch.setattr(lexical, "BLOCK", 3)
    assert [sorted(map(tuple, way().collect())) for way in ways] == held and all(held)


def test_keywords_are_counted_as_in_the_text():
    texts = ["Aaaa_aa Éaéa", "", None, "x1x1x1 x1!", "ab" * 50 + " aab"]
    keys = ["aa", "éa", "x1", "x1x", "aab", "ab"]
    low = [(t or "").lower() for t in texts]
    row, key, first, n, spoken = lexical.Finder(keys).found(pa.array([t if t is None else t.lower() for t in texts]))
    got = {(r, keys[k]): (f, m) for r, k, f, m in zip(row.tolist(), key.tolist(), first.tolist(), n.tolist())}
    assert got == {(i, k): (t.index(k), t.count(k)) for i, t in enumerate(low) for k in keys if k in t}
    assert spoken.tolist() == [len(t.split()) for t in low]


def test_distinct_vectors_and_strip(spark):
    v = spark.createDataFrame([(i, [1.0, float(i // 4)], f"k{i // 4}") for i in range(20)], "id long, vec array<double>, _key string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert [r["id"] for r in vector.top(v, q, 3, distinct=True).orderBy("rank").collect()] == [0, 4, 8]
    odd = [f"{SPACES}a{SPACES}b{SPACES}", "", SPACES, "a", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    same = df.select(strip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{WS}+|{WS}+$", "")).alias("x"))
    assert all(r["x"] for r in same.collect()) and all(re.fullmatch(r"\s", c) for c in SPACES)


def test_cache_serves_fresh_rows_only(spark, tmp_path):
    calls = []

    def engine(queries, n):
        calls.append(sorted(r["text"] for r in queries.collect()))
        return queries.filter("text <> 'none'").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("id"), (F.lit(1.0) / F.col("id")).alias("score"))

    def run(rows, hour):
        asked = spark.createDataFrame(rows, "query_id long, text string")
        now = F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))
        return sorted(tuple(r) for r in cache.cached_search(asked, engine, str(tmp_path / "c"), 2, "e", "m", now).select("query_id", "id", "rank", "cached").collect())

    assert run([(1, "a"), (2, " a "), (3, "none"), (4, " "), (5, None)], 0) == [(1, 1, 1, False), (1, 2, 2, False), (2, 1, 1, False), (2, 2, 2, False)]
    assert run([(7, "a"), (8, "b")], 1) == [(7, 1, 1, True), (7, 2, 2, True), (8, 1, 1, False), (8, 2, 2, False)]
    assert run([(7, "a"), (8, "b")], 24) == [(7, 1, 1, False), (7, 2, 2, False), (8, 1, 1, True), (8, 2, 2, True)]
    assert calls == [["a", "none"], ["b"], ["a"]]


def test_meta_search_in_blocks_and_edges(spark, monkeypatch):
    from docsift.operators import meta, vector as vectors

    docs = spark.createDataFrame(
        [(1, "red fox", [1.0, 0.0]), (2, "red red fox den", [0.0, 1.0]), (3, "blue sky", None), (4, None, [1.0, 0.0]), (5, "blue sky", [0.0, 0.0]), (6, "plain", [1.0, 1.0])],
        "id long, text string, vec array<double>")
    asked = spark.createDataFrame([("a", "fox", [1.0, 0.0]), ("b", "blue", [0.0, 1.0]), ("c", "", [1.0, 0.0]), ("d", None, None)], "query_id string, text string, vec array<double>")
    once = sorted(map(tuple, meta.by_both(docs, asked, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 1)
    assert sorted(map(tuple, meta.by_both(docs, asked, 3).collect())) == once
    got = {q: [(r[1], round(r[2], 4)) for r in sorted(once, key=lambda r: r[5]) if r[0] == q] for q in "abcd"}
    assert got["a"][0] == (1, 1.0) and got["b"] == [(3, 0.7), (5, 0.7), (2, 0.6)]
    assert got["c"] == [(1, 0.6), (6, 0.5121), (2, 0.3)]
    assert got["d"] == [(1, 0.3), (2, 0.3), (3, 0.3)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_pairs_are_scored_in_bounded_parts_where_the_documents_are(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["client", "clients", "fee", "fees", "pay", "vendor"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "client fee fee"), (2, "vendor pay client"), (3, "nothing here")], "query_id long, text string")
    got = lexical.scores(df, asked)
    assert "Join" not in _plan(got) and "Aggregate" not in _plan(got)
    want = sorted(got.collect())
    monkeypatch.setattr(lexical, "BYTES", 50)
    assert want and sorted(lexical.scores(df, asked).collect()) == want
    monkeypatch.setattr(lexical, "BLOCK", 2)
    assert sorted(lexical.scores(df, asked).collect()) == want


def test_batches_are_cut_by_what_they_hold():
    from docsift.operators.layout import bounded

    lists = pa.array([["a"] * n for n in (3, 0, 4, 50, 1)] + [None], pa.list_(pa.string()))
    for column, values in (("t", pa.array(["a" * (len(x.as_py() or [])) for x in lists])), ("t", lists)):
        parts = list(bounded(pa.record_batch([values], [column]), column, 7))
        assert [p.num_rows for p in parts] == [3, 1, 2] and pa.concat_arrays([p.column(0) for p in parts]) == values


def test_blocks_stay_small_and_copies_are_cut_before_rows_are_made(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    sizes, plain = [], grams.Best.add
    monkeypatch.setattr(grams.Best, "add", lambda self, part: sizes.append(len(part)) or plain(self, part))
    table = pd.DataFrame({"id": np.arange(400)[::-1], "_key": ["a"] * 200 + ["b"] * 150 + list(map(str, range(50)))})
    best = grams.Best(2, True)
    best.add_block(table, np.repeat([1.0, 0.5, 0.1], [200, 150, 50])[:, None], np.ones((400, 1), bool), ["q"])
    assert sizes == [2] and best.held[["id", "score"]].values.tolist() == [[200, 1.0], [50, 0.5]]
    # Common n-grams unfold to many cells: blocks count those, too.
    asked = grams.Asked([(q, ["a", "b", "c"]) for q in range(20)], 1)
    batch = pa.record_batch([pa.array([[0, 1, 2]] * 30, pa.list_(pa.int32())), pa.array([[1, 1, 1]] * 30, pa.list_(pa.int32())), pa.array([3] * 30)], ["nodes", "times", "dl"])
    monkeypatch.setattr(grams, "CELLS", 120)
    blocks = list(grams.dense(asked, np.ones(60), lambda tf, dl: tf, batch))
    assert [s.shape[0] for _, s, _ in blocks] == [2] * 15 and all((s == 3).all() for _, s, _ in blocks)


def test_vectors_are_scored_in_bounded_blocks(monkeypatch):
    import numpy as np
    import pandas as pd

    df = pd.DataFrame([(i, np.array([float(i % 7), 1.0, float(i % 3)]), "ab"[i % 2], str(i % 11)) for i in range(80)], columns=["id", "vec", "part", "_key"])
    asked, sizes, plain = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 1.0]]), [], vector.best_cells
    monkeypatch.setattr(vector, "best_cells", lambda scores, *a: sizes.append(scores.size) or plain(scores, *a))

    def run():
        return [sorted(map(tuple, pd.concat(vector._scorer([1, 2], asked, k, keep, group, distinct)(iter([df]))).values.tolist()))
                for k, keep, group, distinct in ((5, ["_key"], None, True), (3, ["part"], "part", False), (4, [], None, False))]

    want = run()
    monkeypatch.setattr(vector, "CELLS", 6)
    sizes.clear()
    assert run() == want and max(sizes) == 6


def test_hashes_move_as_steps():
    rng = np.random.default_rng(1)
    for size, most in ((0, 9), (1, 9), (9, 7), (1 << 20, 6)):
        h = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        n = rng.integers(1, 70_000, len(h))
        edges = np.searchsorted(h, np.arange(grams.PARTS, dtype=np.uint64) << np.uint64(52)).tolist() + [len(h)]
        rows = list(grams.packed(h, n))
        assert [r[0] for r in rows] == [i for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        got = [grams.unpacked(*r[1:]) for r in rows]
        assert [x for g, _ in got for x in g.tolist()] == h.tolist() and [x for _, c in got for x in c.tolist()] == n.tolist()
        assert sum(len(r[1]) - 8 for r in rows) <= most * len(h)


def test_a_staged_corpus_is_dealt_once(spark):
    from docsift.suite import searches
    from docsift.suite.registry import Tables

    corpus = searches.corpus(Tables(spark, "/root/testdata/sf0.001"))
    asked = grams.ask(spark.createDataFrame([(1, "the client")], "query_id long, text string"), word_tokens, 5)
    plans = [grams.documents(corpus, asked, word_tokens, []), grams.frequencies(corpus, word_tokens, 5), vector.top(corpus.select("id", "vec"), corpus.limit(3).select(F.col("id").alias("query_id"), "vec"), 2)]
    for df in plans[:1] + plans[2:]:
        assert "RepartitionByExpression" not in df._jdf.queryExecution().optimizedPlan().toString()
    # The other one gathers ranges of hashes, not texts.
    assert plans[1]._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
