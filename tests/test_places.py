"""Reciprocal ranks over whole lists against places counted pair by pair."""

from collections import defaultdict

import pytest

from docsift.functions.text import word_tokens
from docsift.operators import bm25, meta, vector

TEXTS = ["red fox", "red", "fox den den", "blue sea", "sea", "red sea fox", "old den", "red fox", "red fox", "grey"]


def _expected(texts, asked, k):
    pairs = {(r["query_id"], r["id"]): [0.0, r["score"]] for r in vector.scores(texts.select("id", "vec"), asked.select("query_id", "vec")).collect()}
    found, best = {(r["query_id"], r["id"]): r["score"] for r in bm25.scores(texts, asked, word_tokens).collect()}, defaultdict(float)
    for (q, _), score in found.items():
        best[q] = max(best[q], score)
    for (q, i), score in found.items():
        pairs[q, i][0] = round(score / best[q], 6) if best[q] > 0 else score
    url, out = {r["id"]: r["url"] for r in texts.collect()}, []
    for q in sorted({q for q, _ in found}):
        sums = defaultdict(float)
        for n in (0, 1):
            places = sorted((-s[n], i) for (p, i), s in pairs.items() if p == q)
            for place, (_, i) in enumerate(places, 1):
                sums[url[i]] += 1 / (60 + place)
        ranked = sorted((-round(s, 9), u) for u, s in sums.items())[:k]
        out += [(q, u, -s, n) for n, (s, u) in enumerate(ranked, 1)]
    return out


# Lists in one stretch, and in several with urls that fall into several ranges.
@pytest.mark.parametrize("part, pack", [(meta.PART, meta.PACK), (3, 2)])
def test_places_of_whole_lists(spark, monkeypatch, part, pack):
    monkeypatch.setattr(meta, "PART", part)
    monkeypatch.setattr(meta, "PACK", pack)
    rows = [((i * 7) % 40, TEXTS[i % len(TEXTS)], [float(i % 3), float(i % 5) - 2.0], f"u{i * i % 11}") for i in range(40)]
    texts = spark.createDataFrame(rows, "id long, text string, vec array<double>, url string").cache()
    texts.count()
    asked = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "sea den", [0.0, 1.0]), (3, "--", [1.0, 1.0])], "query_id long, text string, vec array<double>")
    got = sorted((r["query_id"], r["rank"], r["url"], round(r["score"], 9)) for r in meta.by_places(texts, asked, 4).collect())
    # A query without words has no list.
    assert got == [(q, n, u, round(s, 9)) for q, u, s, n in _expected(texts, asked, 4)]


def test_hybrid_lists_are_made_once_and_keyed_once(spark):
    from docsift.plans import search

    texts = ["the client pays rent", "The  client pays RENT", "the vendor pays tax", "client costs", "other words", "rent and tax"]
    docs = spark.createDataFrame([(i, t, [float(i % 3), 1.0]) for i, t in enumerate(texts)], "id long, text string, vec array<double>").cache()
    docs.count()
    asked = spark.createDataFrame([(1, "client rent tax", [1.0, 1.0])], "query_id long, text string, vec array<double>").cache()
    plain = search.hybrid(docs, asked, 3)
    # Both lists are read twice, so neither search stands in the plan any more.
    assert not {"MapInArrow", "MapInPandas"} & set(plain._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())
    keyed = search.hybrid(docs.withColumn("text_key", search.text_key()), asked, 3)
    got = sorted(map(tuple, plain.select("query_id", "id", "score", "rank").collect()))
    assert len(got) == 3 and sorted(map(tuple, keyed.select("query_id", "id", "score", "rank").collect())) == got


def test_finder_forgets_and_finds_the_same(monkeypatch):
    import pyarrow as pa

    from docsift.operators import lexical

    texts = [pa.array(["banana ban", None, "an anan nan"]), pa.array(["banana", "", "x"]), pa.array(["nan banana nan", "ban"])]
    once = lexical.Finder(["an", "ban", "nan"])
    want = [[x.tolist() for x in once.found(t)] for t in texts]
    assert want[0][:4] == [[0, 0, 0, 2, 2], [0, 1, 2, 0, 2], [1, 0, 2, 0, 4], [3, 2, 1, 4, 2]]
    monkeypatch.setattr(lexical, "RUNS", 0)
    again = lexical.Finder(["an", "ban", "nan"])
    assert [[x.tolist() for x in again.found(t)] for t in texts] == want
