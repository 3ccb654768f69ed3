"""Chunkers against plain statements of their rules, and their invariants."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docsift.operators.chunking import METHODS, available_methods, chunk, default_methods
from docsift.operators.chunking.packing import recursive_split
from docsift.operators.chunking.splitter import split_text
from docsift.operators.chunking.structure import structural, structural_min
from docsift.operators.numbering import fill_missing, number_members, number_pieces, number_rows, running_totals

SF = "/root/testdata/sf0.001"

CONTRACT = """AGREEMENT BETWEEN THE SIDES, WHICH IS LONG ENOUGH TO STAY

1. ACCEPTANCE
This clause says that both sides accept the terms set out below.
1.1 Definitions of the words that the rest of this text relies on.
1.2 Scope of the work that is to be done under this agreement.
2. PAY
Short.
3. PAYMENT TERMS
The fee is due within thirty days after the invoice was received.
[SIGNATURE BLOCK]"""


def one(spark, body):
    return spark.createDataFrame([(1, body)], "doc_id long, text string")


def test_structural(spark):
    rows = structural(one(spark, CONTRACT)).orderBy("pos").collect()
    assert [(r["level"], r["clause_number"], r["parent"]) for r in rows] == [
        (1, None, None), (1, "1", None), (2, "1.1", "1"), (2, "1.2", "1"), (1, "2", None), (2, "2.1", "2"),
        (1, "3", None), (2, "3.1", "3")]
    assert rows[0]["preserved"] and rows[1]["title"] == "ACCEPTANCE"


def test_long_subclause_becomes_units(spark):
    body = "1. A\n1.1 " + " ".join(f"Sentence number {i} has six words." for i in range(150))
    rows = structural(one(spark, body)).orderBy("pos").collect()
    units = [r for r in rows if r["level"] == 3]
    assert len(units) > 1 and units[0]["clause_number"] == "1.1.1" and units[0]["parent"] == "1.1"
    assert all(len(re.findall(r"\w+", r["text"])) <= 300 for r in units)


def test_structural_min_repairs_gaps(spark):
    rows = structural_min(one(spark, CONTRACT)).orderBy("pos").collect()
    assert [r["level"] for r in rows] == [1, 1, 2, 2, 1]
    many = "1. A\n" + "\n".join(f"{i}. tiny {i}" for i in range(2, 9))
    gap = structural_min(one(spark, many)).collect()
    assert len(gap) == 1 and "8. tiny 8" in gap[0]["text"] and gap[0]["section_number"] is None


def test_structural_min_loses_no_text(spark):
    for body in ("tiny", "1. A\n2. B\n3. C", "1. " + "long enough " * 8 + "\n2. x\n3. " + "long again " * 8 + "\n4. y", "1. x\n2. " + "long enough " * 8):
        top = [r for r in structural_min(one(spark, body)).orderBy("pos").collect() if r["level"] == 1]
        assert re.sub(r"\s+", "", "".join(r["text"] for r in top)) == re.sub(r"\s+", "", body)


def test_process_document_loses_no_text(spark, tmp_path):
    """A 10-character document, and a section whose last paragraph is a short tail."""
    from docsift.suite import QUERIES

    bodies = {1: "ten chars.", 2: "1. Scope\n" + "This clause has quite some words in it " * 14 + "\n\nshort tail", 3: "tiny\n\n" + "word " * 130}
    spark.createDataFrame(list(bodies.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["c12_process_document"](spark, str(tmp_path)).filter("level = 1").collect()
    for doc, body in bodies.items():
        found = [r for r in sorted(rows, key=lambda r: (r["original"], r["_p"], r["_q"], r["_r"])) if r["doc_id"] == doc]
        assert set(re.findall(r"\w+", " ".join(r["text"] for r in found))) == set(re.findall(r"\w+", body))
        assert all(len(r["text"]) >= 50 for r in found) or len(found) == 1


def test_ingest_runs_all_methods_and_vectors(spark, tmp_path):
    from docsift.suite import QUERIES

    rows = [(i, f"src{i}", CONTRACT + f"\nThe number {i} is named here. Another sentence follows it.") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["l1_ingest"](spark, str(tmp_path)).select("chunking_method", "embedding_digest").collect()
    assert {r["chunking_method"] for r in got} == set(available_methods())
    assert all(r["embedding_digest"] for r in got) and len({r["embedding_digest"] for r in got}) > 3


def brute_recursive(body, limit=500):
    """The splitting rule written as a recursion."""
    if len(body) <= limit:
        return [body]
    paras = re.split(r"\n\n+", body)
    if len(paras) > 1:
        return [x for p in paras if p.strip() for x in ([p.strip()] if len(p.strip()) <= limit else brute_recursive(p.strip(), limit))]
    sents = [s.strip() for s in re.split(r"[.!?]+\s+", body) if s.strip()]
    if len(sents) > 1:
        packs, cur, used = [], [], 0
        for s in sents:
            if not cur or used + len(s) <= limit:
                cur.append(s)
                used += len(s) + 1
            else:
                packs.append(" ".join(cur))
                cur, used = [s], len(s)
        packs.append(" ".join(cur))
        return [x for p in packs for x in ([p] if len(p) <= limit else brute_recursive(p, limit))]
    words, size = body.split(), len(body[:limit].split())
    step = size - int(size * 0.15)
    return [" ".join(words[i:i + size]) for i in range(0, len(words), step)]


def test_recursive_split_matches_the_recursion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text", F.regexp_replace("text", "\n", F.when(F.col("doc_id") % 2 == 0, "\n\n").otherwise("\n")))
    got = {}
    for r in recursive_split(docs, "text").orderBy("doc_id", "_p", "_q", "_r").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for r in docs.collect():
        assert got[r["doc_id"]] == brute_recursive(r["text"]), r["doc_id"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_splitter_bounds_and_coverage(body):
    chunks = split_text(body, 40, 8, ["\n\n", "\n", ". ", " ", ""])
    assert all(0 < len(c) <= 40 for c in chunks)
    left = "".join(body.split())
    for c in chunks:
        assert "".join(c.split()) in left


@pytest.mark.parametrize("method", list(METHODS))
def test_every_method_covers_every_document(spark, method):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = chunk(docs, method)
    stats = rows.agg(F.count_distinct("doc_id").alias("d"), F.min(F.length("text")).alias("n")).first()
    assert stats["d"] == docs.count() and stats["n"] > 0
    words = lambda df: df.select(F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("w")).filter("w <> ''").distinct()
    from docsift.functions.text import preprocess

    whole = words(docs.select(preprocess(F.col("text")).alias("text")))
    assert words(rows).exceptAll(whole).count() == 0
    assert whole.join(words(rows), "w", "left_anti").count() == 0


def test_registry(spark):
    assert available_methods()[0] == "hierarchical"
    assert default_methods() == ["hierarchical", "semantic", "structural"]
    with pytest.raises(ValueError):
        chunk(one(spark, "x"), "unknown")


@pytest.mark.parametrize("parts", ["2", "7"])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g"))
        got = {r["k"]: r["chunk_number"] for r in number_rows(rows, ["k"], start=5).collect()}
        assert got == {k: k + 5 for k in range(500)}
        within = number_rows(rows, ["k"], ["g"]).collect()
        for g in range(3):
            assert sorted(r["chunk_number"] for r in within if r["g"] == g) == list(range(1, sum(r["g"] == g for r in within) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fill_missing_continues_after_the_highest(spark):
    rows = spark.createDataFrame([("f", 3, 1), ("f", None, 2), ("f", None, 3), ("g", None, 1)], "f string, chunk_number long, id int")
    got = sorted((r["f"], r["id"], r["chunk_number"]) for r in fill_missing(rows, ["f"], ["id"]).collect())
    assert got == [("f", 1, 3), ("f", 2, 4), ("f", 3, 5), ("g", 1, 0)]


def test_pieces_are_numbered_from_group_sizes(spark):
    sizes = [(d, m, (d * 7 + m * 3) % 5) for d in range(40) for m in range(2)] + [(40, 0, 3000), (41, 0, None)]
    df = spark.createDataFrame(sizes, "doc_id long, method_ord int, n long").repartition(7)
    want, total = {}, 0
    for d, m, n in sorted(sizes, key=lambda r: r[:2]):
        for p in range(n or 0):
            total += 1
            want[d, m, p + 1] = total + 9
    got = number_pieces(df, ["doc_id", "method_ord"], start=10).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["method_ord"], r["pos"]): r["chunk_number"] for r in got} == want
    before = {(r["doc_id"], r["method_ord"]): r["before"] for r in running_totals(df, ["doc_id", "method_ord"], "n").collect()}
    assert len(before) == len(sizes) and before[0, 0] == 0 and before[41, 0] == total
    assert number_pieces(df.limit(0), ["doc_id", "method_ord"]).count() == 0


@pytest.mark.parametrize("gap", [False, True])
def test_members_are_numbered_with_and_without_gaps(spark, gap):
    rows = [(d, m, p + 3 + (gap and d == 2 and p > 1), f"{d}.{m}.{p}") for d in range(5) for m in range(2) for p in range((d + m) % 4)]
    df = spark.createDataFrame(rows, "doc_id long, method_ord int, pos long, text string").repartition(3)
    got = {r["text"]: r["chunk_number"] for r in number_members(df, ["doc_id", "method_ord"], "pos", 7).collect()}
    assert got == {r[3]: i + 7 for i, r in enumerate(sorted(rows))}


def test_methods_that_cut_alike_cut_once(spark):
    from docsift.plans.ingest import chunk_documents

    docs = spark.createDataFrame([(1, "1. Terms\nThe client shall pay. " * 30), (2, "plain words")], "doc_id long, text string")
    calls = lambda ms: chunk_documents(docs, ms)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert calls(["hierarchical", "structural"]) == calls(["structural"])
    rows = chunk_documents(docs, ["structural", "recursive", "hierarchical"]).collect()
    texts = {m: sorted((r["doc_id"], r["pos"], r["text"]) for r in rows if (r["chunking_method"], r["method_ord"]) == m)
             for m in (("structural", 0), ("recursive", 1), ("hierarchical", 2))}
    assert texts["structural", 0] == texts["hierarchical", 2] and sum(map(len, texts.values())) == len(rows)


def test_only_groups_with_gaps_are_sorted_for_their_numbers(spark, monkeypatch):
    from docsift.operators import numbering

    seen, plain = [], numbering.number_rows
    monkeypatch.setattr(numbering, "number_rows", lambda rows, *a, **k: seen.append(rows.count()) or plain(rows, *a, **k))
    df = spark.createDataFrame([(d, p) for d, ps in ((1, (1, 2, 3)), (2, (5, 9, 7)), (3, (4,))) for p in ps], "doc_id long, pos long")
    got = {(r["doc_id"], r["pos"]): r["chunk_number"] for r in number_members(df, ["doc_id"], "pos", 1).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 5): 4, (2, 7): 5, (2, 9): 6, (3, 4): 7} and seen == [3]


def test_inputs_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from docsift.operators import layout

    df = spark.range(100).withColumn("text", F.repeat(F.lit("words "), F.lit(50)))
    monkeypatch.setattr(layout, "SMALL", 0, raising=False)
    monkeypatch.setattr(layout, "TASK", 1 << 7, raising=False)
    assert layout.spread(df, "id").rdd.getNumPartitions() > 8 and layout.spread(df, "id").count() == 100


def test_vectors_of_texts_beyond_latin(spark):
    from hashlib import md5

    import numpy as np
    import regex
    from docsift.functions import vectors

    texts = ["Été œuvre ² _x1 x1", "日本 語 ٠١ a", "", None, "‘a’—b… ª"]
    want = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for token in regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower()):
            h = md5(token.encode()).hexdigest()
            want[row, int(h[:2], 16) % 64] += 1 if int(h[2], 16) < 8 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    assert (vectors.hashing_embed()(texts) == want).all()
    same = [c for c in map(chr, range(0x110000)) if not vectors._OTHER.match(c)]
    assert all(bool(vectors._WORD.match(c)) == bool(vectors._TOKEN.match(c)) for c in same)


def test_splitter_leaves_in_parts(spark):
    """A batch of long texts is split in stretches of bytes, so that its chunks aren't all held at once."""
    import pyarrow as pa

    from docsift.operators.chunking import splitter as module

    texts = [None, "", *[f"Sentence {i} of a text. " * 20_000 for i in range(8)]]
    parts = list(module.splitter().func(iter([pa.array(texts)])))
    assert len(parts) >= 3 and max(p.nbytes for p in parts) < 4 * module.CUT
    got = [chunks for p in parts for chunks in p.to_pylist()]
    assert got == [module.split_text(t, 500, 50, module.RECURSIVE_SEPARATORS) if t else [] for t in texts]
