"""Small cases worked out by hand."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsift.functions import ids, legal, responses, text, tokens
from docsift.operators import bm25, fusion, lexical, numbering, phrases, ranking, references, rerank, vector
from docsift.operators.chunking.windows import char_windows, word_windows

DOCS = [("d1", "the agency shall pay the fee"), ("d2", "the client must pay"), ("d3", "termination of the agreement")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "id string, text string").coalesce(1)


def queries(spark, q):
    return spark.createDataFrame([(1, q)], "query_id long, text string")


def by_id(df, col="score"):
    return {r["id"]: r[col] for r in df.collect()}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_phrases(spark, corpus):
    rows = phrases.scores(corpus, queries(spark, "the client shall pay"))
    assert by_id(rows) == {"d1": 1.0, "d2": pytest.approx(0.833333, abs=1e-6), "d3": pytest.approx(0.166667, abs=1e-6)}


def test_bm25(spark, corpus):
    rows = bm25.top(corpus, queries(spark, "the client shall pay"), 5, lambda c: text.words(F.lower(c)))
    assert by_id(rows, "original_score") == {"d1": 0.542048, "d2": 0.633013, "d3": 0.043546}
    assert by_id(rows) == {"d1": pytest.approx(0.845684, abs=2e-6), "d2": 1.0, "d3": 0.0}


def test_bm25_without_match_is_all_one(spark, corpus):
    rows = bm25.top(corpus, queries(spark, "zebra"), 2)
    assert [(r["id"], r["score"]) for r in rows.orderBy("rank").collect()] == [("d1", 1.0), ("d2", 1.0)]


def test_bm25_empty_query_gives_no_rows(spark, corpus):
    assert bm25.top(corpus, queries(spark, "?!"), 2).count() == 0


def test_bm25_ranks_misses_above_negative_scores(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "x")], "id long, text string")
    rows = bm25.top(c, queries(spark, "a"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(3, 1.0), (1, 0.0)] and rows[1]["original_score"] < 0


def test_bm25_accepts_a_stored_vocabulary(spark, corpus, tmp_path):
    path = str(tmp_path / "vocab")
    bm25.vocabulary(corpus, text.word_tokens(F.col("text"))).write.parquet(path)
    q = queries(spark, "the client shall pay")
    assert by_id(bm25.scores(corpus, q, vocab=spark.read.parquet(path))) == by_id(bm25.scores(corpus, q))


def test_lexical(spark, corpus):
    rows = lexical.scores(corpus, queries(spark, "agency fee")).collect()
    assert [(r["id"], r["score"], r["keyword_matches"]) for r in rows] == [("d1", 0.696429, 2)]


def test_lexical_without_keywords(spark, corpus):
    assert lexical.scores(corpus, queries(spark, "the of a")).count() == 0


def ranked_list(spark, names):
    return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], "query_id int, id string, rank int")


def test_weighted_rrf(spark):
    lists = [(n, ranked_list(spark, ids_)) for n, ids_ in (("a", "xy"), ("b", "yz"), ("c", "z"))]
    got = by_id(fusion.weighted_rrf(lists, [0.4, 0.35, 0.25]))
    assert {k: round(v, 6) for k, v in got.items()} == {"y": 0.012189, "z": 0.009744, "x": 0.006557}


def test_rrf_is_symmetric(spark):
    a, b = (ranked_list(spark, x).withColumn("key", F.col("id")).withColumn("score", F.lit(1.0)) for x in ("xy", "yz"))
    one, two = by_id(fusion.rrf_by_text(a, b)), by_id(fusion.rrf_by_text(b, a))
    assert one == two
    assert {k: round(v, 6) for k, v in one.items()} == {"y": 0.032522, "x": 0.016393, "z": 0.016129}


def test_legal_boost(spark):
    body = F.lit("Client shall pay the fee under clause 3.1 and clause 4.2.")
    assert value(spark, legal.clause_type(body)) == "PAYMENT"
    assert value(spark, legal.boost(body, F.lit("Client obligations"))) == pytest.approx(3.29472)


def test_sentences(spark):
    c = F.lit("One. Two?  Three!\nFour")
    assert value(spark, text.sentences_keep(c)) == ["One.", "Two?", "Three!", "Four"]
    assert value(spark, text.sentences_drop(c)) == ["One", "Two", "Three", "Four"]


def test_word_windows(spark):
    c = F.lit(" ".join(str(i) for i in range(1, 24)))
    got = [(w.split()[0], w.split()[-1]) for w in value(spark, word_windows(c, 10, 0.15))]
    assert got == [("1", "10"), ("10", "19"), ("19", "23")]


@pytest.mark.parametrize("n", [1, 9, 10, 11, 18, 19, 37])
def test_char_windows_follow_the_running_buffer(spark, n):
    body = "".join(chr(97 + i % 26) for i in range(n))
    want, buffer = [], ""
    for ch in body:
        buffer += ch
        if len(buffer) >= 10:
            want.append(buffer)
            buffer = buffer[-2:]
    want.append(buffer)
    assert value(spark, char_windows(F.lit(body), 10, 2)) == want


def test_point_id(spark):
    c = ids.point_id(F.lit("contract.md"), F.lit("structural"), F.lit(0))
    assert int(value(spark, c)) == 2960096982099891149


def test_rank_list(spark):
    assert value(spark, responses.rank_order(F.lit("3,1,5,2,9,3"), F.lit(5))) == [2, 0, 4, 1, 3]


def test_min_max_ties(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "query_id int, id string, score double")
    assert by_id(ranking.min_max(rows, ["query_id"])) == {"a": 1.0, "b": 1.0}


def test_confidence_fallback(spark):
    rows = spark.createDataFrame([(1, c, s) for c, s in zip("abcd", (0.4, 0.3, 0.2, 0.1))], "query_id int, id string, score double")
    low = ranking.confident(rows, 0.5, ["query_id"]).collect()
    assert sorted(r["id"] for r in low) == ["a", "b", "c"] and all(r["low_confidence"] for r in low)
    high = ranking.confident(rows, 0.3, ["query_id"]).collect()
    assert sorted(r["id"] for r in high) == ["a", "b"] and not any(r["low_confidence"] for r in high)


def test_entities(spark):
    block = ("Client Information:\nJohn Stone\nAcme Trading Ltd\nCompany address: 1 High Street\n"
             "Company E-mail address: c@d.org\nPhone number: 020 7000 1111")
    e = value(spark, legal.entities(F.lit(block)))
    # A labelled block ends with its line, so the firm comes from the plain pattern, which runs over line ends.
    assert (e["individual_name"], e["email"]) == ("John Stone", "c@d.org")
    assert e["company_name"] == "John Stone\nAcme Trading Ltd\nCompany"
    assert e["phone"] == "02070001111"
    empty = value(spark, legal.entities(F.lit("nothing here")))
    assert all(empty[f] is None for f in ("individual_name", "company_name", "address", "email", "phone"))


def test_clean_section_drops_blocks(spark):
    body = "# T\n## Abstract again\na\n### Summary\ngone\n\nkept\n### Introduction\ngone\n### Next\nb"
    assert value(spark, text.clean_section(F.lit(body))) == "# T\na\n\nkept\n### Next\nb"


def test_numbers_have_no_upper_limit(spark):
    rows = spark.createDataFrame([("7000000000",), ("-3",), ("x",), (None,)], "chunk_number string")
    assert rows.agg(numbering.max_number().alias("n")).first()["n"] == 7_000_000_000


def test_all_phrasings_are_kept(spark):
    row = spark.createDataFrame([("Chromatic number",)], "text string").select(tokens.expand_query(F.col("text")).alias("v"), tokens.expand_query(F.col("text"), 3).alias("some")).first()
    assert len(row["v"]) == 9 and row["v"][-1].endswith(" arises") and row["some"] == row["v"][:3]


def test_references_match_by_any_year_of_a_date(spark):
    texts = spark.createDataFrame([(1, "see [Kim, 2021] and [Lee, 1999]")], "doc_id long, text string")
    refs = spark.createDataFrame([(4, "T4", "", "May 2021"), (5, "T5", "", "2021"), (6, "T6", "Lee", "around 1999/2000")], "ordinal long, title string, author string, date string")
    got = {r["author"]: (r["ordinal"], r["title"]) for r in references.resolve_author_year(texts, refs).collect()}
    assert got == {"Kim": (4, "T4"), "Lee": (6, "T6")}


def test_best_rows_per_group(spark):
    rows = [(i, [float(i % 7), 1.0], "ab"[i % 2]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, g string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    got = vector.top(corpus, asked, 3, group="g").collect()
    assert sorted((r["g"], r["rank"], r["id"]) for r in got) == [("a", 1, 6), ("a", 2, 20), ("a", 3, 34), ("b", 1, 13), ("b", 2, 27), ("b", 3, 5)]


def test_equal_openings_are_different_texts(spark):
    same = "word " * 60
    rows = spark.createDataFrame([(1, 1, same + "one", 0.5), (1, 2, same + "two", 0.4), (1, 3, same.upper() + " ONE", 0.3)], "query_id long, id long, text string, score double")
    features = rerank.query_features(spark.createDataFrame([(1, "zebra crossing")], "query_id long, text string"))
    assert sorted(r["id"] for r in rerank.keyword_boost(rows, features).collect()) == [1, 2]


def test_contained_finds_every_pair(spark):
    import random

    rng = random.Random(5)
    text = lambda top: "".join(rng.choice("ab c") for _ in range(rng.randrange(top)))
    needles, hays = {text(7) for _ in range(60)}, {text(14) for _ in range(80)}
    want = sorted((n, h) for n in needles for h in hays if n and n in h)
    got = references.contained(spark.createDataFrame([(n,) for n in needles] * 2, "needle string"), spark.createDataFrame([(h,) for h in hays] * 2, "hay string"))
    assert sorted((r["needle"], r["hay"]) for r in got.collect()) == want


def test_used_references(spark):
    refs = spark.createDataFrame(
        [(1, "One", "Kim, Lee", "2020"), (2, "ONE", "kim, lee", "2021"), (3, "Three", None, "2019-05-01"), (4, "Four", "Ng", None)],
        "ordinal long, title string, author string, date string")
    texts = spark.createDataFrame([
        (1, "a [2, 1] b [Kim, 2020] c [9]"), (2, "[Roe, 2019] [Roe, 1999] [ROE, 1999]"), (3, "nothing"), (4, None), (5, "[9]"), (6, "[Zed, 1990] [Ng, 1990]"), (7, "[ , 2021]")],
        "doc_id long, text string")
    rows = references.used_references(texts, refs).orderBy("doc_id", "place").collect()
    got = [(r["doc_id"], r["place"], r["ordinal"], r["title"], r["source_type"]) for r in rows]
    assert got == [
        (1, 1, 1, "One", "reference"), (2, 1, 3, "Three", "reference"), (2, 2, None, "Research paper by Roe", "placeholder"),
        (3, 0, None, None, "all references"), (4, 0, None, None, "all references"),
        (6, 1, None, "Research paper by Zed", "placeholder"), (6, 2, 4, "Four", "reference"), (7, 1, 2, "ONE", "reference")]
    assert references.used_references(texts, refs.limit(0)).filter("doc_id = 3").count() == 0


def test_ngrams_are_stretches_of_their_text():
    """N-grams of a batch are cut at once, whatever the texts, nulls and slices."""
    def plain(text, upto):
        words = text.split(" ") if text else []
        return None if text is None else [" ".join(words[i : i + n]) for n in range(1, upto + 1) for i in range(len(words) - n + 1)]

    texts = ["a bé ccc 日本 x", None, "", "one", "日本 日本", "a b", None, "last one of all of them"]
    for lo in range(len(texts)):
        for hi in range(lo, len(texts) + 1):
            for upto in (1, 2, 5):
                got = tokens.cut_ngrams(pa.array(texts, pa.string())[lo:hi], upto)
                assert got.to_pylist() == [plain(t, upto) for t in texts[lo:hi]]


def test_ngrams_in_tables(spark):
    rows = [(1, "The  FEE is\tdue"), (2, ""), (3, None), (4, " \n ")]
    df = spark.createDataFrame(rows, "id long, text string").select("id", tokens.blank_ngrams(F.col("text"), 3).alias("g"), tokens.word_ngrams(F.col("text"), 2).alias("w"))
    got = {r["id"]: (r["g"], r["w"]) for r in df.collect()}
    assert got[1][0] == ["the", "fee", "is", "due", "the fee", "fee is", "is due", "the fee is", "fee is due"]
    assert got[1][1] == ["the", "fee", "is", "due", "the fee", "fee is", "is due"]
    assert got[2] == got[4] == ([], []) and got[3] == (None, None)
