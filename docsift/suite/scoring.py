"""Scorers and fusion, every benchmark passage as a query over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dedup_key, word_tokens, words
from ..operators import bm25, fusion, lexical, phrases, ranking, vector
from . import sqlbits as s
from .registry import query
from .texts import SQL_KEYWORDS
from .views import corpus, text_queries

K = 5
_D = "d AS (SELECT doc_id AS id, text FROM documents)"
_Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


def texts(t):
    return corpus(t).select("id", "text")


def blank_words(c):
    return words(F.lower(c))


def _blank(x: str) -> str:
    return s.words(f"lower({x})")


@query("f6_bm25_search", f"""
WITH {_D}, {_Q}, {s.bm25('d', 'q', 5)},
 k AS MATERIALIZED (SELECT id, md5({s.dedup_key('text')}) AS k FROM d),
 c AS (SELECT * FROM b_rank JOIN k USING (id)),
 u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rk) = 1)
SELECT query_id, id, norm AS score, score AS original_score, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rank FROM u QUALIFY rank <= {K}""")
def _(t):
    rows = bm25.search(texts(t), text_queries(t), K, dedup_key(F.col("text")))
    return rows.select("query_id", "id", "score", "original_score", F.col("rank").cast("long").alias("rank"))


@query("f6_bm25_scores", f"WITH {_D}, {_Q}, {s.bm25('d', 'q')} SELECT query_id, id, score FROM s")
def _(t):
    return bm25.scores(texts(t), text_queries(t), word_tokens)


@query("f7_bm25_words", f"WITH {_D}, {_Q}, {s.bm25('d', 'q', 1, _blank)} SELECT query_id, id, by_max AS score, rk AS rank FROM b_rank WHERE rk <= 10")
def _(t):
    rows = bm25.top(texts(t), text_queries(t), 10, blank_words, norm="max")
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# Queries no document can answer: the list is filled with zero scores, smallest id first.
@query("f6_bm25_zero_fill", f"""
WITH {_D}, q AS (SELECT item_id AS query_id, 'zq' || item_id || CASE WHEN item_id % 2 = 0 THEN ' ' || text ELSE '' END AS text FROM benchmark), {s.bm25('d', 'q')}
SELECT query_id, id, norm AS score, rk AS rank FROM b_rank WHERE rk <= 20""")
def _(t):
    i = F.col("item_id")
    asked = t.benchmark.select(i.alias("query_id"), F.concat(F.lit("zq"), i, F.when(i % 2 == 0, F.concat(F.lit(" "), "text")).otherwise("")).alias("text"))
    rows = bm25.top(texts(t), asked, 20, word_tokens)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("h13_corpus_stats", f"""
WITH {_D}, {_Q}, {s.bm25('d', 'q')}
SELECT token, count(*) AS df FROM b_tf GROUP BY token UNION ALL SELECT ' docs', n FROM b_st UNION ALL SELECT ' length', sum(dl)::BIGINT FROM b_d""")
def _(t):
    return bm25.vocabulary(texts(t), word_tokens(F.col("text"))).select("token", F.col("n").alias("df"))


_PHRASES = f"""gw AS MATERIALIZED (SELECT id, {_blank('text')} AS ws FROM d), qw AS MATERIALIZED (SELECT query_id, {_blank('text')} AS ws FROM q),
 g AS ({s.gram_rows('gw', 'id', 'ws', 5)}),
 qg AS (SELECT query_id, gram, count(*) * len(string_split(gram, ' ')) AS w FROM ({s.gram_rows('qw', 'query_id', 'ws', 5)}) GROUP BY query_id, gram),
 raw AS (SELECT query_id, id, sum(w)::DOUBLE AS raw FROM g JOIN qg USING (gram) GROUP BY ALL),
 ph AS MATERIALIZED (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 9) AS score FROM raw)"""


@query("f9_phrase_scores", f"WITH {_D}, {_Q}, {_PHRASES} SELECT query_id, id, score FROM ph")
def _(t):
    return phrases.scores(texts(t), text_queries(t)).select("query_id", "id", "score")


@query("f8_phrase_top", f"WITH {_D}, {_Q}, {_PHRASES} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ph QUALIFY rank <= 10")
def _(t):
    return phrases.top(texts(t), text_queries(t), 10).withColumn("rank", F.col("rank").cast("long"))


def lexical_sql(position: bool) -> str:
    extra = "occ / greatest(nwords, 1) * 0.3::DOUBLE + greatest((chars - avgpos) / chars, 0.0) * 0.2::DOUBLE" if position else "occ / greatest(nwords, 1) * 0.5::DOUBLE"
    return f"""kq AS MATERIALIZED (SELECT query_id, kw, count(*) AS times, sum(count(*)) OVER (PARTITION BY query_id) AS k FROM (SELECT query_id, unnest({SQL_KEYWORDS}) AS kw FROM q) GROUP BY query_id, kw),
 kk AS (SELECT DISTINCT kw FROM kq),
 dd AS MATERIALIZED (SELECT id, lower(text) AS t, length(lower(text)) AS chars, len({_blank('text')}) AS nwords FROM d),
 hit AS MATERIALIZED (SELECT id, chars, nwords, kw, strpos(t, kw) - 1 AS pos, (length(t) - length(replace(t, kw, ''))) / length(kw) AS n FROM dd, kk WHERE contains(t, kw)),
 lex AS MATERIALIZED (SELECT query_id, id, round(least(hits / k * 0.5::DOUBLE + {extra}, 1.0), 6) AS score, hits AS keyword_matches, kws AS matched_keywords FROM (
   SELECT query_id, id, k, chars, nwords, sum(times)::BIGINT AS hits, sum(times * n) AS occ, sum(times * pos) / sum(times) AS avgpos, string_agg(DISTINCT kw, ' ' ORDER BY kw) AS kws
   FROM hit JOIN kq USING (kw) GROUP BY ALL))"""


@query("f10_lexical_scores", f"WITH {_D}, {_Q}, {lexical_sql(True)} SELECT query_id, id, score, keyword_matches, matched_keywords FROM lex")
def _(t):
    return lexical.scores(texts(t), text_queries(t)).withColumn("matched_keywords", F.array_join("matched_keywords", " "))


@query("f11_lexical_no_position", f"WITH {_D}, {_Q}, {lexical_sql(False)} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 10")
def _(t):
    rows = lexical.top(texts(t), text_queries(t), 10, position=False)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# ---- vectors: the mean vector of every label is a query ------------------------

VEC_SQL = """v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
 cen AS MATERIALIZED (SELECT label AS query_id, list(m ORDER BY p) AS e FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(1, 65)) AS p FROM v) GROUP BY ALL) GROUP BY label),
 sim AS MATERIALIZED (SELECT query_id, id, label, round(list_cosine_similarity(cen.e, v.e), 6) + 0.0 AS score FROM v, cen),
 vr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim)"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def centroid_queries(t):
    return vector.centroids(t.embeddings, "label", "embedding").select(F.col("label").alias("query_id"), F.col("embedding").alias("vec"))


@query("h16_centroids", f"WITH {VEC_SQL} SELECT query_id AS label, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sq, round(e[1], 6) AS first, round(e[64], 6) AS last FROM cen")
def _(t):
    e = F.col("vec")
    sq = F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return centroid_queries(t).select(F.col("query_id").alias("label"), F.round(sq, 6).alias("sq"), F.round(e[0], 6).alias("first"), F.round(e[63], 6).alias("last"))


@query("f2_vector_top", f"WITH {VEC_SQL} SELECT query_id, id, score, rank FROM vr WHERE rank <= 20")
def _(t):
    return vector.top(vectors(t).select("id", "vec"), centroid_queries(t), 20).withColumn("rank", F.col("rank").cast("long"))


@query("f5_vector_scores", f"WITH {VEC_SQL} SELECT query_id, id, score FROM sim")
def _(t):
    return vector.scores(vectors(t).select("id", "vec"), centroid_queries(t))


# Every vector is a query: more than one block of queries at larger scales.
@query("f2_vector_self_top", """
WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) AS rank FROM v a, v b QUALIFY rank <= 5""")
def _(t):
    v = vectors(t).select("id", "vec")
    return vector.top(v, v.withColumnRenamed("id", "query_id"), 5).withColumn("rank", F.col("rank").cast("long"))


@query("f3_distance_score", f"WITH {VEC_SQL} SELECT query_id, id, round(greatest(0.0, 1 - (1 - score) / 2), 6) AS score FROM vr WHERE rank <= 20")
def _(t):
    rows = vector.top(vectors(t).select("id", "vec"), centroid_queries(t), 20)
    return rows.select("query_id", "id", F.round(vector.distance_score(F.col("score")), 6).alias("score"))


_MM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END"


@query("f12_min_max", f"WITH {VEC_SQL} SELECT query_id, id, {_MM} AS score, score AS original_score FROM vr WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)")
def _(t):
    rows = vector.normalised(vector.top(vectors(t).select("id", "vec"), centroid_queries(t), 20))
    return rows.select("query_id", "id", "score", "original_score")


@query("f29_cohorts", f"WITH {VEC_SQL} SELECT query_id, label AS cohort_id, id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM sim QUALIFY rank <= 3")
def _(t):
    from ..plans.search import compare_cohorts

    v = vectors(t).withColumnRenamed("label", "cohort_id")
    rows = compare_cohorts(v, centroid_queries(t), 3)
    return rows.select("query_id", "cohort_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("e6_confidence", f"""
WITH {VEC_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM vr WHERE rank <= 20)
SELECT query_id, id, score, rank, mx < 0.8 AS low_confidence FROM m WHERE (mx >= 0.8 AND score >= 0.8) OR (mx < 0.8 AND rank <= 3)""")
def _(t):
    rows = vector.top(vectors(t).select("id", "vec"), centroid_queries(t), 20).drop("rank")
    return ranking.confident(rows, 0.8, ["query_id"]).withColumn("rank", F.col("rank").cast("long"))


@query("h12_score_log", f"WITH {VEC_SQL} SELECT query_id, max(score) AS max_score, min(score) AS min_score, round(avg(score), 6) AS avg_score, count(*) AS n FROM sim GROUP BY query_id")
def _(t):
    rows = vector.scores(vectors(t).select("id", "vec"), centroid_queries(t))
    return rows.groupBy("query_id").agg(
        F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("score"), 6).alias("avg_score"), F.count("*").alias("n"))


# ---- fusion --------------------------------------------------------------------

_LISTS = f"""{_D}, {_Q}, {s.bm25('d', 'q')}, {_PHRASES}, {lexical_sql(True)},
 l1 AS (SELECT query_id, id, rk AS rank FROM b_rank WHERE rk <= 20),
 l2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ph QUALIFY rank <= 20),
 l3 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 20)"""


def lists(t):
    c, q = texts(t), text_queries(t)
    return bm25.top(c, q, 20, word_tokens), phrases.top(c, q, 20), lexical.top(c, q, 20)


@query("f14_weighted_rrf", f"""
WITH {_LISTS}, u AS (SELECT *, 0.4 AS w, 'bm25' AS m FROM l1 UNION ALL SELECT *, 0.35, 'phrase' FROM l2 UNION ALL SELECT *, 0.25, 'lexical' FROM l3)
SELECT query_id, id, round(sum(w / (60 + rank))::DOUBLE, 9) AS score, string_agg(m, ',' ORDER BY m) AS methods FROM u GROUP BY query_id, id""")
def _(t):
    a, b, c = lists(t)
    rows = fusion.weighted_rrf([("bm25", a), ("phrase", b), ("lexical", c)], [0.4, 0.35, 0.25])
    return rows.withColumn("methods", F.array_join("methods", ","))


@query("f13_rrf", f"""
WITH {_LISTS}, k AS (SELECT id, md5({s.dedup_key('text')}) AS key FROM d),
 a AS (SELECT query_id, key, min(rank) AS rank FROM l1 JOIN k USING (id) GROUP BY ALL), b AS (SELECT query_id, key, min(rank) AS rank FROM l2 JOIN k USING (id) GROUP BY ALL)
SELECT query_id, key, round(coalesce(1.0 / (60 + a.rank), 0)::DOUBLE + coalesce(1.0 / (60 + b.rank), 0)::DOUBLE, 9) AS score, coalesce(a.rank, 0) AS first_rank, coalesce(b.rank, 0) AS second_rank
FROM a FULL JOIN b USING (query_id, key)""")
def _(t):
    a, b, _ = lists(t)
    keys = texts(t).select("id", F.md5(dedup_key(F.col("text"))).alias("key"))
    rows = fusion.rrf_by_text(a.join(keys, "id"), b.join(keys, "id"))
    return rows.select("query_id", "key", "score", F.coalesce("semantic_rank", F.lit(0)).cast("long").alias("first_rank"),
                       F.coalesce("bm25_rank", F.lit(0)).cast("long").alias("second_rank"))
