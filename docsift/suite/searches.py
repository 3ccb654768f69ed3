"""Whole searches, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.tokens import expand_query
from ..functions.vectors import embed_udf, hashing_embed
from ..operators import rerank, vector
from ..operators.layout import spread, unfold
from ..operators.numbering import staged
from ..plans import evaluate
from ..plans import search as plan
from . import sqlbits as s
from .registry import query
from .scoring import _PHRASES, _blank, lexical_sql
from .texts import CLAUSE_SQL, CRIT_SQL, EXPAND_SQL, OBLIG_SQL, PARTY_SQL, REF_SQL, SECTION_SQL, SQL_QWORDS, WEIGHT_SQL
from .views import LEGAL_SQL, legal_texts

K = 5
ASK = "' The Client shall pay the Vendor'"


def _embedded(df, key: str, *keep):
    """Texts with vectors, written once: embedding is what an index holds."""
    return staged(spread(df, key).select(key, "text", *keep, embed_udf(hashing_embed)(F.col("text")).alias("vec")))


def corpus(t, **more):
    """Texts with vectors and file names, and columns ``more`` made of their texts."""
    rows = legal_texts(t).select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(".txt")).alias("file_name"))
    return _embedded(rows, "id", "file_name", *[c.alias(name) for name, c in more.items()])


def queries(t):
    rows = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" The Client shall pay the Vendor")).alias("text"))
    return _embedded(rows, "query_id")


# Corpus, queries, cosines and the ranked semantic list.
BASE = f"""d AS MATERIALIZED (SELECT doc_id AS id, text, source || '.txt' AS file_name, md5({s.dedup_key('text')}) AS k FROM ({LEGAL_SQL})),
 q AS MATERIALIZED (SELECT item_id AS query_id, text || {ASK} AS text FROM benchmark),
 de AS MATERIALIZED ({s.embedding_cells('d', 'id')}), qe AS MATERIALIZED ({s.embedding_cells('q', 'query_id')}),
 dot AS (SELECT query_id, id, sum(de.v * qe.v) AS c FROM de JOIN qe USING (d) GROUP BY ALL),
 sem AS MATERIALIZED (SELECT query_id, id, round(coalesce(c, 0), 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(c, 0), 6) DESC, id) AS rk
   FROM (SELECT query_id, id FROM d, q) x LEFT JOIN dot USING (query_id, id))"""
_MM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END"


# Of equal texts the nearest row.
UNIQUE = """su AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS r FROM (
   SELECT sem.*, d.k FROM sem JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rk) = 1))"""


@query("k1_embedding", f"WITH d AS (SELECT doc_id AS id, text FROM documents), e AS ({s.embedding_cells('d', 'id')}) SELECT id, count(*) AS filled, round(sum(v), 6) + 0.0 AS total FROM e GROUP BY id")
def _(t):
    rows = spread(t.documents, "doc_id").select(F.col("doc_id").alias("id"), embed_udf(hashing_embed)(F.col("text")).alias("v"))
    filled = F.size(F.filter("v", lambda x: x != 0))
    return rows.filter(filled > 0).select("id", filled.cast("long").alias("filled"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"))


@query("f1_semantic_search", f"""
WITH {BASE}, {UNIQUE}, n AS (SELECT *, {_MM} AS norm FROM su WHERE r <= {2 * K} WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, norm AS score, score AS original_score, r AS rank FROM n WHERE r <= {K}""")
def _(t):
    rows = plan.search(corpus(t), queries(t), "semantic", K)
    return rows.select("query_id", "id", "score", "original_score", F.col("rank").cast("long").alias("rank"))


@query("f15_mixed_search", f"""
WITH {BASE}, {UNIQUE}, {s.bm25('d', 'q', 5)},
 a AS (SELECT query_id, k, id, r FROM su WHERE r <= {2 * K}),
 u AS (SELECT query_id, id, k, rk FROM b_rank JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rk) = 1),
 b AS (SELECT query_id, k, id, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS r FROM u QUALIFY r <= {2 * K}),
 i AS (SELECT query_id, coalesce(a.id, b.id) AS id, round(coalesce(1.0 / (60 + a.r), 0)::DOUBLE + coalesce(1.0 / (60 + b.r), 0)::DOUBLE, 9) AS score FROM a FULL JOIN b USING (query_id, k))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM i QUALIFY rank <= {K}""")
def _(t):
    rows = plan.search(corpus(t), queries(t), "mixed", K)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("f16_hybrid_search", f"""
WITH {BASE}, {UNIQUE}, {lexical_sql(True)},
 lu AS (SELECT lex.* FROM lex JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, d.k ORDER BY score DESC, id) = 1),
 l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM lu QUALIFY r <= {2 * K}),
 m AS (SELECT query_id, id, r FROM su WHERE r <= {2 * K}),
 f AS (SELECT query_id, id, round(coalesce(1.0 / (60 + m.r), 0)::DOUBLE + coalesce(1.0 / (60 + l.r), 0)::DOUBLE, 9) AS score FROM m FULL JOIN l USING (query_id, id)),
 u AS (SELECT f.* FROM f JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, d.k ORDER BY score DESC, id) = 1)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= {K}""")
def _(t):
    rows = plan.hybrid(corpus(t, text_key=plan.text_key()), queries(t), K)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_PARTY = f"(1.0 + 0.3 * len(list_filter({PARTY_SQL % 'text'}, lambda p: list_contains({PARTY_SQL % 'qtext'}, p))))::DOUBLE"


def boost_sql(src: str) -> str:
    """Contract features over rows with ``text`` and ``qtext``."""
    return f"""SELECT *, {WEIGHT_SQL} * CASE WHEN kind = 'DEFINITIONS' THEN 1.5 ELSE 1.0 END * CASE WHEN oblig THEN 1.2 ELSE 1.0 END * party * (1.0 + crit * 0.05) * (1.0 + refs * 0.1) AS boost
 FROM (SELECT *, {CLAUSE_SQL} AS kind, {OBLIG_SQL} AS oblig, {_PARTY} AS party, ({CRIT_SQL})::DOUBLE AS crit, {REF_SQL}::DOUBLE AS refs,
         CASE WHEN {SECTION_SQL} = '' THEN 'unknown' ELSE rtrim({SECTION_SQL}, '.') END AS section_id FROM (SELECT *, upper(text) AS u FROM ({src})))"""


@query("f21_legal_boost", f"""SELECT id, kind AS clause_type, section_id, oblig AS is_obligation, round(party, 6) AS party_relevance, round(0.5::DOUBLE * boost::DOUBLE, 9) AS final_score
FROM ({boost_sql(f"SELECT doc_id AS id, text, 'Client and Vendor obligations' AS qtext FROM ({LEGAL_SQL})")})""")
def _(t):
    rows = legal_texts(t).select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("query_id"), F.lit(0.5).alias("score"))
    asked = t.region.limit(1).select(F.lit(0).alias("query_id"), F.lit("Client and Vendor obligations").alias("text"))
    return rerank.legal_boost(rows, asked).select("id", "clause_type", "section_id", "is_obligation", "party_relevance", "final_score")


def distinct_list(src: str, order: str, n: int) -> str:
    """The best ``n`` of ``src``, of texts equal up to case and outer white space the first."""
    return f"""(SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS r FROM (
     SELECT x.* FROM {src} x JOIN h USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, h ORDER BY {order}) = 1) QUALIFY r <= {n})"""


_HASHES = f"h AS MATERIALIZED (SELECT id, md5(lower({s.strip('text')})) AS h FROM d)"


@query("f22_advanced_search", f"""
WITH {BASE}, {s.bm25('d', 'q', 1, _blank)}, {_PHRASES}, {_HASHES},
 u AS (SELECT query_id, id, 0.4::DOUBLE / (60 + r) AS p, 'semantic' AS m FROM {distinct_list('sem', 'rk', 4 * K)}
   UNION ALL SELECT query_id, id, 0.35::DOUBLE / (60 + r), 'bm25' FROM {distinct_list('b_rank', 'rk', 2 * K)}
   UNION ALL SELECT query_id, id, 0.25::DOUBLE / (60 + r), 'ngram' FROM {distinct_list('ph', 'score DESC, id', 2 * K)}),
 f AS (SELECT query_id, id, round(sum(p), 9) AS score, CASE WHEN count(*) = 1 THEN min(m) ELSE 'hybrid' END AS retrieval_method FROM u GROUP BY query_id, id),
 f3 AS (SELECT f.*, d.text, q.text AS qtext FROM f JOIN d USING (id) JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * K}),
 fin AS (SELECT *, round(score * boost::DOUBLE, 9) AS final_score FROM ({boost_sql('SELECT * FROM f3')}))
SELECT query_id, id, kind AS clause_type, section_id, retrieval_method, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM fin QUALIFY rank <= {K}""")
def _(t):
    rows = plan.advanced(corpus(t), queries(t), plan.SearchConfig(k=K))
    return rows.select("query_id", "id", "clause_type", "section_id", "retrieval_method", "final_score", F.col("rank").cast("long").alias("rank"))


# ---- retrieval with phrasings, boosts and documents ----------------------------

_CUE = " OR ".join(f"contains(low, '{c}')" for c in rerank.DEFINITION_CUES)
_NEAR = " OR ".join(f"contains(ctx, '{c}')" for c in rerank.NEAR_CUES)
_PUNCT = r"[.,!?;:()\[\]{}]+"
_TERMS = f"list_filter(list_transform({s.words('lower(v)')}, lambda w: regexp_replace(w, '^{_PUNCT}|{_PUNCT}$', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({SQL_QWORDS}))"
_OPEN = f"list_filter({s.words('lower(v)')}, lambda w: length(w) > 2 AND w NOT IN ({SQL_QWORDS}))"


def rerank_sql(cand: str) -> str:
    """CTEs from ``cand(query_id, id, score)`` to ``rr(query_id, id, file_name, score, keyword_matches)``."""
    return f"""
 xq AS MATERIALIZED (SELECT query_id, variant, v FROM ({EXPAND_SQL})),
 vq AS (SELECT query_id, 0 AS variant, text AS v FROM q UNION ALL SELECT * FROM xq),
 tq AS MATERIALIZED (SELECT query_id, list_distinct(flatten(list(ts))) AS terms FROM (SELECT query_id, {_TERMS} AS ts FROM vq) GROUP BY query_id),
 pq AS MATERIALIZED (SELECT query_id, p, min(o) AS o FROM (SELECT query_id, unnest(ps) AS p, variant * 10 + unnest(range(1, 4)) AS o FROM (
     SELECT query_id, variant, [CASE WHEN len(ws) >= 2 THEN array_to_string(ws[1:2], ' ') END, CASE WHEN len(ws) >= 2 THEN array_to_string(ws[1:3], ' ') END, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[1:4], ' ') END] AS ps
     FROM (SELECT query_id, variant, {_OPEN} AS ws FROM vq))) WHERE p IS NOT NULL GROUP BY query_id, p),
 r0 AS MATERIALIZED (SELECT c.query_id, c.id, c.score AS original_score, d.file_name, d.text, d.k, lower(d.text) AS low FROM ({cand}) c JOIN d USING (id)),
 r1 AS MATERIALIZED (SELECT r0.*, len(list_filter(tq.terms, lambda x: contains(low, x))) AS keyword_matches,
    (SELECT arg_min(pq.p, pq.o) FROM pq WHERE pq.query_id = r0.query_id AND contains(r0.low, pq.p)) AS phrase FROM r0 JOIN tq USING (query_id)),
 r2 AS (SELECT *, substring(low, greatest(strpos(low, phrase) - 1 - 50, 0) + 1, strpos(low, phrase) - 1 - greatest(strpos(low, phrase) - 1 - 50, 0) + length(phrase) + 50) AS ctx FROM r1),
 r3 AS (SELECT *, round(least(original_score + least(keyword_matches * 0.1::DOUBLE, 0.3) + CASE WHEN {_CUE} THEN 0.2 ELSE 0.0 END
    + CASE WHEN phrase IS NULL THEN 0.0 WHEN {_NEAR} THEN 0.4 ELSE 0.3 END, 1.0)::DOUBLE, 6) AS score FROM r2),
 rr AS MATERIALIZED (SELECT query_id, id, file_name, score, original_score, keyword_matches FROM r3 QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, id) = 1)"""


@query("f17_keyword_boost", f"""WITH {BASE}, {rerank_sql('SELECT query_id, id, score - 0.5 AS score FROM sem WHERE rk <= 20')}
SELECT query_id, id, score, keyword_matches FROM rr""")
def _(t):
    c, q = corpus(t), queries(t)
    found = plan.candidates(c, q, 20).withColumn("score", F.round(F.col("score") - 0.5, 6))
    return rerank.keyword_boost(found, rerank.query_features(q)).select("query_id", "id", "score", F.col("keyword_matches").cast("long").alias("keyword_matches"))


# Vectors of the phrasings: the embedding function is applied to each.
_MORE = f"""xe AS MATERIALIZED ({s.embedding_cells('xk', 'xk', 'v')}),
 xdot AS (SELECT xk, id, sum(de.v * xe.v) AS c FROM de JOIN xe USING (d) GROUP BY ALL),
 xs AS MATERIALIZED (SELECT xk // 100 AS query_id, id, round(coalesce(c, 0), 6) + 0.0 AS score FROM (SELECT xk.xk, d.id FROM xk, d) z LEFT JOIN xdot USING (xk, id)
    QUALIFY row_number() OVER (PARTITION BY xk ORDER BY round(coalesce(c, 0), 6) DESC, id) <= {K})"""
_XK = f"xk AS MATERIALIZED (SELECT query_id * 100 + variant AS xk, v FROM ({EXPAND_SQL}) WHERE variant >= 2)"


def phrasings(q):
    rows = unfold(q, ["query_id"], F.filter(expand_query(F.col("text")), lambda v, i: i > 0), "v", "variant")
    return rows.select("query_id", "variant", embed_udf(hashing_embed)(F.col("v")).alias("vec"))


@query("f27_retrieve", f"""
WITH {BASE}, {_XK}, {_MORE}, {rerank_sql(f'SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM sem WHERE rk <= {2 * K} UNION ALL SELECT query_id, id, score FROM xs) GROUP BY ALL')},
 m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rr)
SELECT query_id, id, score, rank, mx < 0.95 AS low_confidence FROM m WHERE ((mx >= 0.95 AND score >= 0.95) OR (mx < 0.95 AND rank <= 3)) AND rank <= {K}""")
def _(t):
    c, q = corpus(t), queries(t)
    rows = plan.retrieve(c, q, plan.SearchConfig(k=K, threshold=0.95), more=phrasings(q))
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


# Each document offers its best six chunks, of equal texts the one with the smallest id.
HIER = f"""ft AS MATERIALIZED (SELECT id, file_name FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1),
 near AS MATERIALIZED (SELECT query_id, id, score FROM sem JOIN ft USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, file_name ORDER BY rk) <= 6),{rerank_sql('SELECT query_id, id, score FROM near')},
 ds AS (SELECT query_id, file_name, max(score) AS document_score FROM rr GROUP BY query_id, file_name QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, file_name) <= 3),
 dc AS (SELECT rr.*, ds.document_score FROM rr JOIN ds USING (query_id, file_name) QUALIFY row_number() OVER (PARTITION BY query_id, file_name ORDER BY score DESC, id) <= 2),
 dk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dc QUALIFY rank <= 6)"""


@query("f28_hierarchical", f"WITH {BASE}, {HIER} SELECT query_id, id, file_name, score, document_score, rank FROM dk WHERE score >= 0.3 OR rank <= 3")
def _(t):
    c, q = corpus(t), queries(t)
    rows = plan.retrieve_hierarchical(c, q, plan.SearchConfig(k=6, documents=3, threshold=0.0))
    return rows.filter((F.col("score") >= 0.3) | (F.col("rank") <= 3)).select("query_id", "id", "file_name", "score", "document_score", F.col("rank").cast("long").alias("rank"))


@query("h17_envelope", f"""WITH {BASE}, {rerank_sql('SELECT query_id, id, score FROM sem WHERE rk <= 20')}
SELECT query_id, count(*) AS total_results, count(DISTINCT file_name) AS document_count, max(score) AS max_score, count(*) FILTER (score >= 0.9) AS filtered_count,
 CASE WHEN count(*) FILTER (score >= 0.9) > 0 THEN 'success' ELSE 'no_results' END AS status FROM rr GROUP BY query_id""")
def _(t):
    c, q = corpus(t), queries(t)
    found = staged(rerank.keyword_boost(plan.candidates(c, q, 20), rerank.query_features(q)))
    return plan.envelope(found.filter(F.col("score") >= 0.9), found).select("query_id", "total_results", "document_count", "max_score", "filtered_count", "status")


@query("d30_context", f"""WITH {BASE} SELECT query_id, string_agg(substring(text, 1, 250), chr(10) || chr(10) ORDER BY rk) AS context FROM sem JOIN d USING (id) WHERE rk <= 3 GROUP BY query_id""")
def _(t):
    c, q = corpus(t), queries(t)
    top = vector.top(c.select("id", "vec"), q.select("query_id", "vec"), 3)
    return plan.context(top.join(c.select("id", "text"), "id"), 3, 250)


@query("f29_synthesis", f"""WITH {BASE}, u AS (SELECT query_id, id, score FROM sem WHERE rk <= {K} UNION ALL SELECT query_id + 1, id, score FROM sem WHERE rk <= {K} AND query_id + 1 IN (SELECT query_id FROM q)),
 v AS (SELECT query_id, id, arg_max(score, o) AS score FROM (SELECT query_id, id, score, 0 AS o FROM sem WHERE rk <= {K} UNION ALL SELECT query_id + 1, id, score, 1 FROM sem WHERE rk <= {K} AND query_id + 1 IN (SELECT query_id FROM q)) GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v""")
def _(t):
    c, q = corpus(t), queries(t)
    one = staged(vector.top(c.select("id", "vec"), q.select("query_id", "vec"), K))
    # The second round asks each query what the one before it asked.
    two = one.withColumn("query_id", F.col("query_id") + 1).join(q.select("query_id"), "query_id", "left_semi")
    rows = plan.synthesis([one, two.select(*one.columns)])
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("l6_evaluation", f"""WITH {BASE}, rel AS (SELECT DISTINCT doc_id AS id, 1 AS r FROM labels WHERE quality = 1)
SELECT query_id, max(coalesce(r, 0)) AS hit, round(coalesce(max(CASE WHEN r = 1 THEN 1.0::DOUBLE / rk END), 0.0), 6) AS reciprocal_rank, round(sum(coalesce(r, 0)) / 10.0, 6)::DOUBLE AS precision
FROM sem LEFT JOIN rel USING (id) WHERE rk <= 10 GROUP BY query_id""")
def _(t):
    c, q = corpus(t), queries(t)
    top = vector.top(c.select("id", "vec"), q.select("query_id", "vec"), 10)
    good = t.labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return evaluate.retrieval_metrics(top, good, 10)


@query("f26_facade", f"""
WITH {BASE}, {s.bm25('d', 'q', 1, _blank)}, {_PHRASES}, {_HASHES},
 u AS (SELECT query_id, id, {0.35 / (0.35 + 0.25)}::DOUBLE / (60 + r) AS p, 'bm25' AS m FROM {distinct_list('b_rank', 'rk', 2 * K)}
   UNION ALL SELECT query_id, id, {0.25 / (0.35 + 0.25)}::DOUBLE / (60 + r), 'ngram' FROM {distinct_list('ph', 'score DESC, id', 2 * K)}),
 f AS (SELECT query_id, id, round(sum(p), 9) AS score, CASE WHEN count(*) = 1 THEN min(m) ELSE 'hybrid' END AS retrieval_method FROM u GROUP BY query_id, id),
 f3 AS (SELECT f.*, d.text, q.text AS qtext FROM f JOIN d USING (id) JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * K}),
 fin AS (SELECT *, round(score * boost::DOUBLE, 9) AS final_score FROM ({boost_sql('SELECT * FROM f3')}))
SELECT query_id, id::VARCHAR AS id, md5(text) AS content, score AS base, final_score AS final, kind AS clause_type, section_id, round(party, 6) AS party_relevance, oblig AS is_obligation, retrieval_method,
  row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM fin QUALIFY rank <= {K}""")
def _(t):
    rows = plan.nested(plan.advanced(corpus(t), queries(t), plan.SearchConfig(k=K, methods=["bm25", "ngram"])))
    return rows.select("query_id", "id", F.md5("content").alias("content"), "scores.base", "scores.final", "legal_context.clause_type", "legal_context.section_id",
                       "legal_context.party_relevance", "legal_context.is_obligation", "retrieval_method", F.col("rank").cast("long").alias("rank"))


@query("f27_lexical", f"""
WITH {BASE}, {lexical_sql(True)},
 m AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS mx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex)
SELECT query_id, id, score, rank, mx < 0.5 AS low_confidence FROM m WHERE ((mx >= 0.5 AND score >= 0.5) OR (mx < 0.5 AND rank <= 3)) AND rank <= {K}""")
def _(t):
    rows = plan.retrieve(corpus(t), queries(t), plan.SearchConfig(k=K, threshold=0.5, search_type="lexical"))
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


@query("f27_hybrid", f"""
WITH {BASE}, {UNIQUE}, {lexical_sql(True)},
 lu AS (SELECT lex.* FROM lex JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, d.k ORDER BY score DESC, id) = 1),
 l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM lu QUALIFY r <= {4 * K}),
 s AS (SELECT query_id, id, r FROM su WHERE r <= {4 * K}),
 fu AS (SELECT query_id, id, round(coalesce(1.0 / (60 + s.r), 0)::DOUBLE + coalesce(1.0 / (60 + l.r), 0)::DOUBLE, 9) AS score FROM s FULL JOIN l USING (query_id, id)),
 fd AS (SELECT fu.* FROM fu JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, d.k ORDER BY score DESC, id) = 1),
 hy AS MATERIALIZED (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * K}),
 {rerank_sql('SELECT query_id, id, score FROM hy')},
 m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rr)
SELECT query_id, id, score, rank, mx < 0.5 AS low_confidence FROM m WHERE ((mx >= 0.5 AND score >= 0.5) OR (mx < 0.5 AND rank <= 3)) AND rank <= {K}""")
def _(t):
    rows = plan.retrieve(corpus(t, text_key=plan.text_key()), queries(t), plan.SearchConfig(k=K, threshold=0.5, search_type="hybrid"))
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


@query("k5_token_f1", f"""
WITH p AS (SELECT conv_id, turn, text AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations),
 t AS (SELECT conv_id, turn, unnest({s.tokens('a')}) AS token, 1 AS x, 0 AS y FROM p UNION ALL SELECT conv_id, turn, unnest({s.tokens('b')}), 0, 1 FROM p),
 c AS (SELECT conv_id, turn, token, sum(x) AS x, sum(y) AS y FROM t GROUP BY ALL),
 f AS (SELECT conv_id, turn, round(2.0 * sum(least(x, y))::DOUBLE / sum(x + y)::DOUBLE, 6) AS f1 FROM c GROUP BY ALL)
SELECT p.conv_id, p.turn, coalesce(f1, 0.0) AS f1 FROM p LEFT JOIN f USING (conv_id, turn)""")
def _(t):
    answer = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return evaluate.token_f1(t.conversations.withColumn("answer", answer), "text", "answer", ["conv_id", "turn"])


