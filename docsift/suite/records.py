"""Web results, papers and references."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import web
from ..functions.text import word_tokens
from ..functions.vectors import cosine, embed_udf, hashing_embed
from ..operators import bm25, filters, meta, papers as ranking_papers, references, rerank
from ..operators.layout import spread
from ..operators.numbering import staged
from ..operators.ranking import keep_first
from ..plans import cache
from ..session import ensure_checkpoint_dir
from ..sources import web as pages
from . import sqlbits as s
from .registry import query
from .texts import AUTHOR_YEAR_SQL, CITE_NUM_SQL, CITED_SQL, _AY, cited
from .views import PAPERS_SQL, papers, text_queries

_TITLE = s.strip("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')")
_SNIP = s.strip("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', '', 'g')")
RAW_SQL = f"SELECT page_id AS id, url, {_TITLE} AS title, {_SNIP} AS snippet FROM pages"
_HOST = "split_part(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), ':', 1)"
WHOLE_SQL = f"""SELECT id, CASE WHEN title = '' THEN url ELSE title END AS title, url, snippet, {_HOST} AS domain FROM ({RAW_SQL}) WHERE title <> '' OR (url <> '' AND snippet <> '')"""
RESULT_SQL = f"""SELECT id, CASE WHEN title = '' THEN url ELSE title END AS title, url, CASE WHEN length(snippet) > 500 THEN substring(snippet, 1, 500) || '...' ELSE snippet END AS snippet,
  {_HOST} AS domain FROM ({RAW_SQL}) WHERE title <> '' OR (url <> '' AND snippet <> '')"""


def raw(t):
    return pages.from_pages(spread(t.pages, "page_id"))


def results(t):
    return pages.normalised(raw(t), 500)


@query("a12_page_results", RAW_SQL)
def _(t):
    return raw(t)


@query("a12_unwrap_redirect", "SELECT page_id, url AS target FROM pages")
def _(t):
    enc = F.url_encode("url")
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//duckduckgo.com/l/?kh=-1&uddg="), enc, F.lit("&rut=1"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.google.com/url?q="), enc, F.lit("&sa=U"))).otherwise(F.col("url"))
    return t.pages.select("page_id", web.unwrap_redirect(link).alias("target"))


@query("a13_normalised_results", f"SELECT id, title, url, snippet, domain, domain AS publication, 'web' AS source, 'web_search' AS source_type FROM ({RESULT_SQL})")
def _(t):
    return results(t).select("id", "title", "url", "snippet", "domain", "publication", "source", "source_type")


_DOM = "CASE id % 6 WHEN 0 THEN 'uk.linkedin.com' WHEN 1 THEN 'arxiv.org' WHEN 2 THEN 'bbc.com' WHEN 3 THEN 'x.org/a.pdf' ELSE domain END"


@query("d19_source_class", f"""
SELECT id, CASE WHEN contains(m, 'linkedin.com') THEN 'LinkedIn' WHEN contains(m, 'researchgate.net') OR contains(m, 'sciencedirect.com') OR contains(m, 'arxiv.org') THEN 'Academic'
  WHEN contains(m, 'bbc.com') OR contains(m, 'cnn.com') OR contains(m, 'reuters.com') OR contains(m, 'nytimes.com') THEN 'News' WHEN ends_with(m, '.pdf') THEN 'PDF/Paper' ELSE 'Web' END AS source
FROM (SELECT id, {_DOM} AS m FROM ({RESULT_SQL}))""")
def _(t):
    i = F.col("id") % 6
    m = F.when(i == 0, "uk.linkedin.com").when(i == 1, "arxiv.org").when(i == 2, "bbc.com").when(i == 3, "x.org/a.pdf").otherwise(F.col("domain"))
    return results(t).select("id", web.source_class(m).alias("source"))


@query("e7_web_quality", f"SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN 'http://spam.com/x' ELSE url END AS url, CASE WHEN id % 3 = 0 THEN 'short' ELSE snippet END AS snippet FROM ({RESULT_SQL})) WHERE url <> '' AND title <> '' AND NOT contains(url, 'spam.com') AND (snippet = '' OR length(snippet) >= 20)")
def _(t):
    i = F.col("id")
    rows = results(t).select(
        "id", F.when(i % 7 == 0, "").otherwise(F.col("title")).alias("title"), F.when(i % 5 == 0, "http://spam.com/x").otherwise(F.col("url")).alias("url"),
        F.when(i % 3 == 0, "short").otherwise(F.col("snippet")).alias("snippet"))
    return rows.filter(filters.web_quality()).select("id")


@query("d29_reference_lines", f"""
SELECT id, '[' || id || '] **' || title || '**' || chr(10) || '  URL: ' || url || CASE WHEN domain <> '' THEN chr(10) || '  Publication: ' || domain ELSE '' END
 || CASE WHEN snippet <> '' THEN chr(10) || '  Summary: ' || CASE WHEN length(snippet) > 200 THEN substring(snippet, 1, 200) || '...' ELSE snippet END ELSE '' END AS line FROM ({RESULT_SQL})""")
def _(t):
    c = [F.col(x) for x in ("id", "title", "url", "publication", "snippet")]
    return results(t).select("id", web.reference_line(*c).alias("line"))


_WEB = f"""r AS MATERIALIZED ({WHOLE_SQL}), w AS MATERIALIZED (SELECT id, {s.strip("title || '. ' || snippet")} AS text, url, domain FROM r), q AS (SELECT item_id AS query_id, text FROM benchmark),
 {s.bm25('w', 'q')}, we AS MATERIALIZED ({s.embedding_cells('w', 'id')}), qe AS MATERIALIZED ({s.embedding_cells('q', 'query_id')}),
 cs AS (SELECT query_id, id, sum(we.v * qe.v) AS c FROM we JOIN qe USING (d) GROUP BY ALL),
 x AS MATERIALIZED (SELECT f.query_id, f.id, f.by_max AS bm25, round(coalesce(cs.c, 0), 6) + 0.0 AS cosine FROM b_rank f LEFT JOIN cs USING (query_id, id))"""


def web_search(t, *keep):
    """Results with text and vector, and the queries with theirs; result lists are what one search returned."""
    embed = embed_udf(hashing_embed)
    texts = staged(pages.result_text(pages.normalised(raw(t)), *keep).withColumn("vec", embed(F.col("text"))))
    return texts, text_queries(t).withColumn("vec", embed(F.col("text")))


@query("f18_web_rerank", f"WITH {_WEB} SELECT query_id, id, round(bm25 * 0.4::DOUBLE + (cosine + 1) / 2 * 0.6::DOUBLE, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25 * 0.4::DOUBLE + (cosine + 1) / 2 * 0.6::DOUBLE, 9) DESC, id) AS rank FROM x QUALIFY rank <= 10")
def _(t):
    rows = meta.by_both(*web_search(t), 10)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# Half of the queries are asked before, and then all of them.
@query("f20_cached_search", f"""
WITH {_WEB}, c AS (SELECT x.*, f.rk FROM x JOIN b_rank f USING (query_id, id) WHERE f.rk <= 30),
 y AS (SELECT query_id, id, round(bm25 * 0.4::DOUBLE + (cosine + 1) / 2 * 0.6::DOUBLE, 9) AS score FROM c)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, query_id % 2 = 0 AS cached FROM y QUALIFY rank <= 10""")
def _(t):
    texts = staged(pages.result_text(pages.normalised(raw(t))).select("id", "text"))
    embed, asked = embed_udf(hashing_embed), text_queries(t)
    vectors = staged(texts.select("id", embed(F.col("text")).alias("vec")))

    def engine(queries, n):
        return bm25.top(texts, queries, n, word_tokens, norm="max").select("query_id", "id", "score")

    def again(found, queries):
        asked = queries.select("query_id", embed(F.col("text")).alias("_q"))
        rows = found.withColumnRenamed("score", "bm25").join(vectors, "id").join(asked, "query_id")
        near = F.coalesce(F.round(cosine(F.col("vec"), F.col("_q")), 6), F.lit(0.0))
        return rerank.weighted_web(rows.withColumn("cosine", near)).select("query_id", "id", "score")

    path = f"{ensure_checkpoint_dir(texts.sparkSession)}/searches-{uuid.uuid4().hex}"
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    run = lambda queries, now: cache.cached_search(queries, engine, path, 10, "pages", "weighted", now, again)
    run(asked.filter(F.col("query_id") % 2 == 0), now).count()
    rows = run(asked, now + F.expr("INTERVAL 1 HOUR"))
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "cached")


@query("f19_meta_rrf", f"""
WITH {_WEB}, y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS b FROM x),
 z AS (SELECT query_id, url, round(sum(1.0 / (60 + a)::DOUBLE + 1.0 / (60 + b)::DOUBLE), 9) AS score FROM y JOIN r USING (id) GROUP BY query_id, url)
SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM z QUALIFY rank <= 10""")
def _(t):
    return meta.by_places(*web_search(t, "url"), 10).withColumn("rank", F.col("rank").cast("long"))


@query("f19_meta_bm25", f"WITH {_WEB} SELECT f.query_id, f.id, r.url, f.by_max AS score, f.rk AS rank FROM b_rank f JOIN r USING (id) WHERE f.rk <= 10")
def _(t):
    return with_url(meta.by_words(*web_search(t), 10), t)


@query("f19_meta_embedding", f"WITH {_WEB} SELECT query_id, id, url, cosine AS score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM x JOIN r USING (id) QUALIFY rank <= 10")
def _(t):
    return with_url(meta.by_meaning(*web_search(t), 10), t)


@query("f19_meta_weighted", f"""
WITH {_WEB}, y AS (SELECT query_id, id, bm25, (cosine + 1) / 2 AS near, round(bm25 * 0.4::DOUBLE + (cosine + 1) / 2 * 0.6::DOUBLE, 9) AS score FROM x)
SELECT query_id, id, url, score, bm25 AS bm25_score, round(near, 7) AS embedding_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM y JOIN r USING (id) QUALIFY rank <= 10""")
def _(t):
    return with_url(meta.by_both(*web_search(t), 10), t).withColumn("embedding_score", F.round("embedding_score", 7))


def with_url(rows, t):
    return rows.withColumn("rank", F.col("rank").cast("long")).join(results(t).select("id", "url"), "id")


@query("i16_distinct_urls", f"SELECT id, url FROM ({RESULT_SQL}) QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY id) = 1")
def _(t):
    return keep_first(results(t).withColumn("_k", F.lower("url")), ["_k"], [F.col("id")]).select("id", "url")


# ---- papers --------------------------------------------------------------------

_TOPIC = "the data that and the systems"
_TW = "['the', 'data', 'that', 'and', 'systems']"
_SCORE = f"""round(CASE WHEN year IS NULL THEN 0.0 WHEN year < 2020 THEN -0.2 ELSE greatest(0.0, 1.0 - (2025 - year) / 10.0) * 0.4 END::DOUBLE
  + CASE WHEN citation_count > 0 THEN least(1.0, log10(citation_count + 1) / 3.0) * 0.2 ELSE 0.0 END
  + (len(list_intersect({_TW}, {s.words('lower(title)')})) / 5.0::DOUBLE * 0.6 + len(list_intersect({_TW}, {s.words('lower(abstract)')})) / 5.0::DOUBLE * 0.4) * 0.4
  + CASE WHEN lower(venue) LIKE '%neurips%' OR lower(venue) LIKE '%acl%' THEN 0.1 ELSE 0.0 END, 6)"""


@query("f30_paper_score", f"SELECT id, {_SCORE} AS score FROM ({PAPERS_SQL})")
def _(t):
    return papers(t).select("id", ranking_papers.paper_score(F.lit(_TOPIC), 2025).alias("score"))


def both_sources(t):
    """Two sources that cover all papers: English ones, and the others (those of no language, too)."""
    p, english = papers(t), F.col("lang").eqNullSafe("en")
    return [p.filter(english), p.filter(~english)]


@query("f31_paper_search", f"""
WITH u AS (SELECT * FROM ({PAPERS_SQL}) QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, id) = 1)
SELECT id, title, {_SCORE} AS score FROM u ORDER BY score DESC, id LIMIT 40""")
def _(t):
    rows = ranking_papers.merge_sources(both_sources(t), "title")
    rows = rows.withColumn("score", ranking_papers.paper_score(F.lit(_TOPIC), 2025))
    return rows.orderBy(F.desc("score"), "id").limit(40).select("id", "title", "score")


@query("f32_merge_by_title", f"""
SELECT id, CASE WHEN year >= 2023 THEN 'Recent' ELSE 'Foundational' END AS era FROM ({PAPERS_SQL}) QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, id) = 1""")
def _(t):
    rows = ranking_papers.merge_sources(both_sources(t), "title")
    return rows.select("id", ranking_papers.era(2024).alias("era"))


@query("e9_year_window", f"SELECT id FROM ({PAPERS_SQL}) WHERE year IS NULL OR year <= 2018")
def _(t):
    return papers(t).filter(filters.up_to_year(2018)).select("id")


# ---- references ----------------------------------------------------------------

REFS_SQL = "SELECT item_id + 1 AS ordinal, substring(text, 1, 30) AS title, CASE item_id % 4 WHEN 0 THEN 'Kim, Lee' WHEN 1 THEN 'src' || (item_id % 20) || ' team' WHEN 2 THEN 'Li' ELSE 'Etter' END AS author, (2015 + item_id % 10)::VARCHAR AS date FROM benchmark"


def refs(t):
    i = F.col("item_id")
    author = F.when(i % 4 == 0, "Kim, Lee").when(i % 4 == 1, F.concat(F.lit("src"), i % 20, F.lit(" team"))).when(i % 4 == 2, "Li").otherwise("Etter")
    return t.benchmark.select((i + 1).alias("ordinal"), F.substring("text", 1, 30).alias("title"), author.alias("author"), (F.lit(2015).cast("long") + i % 10).cast("string").alias("date"))


@query("f33_numeric_references", f"WITH r AS ({REFS_SQL}) SELECT c.doc_id, r.ordinal, r.title FROM (SELECT doc_id, unnest({CITE_NUM_SQL}) AS ordinal FROM ({CITED_SQL})) c JOIN r USING (ordinal)")
def _(t):
    return references.resolve_numeric(cited(t), refs(t)).select("doc_id", "ordinal", "title")


@query("f33_author_references", f"""
WITH r AS ({REFS_SQL}), c AS ({AUTHOR_YEAR_SQL}),
 m AS (SELECT c.author, c.year, min(r.ordinal) AS ordinal FROM (SELECT DISTINCT author, year FROM c) c JOIN r ON
   (contains(lower(r.author), lower(c.author)) OR contains(lower(c.author), lower(r.author)) OR len(list_filter({s.words('c.author')}, lambda w: length(w) > 3 AND contains(lower(r.author), lower(w)))) > 0)
   AND (contains(r.date, c.year) OR contains(c.year, r.date) OR r.date = '') GROUP BY ALL)
SELECT c.doc_id, c.author, c.year, coalesce(m.ordinal, -1) AS ordinal, coalesce(r.title, 'Research paper by ' || c.author) AS title, CASE WHEN m.ordinal IS NULL THEN 'placeholder' ELSE 'reference' END AS source_type
FROM c LEFT JOIN m USING (author, year) LEFT JOIN r ON r.ordinal = m.ordinal""")
def _(t):
    rows = references.resolve_author_year(cited(t), refs(t))
    return rows.withColumn("ordinal", F.coalesce("ordinal", F.lit(-1).cast("long")))


# Every tenth document has lost its citations and uses the whole list.
_SOME = "CASE WHEN doc_id % 10 = 3 THEN regexp_replace(text, '\\[[^\\]]*\\]', '', 'g') ELSE text END"


@query("f33_used_references", f"""
WITH r AS MATERIALIZED ({REFS_SQL}), t AS MATERIALIZED (SELECT doc_id, {_SOME} AS text FROM ({CITED_SQL})),
 n AS (SELECT doc_id, unnest({CITE_NUM_SQL}) AS ordinal FROM t),
 l AS (SELECT doc_id, regexp_extract_all(text, '{_AY}', 1) AS a, regexp_extract_all(text, '{_AY}', 2) AS y FROM t),
 c AS MATERIALIZED (SELECT doc_id, generate_subscripts(a, 1) AS nth, {s.strip('unnest(a)')} AS author, unnest(y) AS year FROM l),
 m AS (SELECT c.author, c.year, min(r.ordinal) AS ordinal FROM (SELECT DISTINCT author, year FROM c) c JOIN r ON
   (contains(lower(r.author), lower(c.author)) OR contains(lower(c.author), lower(r.author)) OR len(list_filter({s.words('c.author')}, lambda w: length(w) > 3 AND contains(lower(r.author), lower(w)))) > 0)
   AND (contains(r.date, c.year) OR contains(c.year, r.date) OR r.date = '') GROUP BY ALL),
 u AS (SELECT doc_id, 0 AS part, ordinal AS nth, ordinal, title, author, date, 'reference' AS source_type FROM n JOIN r USING (ordinal)
   UNION ALL SELECT c.doc_id, 1, c.nth, m.ordinal, CASE WHEN m.ordinal IS NULL THEN 'Research paper by ' || c.author ELSE r.title END, CASE WHEN m.ordinal IS NULL THEN c.author ELSE r.author END,
     CASE WHEN m.ordinal IS NULL THEN c.year ELSE r.date END, CASE WHEN m.ordinal IS NULL THEN 'placeholder' ELSE 'reference' END FROM c LEFT JOIN m USING (author, year) LEFT JOIN r ON r.ordinal = m.ordinal),
 d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title), lower(author) ORDER BY part, nth) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, nth) AS place, coalesce(ordinal, -1) AS ordinal, title, author, date, source_type FROM d
UNION ALL SELECT doc_id, 0, -1, NULL, NULL, NULL, 'all references' FROM t WHERE doc_id NOT IN (SELECT doc_id FROM n) AND doc_id NOT IN (SELECT doc_id FROM c)""")
def _(t):
    text = F.when(F.col("doc_id") % 10 == 3, F.regexp_replace("text", r"\[[^\]]*\]", "")).otherwise(F.col("text"))
    rows = references.used_references(cited(t).withColumn("text", text), refs(t))
    return rows.withColumns({"place": F.col("place").cast("long"), "ordinal": F.coalesce("ordinal", F.lit(-1).cast("long"))})


@query("a17_relation_links", """
SELECT conv_id, role AS source, 'place ' || (turn % 3) AS target, unnest([turn, turn + 1]) AS chunk FROM conversations""")
def _(t):
    from ..sources.artifacts import relation_links

    key = F.concat("role", F.lit("<SEP>place "), F.col("turn") % 3)
    rows = t.conversations.select("conv_id", key.alias("key"), F.array("turn", F.col("turn") + 1).alias("chunk_ids"))
    return relation_links(rows, "conv_id").withColumnRenamed("chunk_id", "chunk")
