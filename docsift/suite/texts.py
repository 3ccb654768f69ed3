"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, ids, legal, responses, text, tokens, web
from ..operators import filters
from ..operators.layout import spread, unfold
from ..sources import transcripts
from . import sqlbits as s
from .registry import query
from .views import LEGAL_SQL, PAPERS_SQL, legal_texts, papers

WS = s.WS


def docs(t):
    return spread(t.documents, "doc_id")


# ---- sentences, words, mark-up -------------------------------------------------

@query("c1_sentences_keep", f"""
SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS joined FROM (SELECT doc_id, {s.sentences_keep('text')} AS l FROM documents)""")
def _(t):
    l = text.sentences_keep(F.col("text"))
    return docs(t).select("doc_id", l.alias("l")).select(
        "doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("joined"))


@query("c2_sentences_drop", f"""
SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS joined FROM (SELECT doc_id, {s.sentences_drop('text')} AS l FROM documents)""")
def _(t):
    return docs(t).select("doc_id", text.sentences_drop(F.col("text")).alias("l")).select(
        "doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("joined"))


@query("c3_word_counts", f"""
SELECT doc_id, len(regexp_extract_all(text, '{s.WORD}')) AS token_words, len({s.words('text')}) AS blank_words FROM documents""")
def _(t):
    c = F.col("text")
    return docs(t).select(
        "doc_id", text.count_word_tokens(c).cast("long").alias("token_words"),
        text.count_words(c).cast("long").alias("blank_words"))


_MD_NUM = rf"^(\d+(?:\.\d+)*)\.{WS}+(.+)$"
_MD_LINE = f"""CASE WHEN l = '' OR length(l) >= 100 OR regexp_matches(l, '[.!?:;]$') THEN l
  WHEN regexp_matches(l, '{_MD_NUM}') THEN
    CASE WHEN contains(regexp_extract(l, '{_MD_NUM}', 1), '.') THEN '## ' ELSE '# ' END || {s.strip(f"regexp_extract(l, '{_MD_NUM}', 2)")}
  WHEN len({s.words('l')}) <= 10 THEN '## ' || l ELSE l END"""
_MD = f"""list_transform(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'),
  ' {{2,}}', ' ', 'g'), ' *\\n *', chr(10), 'g'), chr(10)), lambda l: {s.strip('l')}), lambda l: {_MD_LINE})"""


@query("d1_text_to_markdown", f"""
SELECT doc_id, {s.strip(f"regexp_replace(array_to_string({_MD}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS md FROM ({LEGAL_SQL})""")
def _(t):
    return legal_texts(t).select("doc_id", text.to_markdown(F.col("text")).alias("md"))


@query("d2_preprocess", f"""
SELECT doc_id, {s.strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^{WS}*[0-9]{{1,3}}{WS}*$', '', 'g'), '(?i)Page{WS}+[0-9]+(?:{WS}+of{WS}+[0-9]+)?', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")} AS clean
FROM (SELECT doc_id, text || chr(10) || (doc_id % 1000) || chr(10) || 'Page ' || doc_id || ' of 9' AS x FROM documents)""")
def _(t):
    tail = F.concat(F.col("text"), F.lit("\n"), F.col("doc_id") % 1000, F.lit("\nPage "), F.col("doc_id"), F.lit(" of 9"))
    return docs(t).select("doc_id", text.preprocess(tail).alias("clean"))


@query("d8_dedup_key", f"SELECT doc_id, md5({s.dedup_key('text')}) AS k, length({s.dedup_key('text')}) AS n FROM documents")
def _(t):
    k = text.dedup_key(F.col("text"))
    return docs(t).select("doc_id", F.md5(k).alias("k"), F.length(k).cast("long").alias("n"))


@query("d9_content_hash", f"SELECT doc_id, md5(lower({s.strip('text')})) AS h FROM documents")
def _(t):
    return docs(t).select("doc_id", text.content_hash(F.col("text")).alias("h"))


@query("d25_topic_slug", f"""
SELECT doc_id, CASE WHEN x = '' THEN 'research_overview' ELSE lower(substring(x, 1, 100)) END AS slug FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}-]', '', 'g'), '{WS}+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM documents)""")
def _(t):
    return docs(t).select("doc_id", text.slug(F.col("text")).alias("slug"))


_HTML = "x"
for _p, _r in [
    ("(?m)^# (.+)$", "<h1>\\1</h1>"), ("(?m)^## (.+)$", "<h2>\\1</h2>"), ("(?m)^### (.+)$", "<h3>\\1</h3>"),
    ("\\*\\*(.+?)\\*\\*", "<strong>\\1</strong>"), ("\\*(.+?)\\*", "<em>\\1</em>"),
    ("```([^`]+)```", "<pre><code>\\1</code></pre>"), ("`([^`]+)`", "<code>\\1</code>"),
    ("\\[([^\\]]+)\\]\\(([^\\)]+)\\)", '<a href="\\2">\\1</a>'),
]:
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', 'g')"


@query("d26_markdown_to_html", f"""
SELECT doc_id, array_to_string(list_transform(string_split({_HTML}, chr(10) || chr(10)), lambda p:
  CASE WHEN {s.strip('p')} <> '' AND NOT starts_with({s.strip('p')}, '<') THEN '<p>' || {s.strip('p')} || '</p>' ELSE p END), chr(10)) AS html
FROM (SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || '**' || source || '** in `' || lang || '` [src](http://x/' || doc_id || ')' || chr(10) || chr(10) || text AS x FROM documents)""")
def _(t):
    md = F.concat(F.lit("# Doc "), F.col("doc_id"), F.lit("\n\n**"), F.col("source"), F.lit("** in `"), F.col("lang"),
                  F.lit("` [src](http://x/"), F.col("doc_id"), F.lit(")\n\n"), F.col("text"))
    return docs(t).select("doc_id", text.markdown_to_html(md).alias("html"))


@query("d27_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def _(t):
    return spread(t.pages, "page_id").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


# The blocks carry markers per document so that both kinds of dropped header occur.
@query("d24_clean_sections", f"""
SELECT doc_id, '# T' || chr(10) || text || chr(10) || chr(10) || 'after' || chr(10) || '### Notes' || chr(10) || 'kept' AS cleaned FROM documents""")
def _(t):
    body = F.concat(
        F.lit("# T\n## Abstract again\n"), F.col("text"), F.lit("\n### Summary\ngone\nalso gone\n\nafter\n## Introduction\n### Notes\nkept"))
    return docs(t).select("doc_id", text.clean_section(body).alias("cleaned"))


# ---- tokens --------------------------------------------------------------------

def gram_list_sql(ws: str) -> str:
    """Count and digest of the n-grams of a document, by length and place."""
    leads = ", ".join(f"lead(w, {n}) OVER x AS w{n}" for n in range(1, 5))
    grams = ", ".join(" || ' ' || ".join(["w", *[f"w{i}" for i in range(1, n)]]) for n in range(1, 6))
    return f"""
SELECT d.doc_id, coalesce(g.n, 0) AS n, md5(coalesce(g.l, '')) AS h FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(gram, '|' ORDER BY k, p) AS l FROM (
    SELECT doc_id, p, unnest([{grams}]) AS gram, unnest(range(1, 6)) AS k FROM (
      SELECT doc_id, w, p, {leads} FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, {ws} AS ws FROM documents))
      WINDOW x AS (PARTITION BY doc_id ORDER BY p))) WHERE gram IS NOT NULL GROUP BY doc_id) g USING (doc_id)"""


@query("d4_word_ngrams", gram_list_sql(s.tokens("text")))
def _(t):
    return docs(t).select("doc_id", tokens.word_ngrams(F.col("text")).alias("g")).select(
        "doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("h"))


@query("d5_tokens", f"""
SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({s.tokens('text')}) AS token FROM documents) GROUP BY ALL""")
def _(t):
    return unfold(docs(t), ["lang"], text.word_tokens(F.col("text")), "token").groupBy("lang", "token").agg(F.count("*").alias("n"))


@query("d6_blank_ngrams", gram_list_sql(s.words("lower(text)")))
def _(t):
    return docs(t).select("doc_id", tokens.blank_ngrams(F.col("text")).alias("g")).select(
        "doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("h"))


SQL_STOP = ", ".join(f"'{w}'" for w in tokens.STOP_WORDS)
SQL_KEYWORDS = f"list_filter({s.tokens('text')}, lambda w: length(w) > 2 AND w NOT IN ({SQL_STOP}))"


@query("d10_keywords", f"SELECT doc_id, array_to_string({SQL_KEYWORDS}, ' ') AS keywords FROM documents")
def _(t):
    return docs(t).select("doc_id", F.array_join(tokens.keywords(F.col("text")), " ").alias("keywords"))


_PUNCT = r"[.,!?;:()\[\]{}]+"
SQL_QWORDS = ", ".join(f"'{w}'" for w in tokens.QUESTION_WORDS)
_MAIN = f"""array_to_string(list_filter(list_transform({s.words("translate(trim(lower(text)), '/-', '  ')")}, lambda w: regexp_replace(w, '^{_PUNCT}|{_PUNCT}$', '', 'g')),
   lambda w: length(w) > 2 AND w NOT IN ({SQL_QWORDS})), ' ')"""
EXPAND_SQL = f"""
  SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY i) AS variant FROM (
    SELECT query_id, i, v, row_number() OVER (PARTITION BY query_id, lower(trim(v)) ORDER BY i) AS rn FROM (
      SELECT query_id, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i FROM (
        SELECT query_id, CASE WHEN m = '' THEN [text] ELSE [text, m || ' is', m || ' is a', m || ' is an', m || ' refers to', m || ' definition',
               'definition of ' || m, m || ' problem', m || ' arises'] END AS vs
        FROM (SELECT query_id, text, {_MAIN} AS m FROM q)))
    WHERE length(lower(trim(v))) > 3) WHERE rn = 1"""


@query("d11_expand_query", f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark) SELECT query_id, variant, v FROM ({EXPAND_SQL})")
def _(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.posexplode(tokens.expand_query(F.col("text"))).alias("p", "v")).select(
        "query_id", (F.col("p") + 1).cast("long").alias("variant"), "v")


# ---- contract features ---------------------------------------------------------

_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(u, '{k}')" for k in keys) + f" THEN '{name}'" for name, _, keys in legal.CLAUSES)
CLAUSE_SQL = f"CASE {_CASE} ELSE 'GENERAL' END"
WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{n}' THEN {w}" for n, w, _ in legal.CLAUSES) + " ELSE 1.0 END"
SECTION_SQL = "regexp_extract(text, '(?m)^\\s*(\\d+\\.\\d*\\.?)\\s+([A-Z][^\\n]+)', 1)"
OBLIG_SQL = f"regexp_matches(text, '{legal.OBLIGATION}')"
CRIT_SQL = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in legal.CRITICAL_TERMS)
REF_SQL = "len(regexp_extract_all(text, '(?i)clause\\s+(\\d+\\.\\d*)'))"
PARTY_SQL = f"list_transform(regexp_extract_all(%s, '(?i)({legal.PARTY})'), lambda p: lower(p))"


def party_sql(query_expr: str) -> str:
    hits = f"len(list_filter({PARTY_SQL % 'text'}, lambda p: list_contains({PARTY_SQL % query_expr}, p)))"
    return f"round(1.0 + 0.3 * {hits}, 6)"


@query("d12_clause_type", f"SELECT doc_id, {CLAUSE_SQL} AS clause_type FROM (SELECT doc_id, upper(text) AS u FROM ({LEGAL_SQL}))")
def _(t):
    return legal_texts(t).select("doc_id", legal.clause_type(F.col("text")).alias("clause_type"))


@query("d13_section_id", f"SELECT doc_id, CASE WHEN x = '' THEN 'unknown' ELSE rtrim(x, '.') END AS section_id FROM (SELECT doc_id, {SECTION_SQL} AS x FROM ({LEGAL_SQL}))")
def _(t):
    return legal_texts(t).select("doc_id", legal.section_id(F.col("text")).alias("section_id"))


@query("d14_obligations", f"SELECT doc_id, {OBLIG_SQL} AS is_obligation FROM ({LEGAL_SQL})")
def _(t):
    return legal_texts(t).select("doc_id", legal.is_obligation(F.col("text")).alias("is_obligation"))


_ASK = "Client and Vendor obligations"


@query("d15_party_relevance", f"SELECT doc_id, {party_sql(repr(_ASK))} AS relevance FROM ({LEGAL_SQL})")
def _(t):
    return legal_texts(t).select("doc_id", F.round(legal.party_relevance(F.col("text"), F.lit(_ASK)), 6).alias("relevance"))


@query("d16_feature_counts", f"""
SELECT doc_id, CAST({CRIT_SQL} AS BIGINT) AS critical, len(regexp_extract_all(text, '(?i)"([^"]+)"\\s+means\\s+([^;]+);')) AS definitions, {REF_SQL} AS refs FROM ({LEGAL_SQL})""")
def _(t):
    c = F.col("text")
    return legal_texts(t).select(
        "doc_id", legal.critical_terms(c).cast("long").alias("critical"),
        legal.definition_count(c).cast("long").alias("definitions"), legal.reference_count(c).cast("long").alias("refs"))


_SEC = r"(?i)(?:Section|Sec\.?|§)\s+(\d+(?:\.\d+)*)"
_NUM = r"^(\d+(?:\.\d+)+)\s+[A-Z]"
_CHAP = r"(?i)Chapter\s+(\d+(?:\.\d+)*)"
HEADER_SQL = f"""SELECT *, CASE WHEN length(dotted) - length(replace(dotted, '.', '')) >= 2 THEN 'subsection'
     WHEN dotted IS NOT NULL OR chapter IS NOT NULL THEN 'section' END AS kind, coalesce(dotted, chapter) AS number
   FROM (SELECT *, coalesce(nullif(regexp_extract(text, '{_SEC}', 1), ''), nullif(regexp_extract(text, '{_NUM}', 1), '')) AS dotted,
                nullif(regexp_extract(text, '{_CHAP}', 1), '') AS chapter FROM p)"""

# Paragraph stream: the lines of a document under generated headings.
HEADED_SQL = """SELECT doc_id, i AS pos, CASE WHEN i % 6 = 0 THEN 'Section ' || (i // 6 + 1) || '.1 ' || l
   WHEN i % 6 = 2 THEN (i // 6 + 1) || '.1.' || (i % 5) || ' Details ' || l WHEN i % 6 = 5 THEN 'Chapter ' || i ELSE l END AS text
 FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def headed(t):
    i, l = F.col("pos"), F.col("l")
    block = F.floor(i / 6).cast("int") + 1
    line = (
        F.when(i % 6 == 0, F.concat(F.lit("Section "), block, F.lit(".1 "), l))
        .when(i % 6 == 2, F.concat(block.cast("string"), F.lit(".1."), i % 5, F.lit(" Details "), l))
        .when(i % 6 == 5, F.concat(F.lit("Chapter "), i)).otherwise(l))
    return unfold(docs(t), ["doc_id"], F.split("text", "\n"), "l", "pos").select(
        "doc_id", i.cast("long").alias("pos"), line.alias("text"))


@query("d17_section_header", f"WITH p AS ({HEADED_SQL}) SELECT doc_id, pos, kind, number FROM ({HEADER_SQL})")
def _(t):
    return headed(t).select("doc_id", "pos", transcripts.section_header(F.col("text")).alias("h")).select("doc_id", "pos", "h.kind", "h.number")


@query("d18_parent_section", f"""WITH p AS ({HEADED_SQL})
SELECT doc_id, pos, number, CASE WHEN kind = 'subsection' THEN nullif(regexp_replace(number, '\\.?[^.]*$', ''), '') ELSE number END AS section FROM ({HEADER_SQL}) WHERE kind IS NOT NULL""")
def _(t):
    h = headed(t).select("doc_id", "pos", transcripts.section_header(F.col("text")).alias("h")).filter(F.col("h.kind").isNotNull())
    n = F.col("h.number")
    return h.select("doc_id", "pos", n.alias("number"), F.when(F.col("h.kind") == "subsection", transcripts.parent_section(n)).otherwise(n).alias("section"))


@query("a5_carry_sections", f"""WITH p AS ({HEADED_SQL}), h AS ({HEADER_SQL}),
 g AS (SELECT *, sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h)
SELECT doc_id, pos, last_value(CASE WHEN kind = 'section' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section_number,
  last_value(CASE WHEN kind = 'subsection' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY pos) AS subsection_number,
  kind IS NOT NULL AS is_header FROM g""")
def _(t):
    return transcripts.carry_sections(headed(t)).select("doc_id", "pos", "section_number", "subsection_number", "is_header")


# ---- entities ------------------------------------------------------------------

_PH = [p.replace("\\b\\+", "\\b\\+") for p in legal.PHONES]
_CONTACT = "text || ' Tel 0' || lpad(CAST(doc_id AS VARCHAR), 10, '7') || ' or Alpha Data Services Ltd, mail a' || doc_id || '@x.org'"


@query("d3_contact_entities", f"""
SELECT doc_id, nullif(regexp_extract(x, '{legal.EMAIL}'), '') AS email,
  regexp_replace(coalesce({', '.join(f"nullif(regexp_extract(x, '{p}'), '')" for p in _PH)}), '[ -]', '', 'g') AS phone,
  nullif({s.strip(f"regexp_extract(x, '{legal.COMPANY}', 1)")}, '') AS company
FROM (SELECT doc_id, {_CONTACT} AS x FROM documents)""")
def _(t):
    x = F.concat(F.col("text"), F.lit(" Tel 0"), F.lpad(F.col("doc_id").cast("string"), 10, "7"),
                 F.lit(" or Alpha Data Services Ltd, mail a"), F.col("doc_id"), F.lit("@x.org"))
    r = docs(t).select("doc_id", x.alias("x"))
    return r.select("doc_id", legal.email(F.col("x")).alias("email"), legal.phone(F.col("x")).alias("phone"), legal.company(F.col("x")).alias("company"))


@query("d3_entities")
def _(t):
    block = F.concat(F.lit("Client Information:\nJohn Stone\nAcme Trading Ltd\nCompany address: 1 High "), F.col("source"),
                     F.lit(" Street\nCompany E-mail address: c@d.org\nPhone number: 0207 000 1111 22\n"), F.col("text"))
    return docs(t).select("doc_id", legal.entities(block).alias("e")).select("doc_id", "e.*")


@query("d7_highlight")
def _(t):
    from ..operators.highlight import highlight

    return highlight(
        t.documents.select(F.col("doc_id").alias("id"), "text"),
        t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


# ---- ids, ratios ---------------------------------------------------------------

_H = "substring(md5(source || '::structural::' || doc_id), 1, 16)"


@query("d33_point_id", f"""
SELECT doc_id, CASE WHEN u >= 9223372036854775808 THEN CAST(18446744073709551616 - u AS VARCHAR) ELSE CAST(u AS VARCHAR) END AS point_id
FROM (SELECT doc_id, CAST(CAST('0x' || substring({_H}, 1, 8) AS UBIGINT) AS HUGEINT) * 4294967296 + CAST(CAST('0x' || substring({_H}, 9, 8) AS UBIGINT) AS HUGEINT) AS u FROM documents)""")
def _(t):
    return docs(t).select("doc_id", ids.point_id(F.col("source"), F.lit("structural"), F.col("doc_id")).cast("string").alias("point_id"))


@query("c30_document_id", "SELECT doc_id, substring(md5(source || '::' || lang), 1, 16) AS document_id FROM documents")
def _(t):
    return docs(t).select("doc_id", ids.document_id(F.col("source"), F.col("lang")).alias("document_id"))


@query("b4_row_id", "SELECT doc_id, substring(md5(concat_ws('::', text, source)), 1, 16) AS row_id FROM documents")
def _(t):
    return docs(t).select("doc_id", ids.row_id(F.col("text"), F.col("source")).alias("row_id"))


@query("d34_defaults", """
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), lang, 'unknown') AS source_file,
  CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id * 100000 END AS chunk_number FROM documents""")
def _(t):
    n = F.col("doc_id") * 100000
    empty = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return docs(t).select(
        "doc_id", F.coalesce(F.nullif(empty, F.lit("")), "lang", F.lit("unknown")).alias("source_file"),
        F.coalesce(F.when(F.col("doc_id") % 5 != 0, n), F.lit(-1)).alias("chunk_number"))


@query("d35_percentage", """
SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 1) AS pct FROM documents GROUP BY lang""")
def _(t):
    from ..operators.catalog import shares

    return shares(t.documents, "lang")


# ---- citations -----------------------------------------------------------------

_CITED = "text || ' [' || (doc_id % 9 + 1) || '] and [' || (doc_id % 5 + 2) || ', ' || (doc_id % 7 + 1) || '] by [' || source || ' et al., ' || (2015 + doc_id % 10) || '] [Kim, 2020]'"


def cited(t):
    i = F.col("doc_id")
    return docs(t).select("doc_id", F.concat(
        F.col("text"), F.lit(" ["), i % 9 + 1, F.lit("] and ["), i % 5 + 2, F.lit(", "), i % 7 + 1, F.lit("] by ["),
        F.col("source"), F.lit(" et al., "), F.lit(2015).cast("long") + i % 10, F.lit("] [Kim, 2020]")).alias("text"))


CITED_SQL = f"SELECT doc_id, {_CITED} AS text FROM documents"
CITE_NUM_SQL = "list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda g: regexp_extract_all(g, '\\d+'))), lambda d: CAST(d AS BIGINT))))"


@query("d21_numeric_citations", f"SELECT doc_id, unnest({CITE_NUM_SQL}) AS citation FROM ({CITED_SQL})")
def _(t):
    return unfold(cited(t), ["doc_id"], citations.numeric_citations(F.col("text")), "citation")


_AY = "(?i)\\[([^,\\]]+(?:\\s+et\\s+al\\.?)?)\\s*,\\s*(\\d{4})\\]"
AUTHOR_YEAR_SQL = f"SELECT doc_id, {s.strip('a')} AS author, y AS year FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_AY}', 1)) AS a, unnest(regexp_extract_all(text, '{_AY}', 2)) AS y FROM ({CITED_SQL}))"


@query("d22_author_year_citations", AUTHOR_YEAR_SQL)
def _(t):
    return unfold(cited(t), ["doc_id"], citations.author_year_citations(F.col("text")), "c").select("doc_id", "c.author", "c.year")


_SKIP = ", ".join(f"'{w}'" for w in citations.TITLE_SKIP)
_FIRST = f"coalesce(replace(lower({s.words('split_part(author, chr(44), 1)')}[1]), '.', ''), 'unknown')"
_TITLE = f"coalesce(substring(lower(list_filter({s.words('title')}[1:3], lambda w: lower(w) NOT IN ({_SKIP}))[1]), 1, 8), '')"
_YEAR = "coalesce(CAST(year AS VARCHAR), '')"
_KEY = f"substring(replace(replace({_FIRST} || {_YEAR} || {_TITLE}, ' ', ''), '-', ''), 1, 50)"


@query("d23_bibtex", f"""
SELECT id, {_KEY} AS bibtex_key,
  CASE WHEN venue LIKE '%Workshop%' THEN '@inproceedings' ELSE '@article' END || '{{' || {_KEY} || ',' || chr(10) || '  title={{' || title || '}}'
   || ',' || chr(10) || '  author={{' || author || '}}'
   || CASE WHEN year IS NULL THEN '' ELSE ',' || chr(10) || '  year={{' || year || '}}' END
   || CASE WHEN venue = '' THEN '' WHEN venue LIKE '%Workshop%' THEN ',' || chr(10) || '  booktitle={{' || venue || '}}' ELSE ',' || chr(10) || '  journal={{' || venue || '}}' END
   || ',' || chr(10) || '  url={{http://x/' || id || '}}' || chr(10) || '}}' AS entry,
  concat_ws(', ', nullif(author, ''), '(' || CAST(year AS VARCHAR) || ')', '"' || title || '"', CASE WHEN venue <> '' THEN ', ' || venue END) || '.' AS citation
FROM ({PAPERS_SQL})""")
def _(t):
    year, url = F.coalesce(F.col("year").cast("string"), F.lit("")), F.concat(F.lit("http://x/"), F.col("id"))
    p = papers(t).select("id", "author", "title", "venue", year.alias("y"), url.alias("url"))
    a, ti, v, y = (F.col(c) for c in ("author", "title", "venue", "y"))
    key = citations.bibtex_key(a, y, ti)
    return p.select("id", key.alias("bibtex_key"), citations.bibtex_entry(key, a, ti, y, v, F.col("url")).alias("entry"),
                    citations.human_citation(a, ti, v, y).alias("citation"))


@query("d20_normalize_authors", f"""
SELECT doc_id, array_to_string({s.strip_list("string_split(source || ' ; ;' || lang || '; ' || substring(text, 1, 12), ';')")}, '|') AS authors FROM documents""")
def _(t):
    raw = F.concat(F.col("source"), F.lit(" ; ;"), F.col("lang"), F.lit("; "), F.substring("text", 1, 12))
    return docs(t).select("doc_id", F.array_join(citations.normalize_authors(F.split(raw, ";")), "|").alias("authors"))


# ---- model responses -----------------------------------------------------------

_RANK = "'Order: ' || (doc_id % 9) || ',' || (doc_id % 5 + 1) || ', 3,' || (doc_id % 7) || ',3'"


@query("f23_rank_list", f"""
WITH r AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all({_RANK}, '\\d+'), lambda d: CAST(d AS BIGINT)), lambda x: x >= 1 AND x <= 6), lambda x: x - 1) AS l FROM documents),
 e AS (SELECT doc_id, unnest(list_concat(l, range(0, 6))) AS idx, unnest(range(0, len(l) + 6)) AS i FROM r),
 f AS (SELECT doc_id, idx, min(i) AS i FROM e GROUP BY ALL)
SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, round((6 - (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)) / 6.0, 6) AS score FROM f""")
def _(t):
    i = F.col("doc_id")
    resp = F.concat(F.lit("Order: "), i % 9, F.lit(","), i % 5 + 1, F.lit(", 3,"), i % 7, F.lit(",3"))
    rows = docs(t).select("doc_id", responses.rank_order(resp, F.lit(6)).alias("o"))
    return rows.select("doc_id", "o", F.posexplode("o").alias("pos", "idx")).select(
        "doc_id", "idx", F.col("pos").cast("long").alias("pos"), F.round(responses.position_score(F.col("o"), F.col("pos")), 6).alias("score"))


@query("f24_point_score", """
SELECT doc_id, round(coalesce(TRY_CAST(nullif(regexp_extract(r, '0?\\.\\d+|1\\.0|0'), '') AS DOUBLE), 0.5), 6) AS score
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Score: 0.' || (doc_id % 97) WHEN 1 THEN '1.0' WHEN 2 THEN 'none' ELSE '.25 or so' END AS r FROM documents)""")
def _(t):
    i = F.col("doc_id")
    r = F.when(i % 4 == 0, F.concat(F.lit("Score: 0."), i % 97)).when(i % 4 == 1, "1.0").when(i % 4 == 2, "none").otherwise(".25 or so")
    return docs(t).select("doc_id", F.round(responses.point_score(r, F.lit(0.5)), 6).alias("score"))


@query("f25_failure_score", """
SELECT doc_id, round(1.0 - 0.1 * (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1), 6) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10""")
def _(t):
    from ..operators.ranking import top_k

    best = top_k(t.documents.select("doc_id", "source", "n_chars"), 10, ["source"], "n_chars", "doc_id")
    return best.select("doc_id", F.round(responses.failure_score(F.col("rank") - 1), 6).alias("score"))


@query("d31_fenced_json", "SELECT doc_id, source AS title, doc_id AS n FROM documents")
def _(t):
    body = F.to_json(F.struct(F.col("source").alias("title"), F.col("doc_id").alias("n")))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    parsed = F.from_json(responses.fenced_json(answer), "struct<title:string,n:bigint>")
    return docs(t).select("doc_id", parsed.alias("p")).select("doc_id", "p.title", "p.n")


@query("d32_final_answer", f"SELECT doc_id, {s.strip('text')} AS answer FROM documents")
def _(t):
    r = F.concat(F.lit("Thought: x\nFinal Answer: no\nFinal Answer: "), F.col("text"))
    return docs(t).select("doc_id", responses.final_answer(r).alias("answer"))


# ---- report checks -------------------------------------------------------------

@query("e10_report_validation", """
SELECT doc_id, array_to_string(list_filter([
   CASE WHEN doc_id % 4 = 0 THEN 'Missing sections: Conclusion' END,
   CASE WHEN doc_id % 5 = 0 THEN 'Section ''Introduction'' is empty or has errors' END,
   CASE WHEN doc_id % 6 = 0 THEN 'No references found' END,
   CASE WHEN length(text) < 500 THEN 'Report is too short (less than 500 characters)' END,
   CASE WHEN contains(lower(text), '[insert') THEN 'Report contains placeholder text: [insert' END,
   CASE WHEN contains(lower(text), '[error') THEN 'Report contains placeholder text: [Error' END,
   CASE WHEN contains(lower(text), 'todo') THEN 'Report contains placeholder text: TODO' END,
   CASE WHEN contains(lower(text), 'fixme') THEN 'Report contains placeholder text: FIXME' END,
   CASE WHEN contains(lower(text), 'not generated') THEN 'Report contains placeholder text: Not generated' END,
   CASE WHEN doc_id % 7 = 0 AND doc_id % 6 <> 0 THEN 'Invalid URL in references: htp:/broken' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents""")
def _(t):
    i = F.col("doc_id")
    names = F.array(F.lit("Abstract"), F.lit("Introduction"), F.lit("Research Findings"), F.lit("Conclusion"))
    bodies = F.array(F.lit("a"), F.when(i % 5 == 0, "[Error x").otherwise("b"), F.lit("c"), F.lit("d"))
    n = F.when(i % 4 == 0, 3).otherwise(4)
    sections = F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(bodies, F.lit(1), n))
    urls = F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("https://example.org/a"), F.when(i % 7 == 0, "htp:/broken").otherwise("http://localhost:80/x")))
    return docs(t).select("doc_id", F.array_join(filters.report_issues(sections, F.col("text"), urls), "; ").alias("issues"))


@query("d28_valid_url", """
SELECT page_id, regexp_matches(url, '^(?i)https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+[A-Z]{2,6}\\.?|localhost|\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})(?::\\d+)?(?:/?|[/?]\\S+)$') AS valid FROM pages""")
def _(t):
    return t.pages.select("page_id", web.is_valid_url(F.col("url")).alias("valid"))


# ---- transcripts ---------------------------------------------------------------

@query("a8_json_turns", "SELECT conv_id, turn, role || ': ' || text AS text, role AS speaker, turn AS turn_index FROM conversations")
def _(t):
    turn = F.struct(F.col("role").alias("speaker"), "text", F.col("turn").alias("index"))
    as_list = F.to_json(F.array(turn))
    c = spread(t.conversations, "conv_id", "turn").select(F.struct("conv_id", "turn").alias("doc_id"), as_list.alias("json"))
    return transcripts.json_turns(c).select("doc_id.conv_id", "doc_id.turn", "text", "speaker", "turn_index")


_CUES = s.sentences_keep("text")


@query("a7_subtitles", f"""
SELECT conv_id, turn, i AS segment, '00:00:' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || '.000' AS start_time,
  '00:00:' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || '.900' AS end_time, c AS text
FROM (SELECT conv_id, turn, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, list_filter({_CUES}, lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS l FROM conversations))""")
def _(t):
    def cue(x, i):
        sec = F.lpad(((i + 1) % 60).cast("string"), 2, "0")
        return F.concat((i + 1).cast("string"), F.lit("\n00:00:"), sec, F.lit(".000 --> 00:00:"), sec, F.lit(".900\n"), x)

    keep = F.filter(text.sentences_keep(F.col("text")), lambda x: ~x.rlike("^[0-9]+$"))
    vtt = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(keep, cue), "\n\n"), F.lit("\n"))
    c = spread(t.conversations, "conv_id", "turn").select(F.struct("conv_id", "turn").alias("doc_id"), vtt.alias("text"))
    return transcripts.subtitle_segments(c).select(
        "doc_id.conv_id", "doc_id.turn", F.col("segment").cast("long").alias("segment"), "start_time", "end_time", "text")


@query("c24_turn_chunks", "SELECT conv_id, turn, role || ': ' || text AS text, length(role || ': ' || text) AS char_count FROM conversations")
def _(t):
    body = transcripts.turn_text(F.col("role"), F.col("text"))
    return t.conversations.select("conv_id", "turn", body.alias("text"), F.length(body).cast("long").alias("char_count"))
