"""Chunkers, numbering, links and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..operators import numbering
from ..operators.chunking import available_methods, chunk
from ..operators.chunking.packing import recursive_split, sentence_packs
from ..operators.chunking.splitter import INGEST_SEPARATORS, splitter
from ..operators.chunking.structure import (
    assign_hierarchy, context_influence, join_short, sections, structural_min, subclauses,
)
from ..operators.chunking.windows import char_windows, page_of, word_windows
from ..operators.layout import spread, unfold
from ..plans import ingest as plan
from ..sources import files
from . import sqlbits as s
from .registry import query
from .views import CHUNKS_SQL, CONTRACT_SQL, chunk_sizes, chunk_table, contracts

WS = s.WS


def docs(t):
    return spread(t.documents.select("doc_id", "text"), "doc_id")


def numbered(df, col: str = "text"):
    return unfold(df, ["doc_id"], col, "text", "pos").select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "text")


@query("c4_paragraphs", f"""
SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS text
FROM (SELECT doc_id, {s.strip_list("string_split_regex(text, '\\n\\n+')")} AS l FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents))""")
def _(t):
    from ..functions.text import paragraphs

    return numbered(docs(t).select("doc_id", paragraphs(F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).alias("text")))


@query("c6_word_windows", f"SELECT doc_id, pos, text FROM ({s.word_window_cte(500, 425)})")
def _(t):
    return numbered(docs(t).select("doc_id", word_windows(F.col("text")).alias("text")))


@query("c15_char_windows", f"SELECT doc_id, pos, text FROM ({s.char_window_cte(512, 50)})")
def _(t):
    return numbered(docs(t).select("doc_id", char_windows(F.col("text")).alias("text")))


@query("c5_recursive_split")
def _(t):
    return recursive_split(docs(t), "text")


_HEAD1 = r"(?m)^(\d+)\.\s+(.+)"


@query("c7_sections", f"""
WITH c AS ({CONTRACT_SQL}), l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM c)),
 m AS (SELECT *, regexp_matches(l, '^\\d+\\.\\s+.') OR regexp_matches(l, '^(?i:SECTION|CLAUSE)\\s+\\d+[:.]?\\s*.') AS head FROM l),
 g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM m)
SELECT doc_id, sec::BIGINT AS sec, regexp_extract(string_agg(l, chr(10) ORDER BY i), '^(\\d+)\\.\\s+(.+)', 1) AS number,
  {s.strip("regexp_extract(string_agg(l, chr(10) ORDER BY i), '^(\\d+)\\.\\s+(.+)', 2)")} AS title,
  {s.strip("string_agg(l, chr(10) ORDER BY i)")} AS text
FROM g WHERE sec > 0 GROUP BY doc_id, sec""")
def _(t):
    from ..functions.text import strip

    rows = unfold(contracts(t), ["doc_id"], sections(F.col("text")), "s", "i").filter(F.col("s.number").isNotNull())
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("sec"), "s.number", "s.title", strip(F.col("s.text")).alias("text"))


@query("c8_subclauses", f"""
WITH c AS ({CONTRACT_SQL}), l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM c)),
 m AS (SELECT *, regexp_extract(l || chr(10), '^(\\d+\\.\\d+(?:\\.\\d+)*)\\s', 1) || regexp_extract(l || chr(10), '^(\\([a-zA-Z0-9]+\\))\\s', 1) AS label FROM l),
 g AS (SELECT *, sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sub FROM m),
 a AS (SELECT doc_id, sub, max(label) AS label, {s.strip("string_agg(l, chr(10) ORDER BY i)")} AS text, max(sub) OVER (PARTITION BY doc_id) AS subs FROM g GROUP BY doc_id, sub)
SELECT doc_id, CASE WHEN subs = 0 THEN 1 ELSE sub END::BIGINT AS sub, label, text FROM a WHERE sub > 0 OR subs = 0""")
def _(t):
    from ..functions.text import strip

    rows = unfold(contracts(t), ["doc_id"], subclauses(F.col("text")), "s", "i")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("sub"), F.coalesce("s.label", F.lit("")).alias("label"), strip(F.col("s.text")).alias("text"))


def pack_sql(sentences: str, count: str, limit: int) -> str:
    return f"""
WITH RECURSIVE st AS MATERIALIZED (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sentences} AS l FROM documents)),
 sz AS MATERIALIZED (SELECT doc_id, s, i, {count} AS c FROM st),
 w AS (SELECT doc_id, i, 1 AS unit, c AS wc FROM sz WHERE i = 1
   UNION ALL SELECT w.doc_id, sz.i, CASE WHEN w.wc + sz.c <= {limit} THEN w.unit ELSE w.unit + 1 END, CASE WHEN w.wc + sz.c <= {limit} THEN w.wc + sz.c ELSE sz.c END
   FROM w JOIN sz ON sz.doc_id = w.doc_id AND sz.i = w.i + 1)
SELECT doc_id, CAST(unit AS BIGINT) AS pos, string_agg(s, ' ' ORDER BY i) AS text FROM w JOIN sz USING (doc_id, i) GROUP BY doc_id, unit"""


@query("c9_sentence_packs", pack_sql(s.sentences_keep("text"), f"len(regexp_extract_all(s, '{s.WORD}'))", 300))
def _(t):
    return numbered(sentence_packs(docs(t), "text", "units"), "units")


@query("c9_sentence_packs_plain", pack_sql(s.sentences_drop("text"), f"len({s.words('s')})", 300))
def _(t):
    return numbered(sentence_packs(docs(t), "text", "units", keep=False), "units")


@query("c10_structural_min")
def _(t):
    return structural_min(contracts(t)).select("doc_id", "pos", "level", "section_number", "subclause_label", "text")


@query("c11_hierarchy", f"""
WITH c AS ({CHUNKS_SQL}), x AS (SELECT *, regexp_matches(text, '(?m)^\\s*\\d+\\.\\s+') AS a, regexp_matches(text, '(?m)^\\s*\\d+\\.\\d+(\\.\\d+)?\\s+') AS b,
   regexp_matches(text, '(?m)^\\s*\\d+\\.\\d+\\.\\d+') AS d, length(text) > 500 AS long FROM c)
SELECT id, CASE WHEN a THEN 1 WHEN b THEN 2 WHEN d OR long THEN 3 ELSE 1 END::BIGINT AS hierarchy_level, NOT a AND NOT b AND NOT d AND long AS fallback_applied,
  round(least((row_number() OVER (PARTITION BY doc_id, chunking_method ORDER BY pos) - 1) * 0.1, 1.0), 6) AS context_influence FROM x""")
def _(t):
    # The chunk position is the number of earlier chunks of its document, so no window is needed.
    return chunk_table(t).withColumn("h", assign_hierarchy(F.col("text"))).select(
        "id", F.col("h.hierarchy_level").cast("long").alias("hierarchy_level"), "h.fallback_applied",
        F.round(context_influence(F.col("pos") - 1), 6).alias("context_influence"))


@query("c12_process_document")
def _(t):
    split = recursive_split(docs(t), "text")
    rejoined = split.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_p", "_q", "_r", "text"))).alias("l")).select(
        "doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))
    chunks = structural_min(rejoined).withColumnRenamed("pos", "original")
    pieces = recursive_split(chunks.select("doc_id", "original", "level", "text"), "text")
    return join_short(pieces, ["doc_id", "original", "level"], ["_p", "_q", "_r"])


@query("c13_recursive")
def _(t):
    return chunk(docs(t), "recursive")


@query("c14_ingest_splitter")
def _(t):
    return numbered(docs(t).select("doc_id", splitter(800, 100, INGEST_SEPARATORS)(F.col("text")).alias("text")))


# Distances of neighbouring sentences, each embedded with the sentences around it.
_SEM = f"""
WITH st AS MATERIALIZED (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.?!]){WS}+', '\\1' || chr(1), 'g'), '\\x01'), lambda x: x <> '') AS l FROM documents)),
 wide AS MATERIALIZED (SELECT doc_id, i, doc_id * 1000000 + i AS k, concat_ws(' ', lag(s) OVER w, s, lead(s) OVER w) AS text FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 e AS MATERIALIZED ({s.embedding_cells('wide', 'k')}),
 prod AS (SELECT a.k, sum(a.v * b.v) AS c FROM e a JOIN e b ON b.k = a.k + 1 AND b.d = a.d GROUP BY a.k),
 dist AS MATERIALIZED (SELECT w.doc_id, w.i, round(1 - coalesce(p.c, 0), 9) AS dist FROM wide w LEFT JOIN prod p ON p.k = w.k WHERE EXISTS (SELECT 1 FROM st n WHERE n.doc_id = w.doc_id AND n.i = w.i + 1)),
 cut AS (SELECT doc_id, quantile_cont(dist, 0.95) AS cut FROM dist GROUP BY doc_id),
 g AS (SELECT st.doc_id, st.i, st.s, coalesce(sum(CASE WHEN dist.dist > cut.cut + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY st.doc_id ORDER BY st.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
       FROM st LEFT JOIN dist ON dist.doc_id = st.doc_id AND dist.i = st.i LEFT JOIN cut ON cut.doc_id = st.doc_id)
SELECT doc_id, CAST(grp + 1 AS BIGINT) AS pos, string_agg(s, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, grp"""


@query("c16_semantic", _SEM)
def _(t):
    return chunk(docs(t), "semantic", clean=False).select("doc_id", "pos", "text")


@query("c17_structural")
def _(t):
    return chunk(contracts(t), "structural")


@query("c18_agentic")
def _(t):
    return chunk(contracts(t), "agentic")


@query("c19_grouping")
def _(t):
    return chunk(docs(t), "agentic")


@query("c20_cluster")
def _(t):
    return chunk(docs(t), "cluster")


@query("c21_hierarchical")
def _(t):
    return chunk(contracts(t), "hierarchical")


@query("c25_page_of", f"""
WITH c AS ({s.char_window_cte(512, 50)}) SELECT c.doc_id, c.pos, least(floor((c.pos - 1) * 462 / length(d.text) * (d.doc_id % 7 + 1)), d.doc_id % 7)::BIGINT + 1 AS page FROM c JOIN documents d USING (doc_id)""")
def _(t):
    pages = F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 7 + 1)
    rows = unfold(docs(t), ["doc_id", F.length("text").alias("n"), pages.alias("pages")], char_windows(F.col("text")), "piece", "k")
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("pos"), page_of(F.col("k") * 462, F.col("n"), F.col("pages")).alias("page"))


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY doc_id, method_ord, pos) AS chunk_number FROM ({CHUNKS_SQL})"


@query("c26_chunk_numbering", f"SELECT id, chunk_number + 1000 AS chunk_number FROM ({_NUMBERED})")
def _(t):
    rows = numbering.number_pieces(chunk_sizes(t), ["doc_id", "method_ord"], start=1001)
    return rows.select(F.concat_ws("-", "doc_id", "method_ord", "pos").alias("id"), "chunk_number")


# Every third chunk of a document opens a clause, the next two belong to it.
_CLAUSES = f"""SELECT *, CASE WHEN (pos - 1) % 3 = 0 THEN CAST((pos - 1) // 3 + 1 AS VARCHAR) ELSE ((pos - 1) // 3 + 1) || '.' || ((pos - 1) % 3) END AS clause_number,
   CASE WHEN (pos - 1) % 3 > 0 THEN CAST((pos - 1) // 3 + 1 AS VARCHAR) END AS parent FROM ({_NUMBERED}) WHERE chunking_method = 'hierarchical'"""


@query("c27_parent_resolution", f"""
WITH c AS ({_CLAUSES}), o AS (SELECT doc_id, clause_number, max(chunk_number) AS p FROM c GROUP BY ALL)
SELECT c.id, c.clause_number, coalesce(o.p, -1) AS parent_chunk_number FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.clause_number = c.parent""")
def _(t):
    rows = numbering.number_rows(chunk_table(t).select("id", "doc_id", "method_ord", "pos", "chunking_method"), ["doc_id", "method_ord", "pos"])
    rows = rows.filter(F.col("chunking_method") == "hierarchical")
    top = (F.floor((F.col("pos") - 1) / 3).cast("long") + 1).cast("string")
    sub = (F.col("pos") - 1) % 3
    rows = rows.withColumns({"clause_number": F.when(sub == 0, top).otherwise(F.concat_ws(".", top, sub)), "parent": F.when(sub > 0, top)})
    return numbering.resolve_parents(rows).select("id", "clause_number", F.coalesce("parent_chunk_number", F.lit(-1).cast("long")).alias("parent_chunk_number"))


_MAIL = "text || ' write to m' || doc_id || '@x.org now'"


@query("c28_entity_attach", f"""
WITH d AS (SELECT doc_id, {_MAIL} AS text FROM documents), c AS ({s.word_window_cte(120, 102, src='d')}),
 de AS (SELECT doc_id, nullif(regexp_extract(text, '{legal.EMAIL}'), '') AS doc_email FROM d),
 ce AS (SELECT doc_id, pos, text, nullif(regexp_extract(text, '{legal.EMAIL}'), '') AS own FROM c)
SELECT ce.doc_id, ce.pos, coalesce(own, CASE WHEN contains(lower(text), lower(doc_email)) THEN doc_email END, '') AS email FROM ce JOIN de USING (doc_id)""")
def _(t):
    body = F.concat("text", F.lit(" write to m"), "doc_id", F.lit("@x.org now"))
    whole = docs(t).select("doc_id", body.alias("text"))
    pieces = numbered(whole.select("doc_id", word_windows(F.col("text"), 120, 0.15).alias("text")))
    return plan.attach_entities(pieces, whole).select("doc_id", "pos", F.coalesce("email", F.lit("")).alias("email"))


@query("c29_enrichment", f"""
SELECT id, source_file, 'document' AS source_type, 'p1' AS project_id, pos - 1 AS chunk_index, len({s.words('text')}) AS word_count, 'text' AS embedding_type,
  CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS text_preview FROM ({CHUNKS_SQL})""")
def _(t):
    from ..functions.text import clip, count_words

    given = F.create_map(F.lit("source_type"), F.lit("document"), F.lit("project_id"), F.lit("p1"))
    base = F.create_map(F.lit("source_type"), F.lit("unknown"), F.lit("embedding_type"), F.lit("text"))
    # Given metadata overrides what the reader set.
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)
    return chunk_table(t).withColumn("m", merged).select(
        "id", "source_file", F.col("m")["source_type"].alias("source_type"), F.col("m")["project_id"].alias("project_id"),
        (F.col("pos") - 1).alias("chunk_index"), count_words(F.col("text")).cast("long").alias("word_count"),
        F.col("m")["embedding_type"].alias("embedding_type"), clip(F.col("text"), 200).alias("text_preview"))


@query("l1_ingest")
def _(t):
    files = t.documents.select(
        "doc_id", F.concat("source", F.lit(".txt")).alias("source_file"), "text", F.lit("2024-01-01T00:00:00").alias("upload_timestamp"))
    # The digest needs every vector, but doesn't return them.
    digest = F.md5(F.array_join(F.transform("embedding", lambda x: (F.round(x, 6) + 0.0).cast("string")), ",").cast("binary"))
    rows = plan.ingest(files, available_methods()).withColumn("embedding_digest", digest)
    return rows.drop("embedding").withColumn("chunk_pk", F.col("chunk_pk").cast("string"))


@query("b8_chunking_log", f"""
SELECT upload_timestamp || '|' || source_file || '|' || id || '|' || pos || '|' || chunking_method || '|APPLIED' AS line FROM ({CHUNKS_SQL})""")
def _(t):
    return plan.log_lines(chunk_table(t).withColumn("chunk_index", F.col("pos")))


# Every document as a file: five kinds, one of them also broken, and one that nothing reads. Every seventh is stored.
_KINDS = ["txt", "md", "json", "json", "vtt", "xyz"]
_FILE = f"source || '-' || doc_id || '.' || ({_KINDS})[doc_id % 6 + 1]"
_PARSED = f"""SELECT file_name, kind, CASE WHEN stored THEN 'SKIPPED' WHEN m IS NOT NULL THEN 'ERROR' ELSE 'APPLIED' END AS status, CASE WHEN stored THEN 'already processed' ELSE m END AS message,
   CASE WHEN NOT stored AND m IS NULL AND kind <> 'txt' THEN body END AS text FROM (
  SELECT *, CASE WHEN kind = 'xyz' THEN 'unsupported file type: xyz' WHEN doc_id % 6 = 3 THEN 'no turns' WHEN body = '' THEN 'no text' END AS m FROM (
   SELECT doc_id, {_FILE} AS file_name, ({_KINDS})[doc_id % 6 + 1] AS kind, doc_id % 7 = 0 AS stored, CASE doc_id % 6 WHEN 1 THEN {s.strip("regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g')")}
     WHEN 2 THEN 'A: ' || text WHEN 4 THEN {s.strip("regexp_replace(text, chr(10) || '+', ' ', 'g')")} ELSE text END AS body FROM documents))"""


def parsed_files(t):
    i, line = F.col("doc_id") % 6, F.regexp_replace("text", "\n+", " ")
    body = F.when(i == 2, F.to_json(F.array(F.struct(F.lit("A").alias("speaker"), "text")))).when(i == 3, F.concat(F.lit("{"), "text"))
    body = body.when(i == 4, F.concat(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n"), line)).otherwise(F.col("text"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i + 1).cast("int"))
    named = spread(t.documents, "doc_id").withColumn("file_name", F.concat("source", F.lit("-"), "doc_id", F.lit("."), kind))
    stored = named.filter(F.col("doc_id") % 7 == 0).select("file_name")
    return files.parse_files(named.select(F.concat(F.lit("in/"), "file_name").alias("path"), F.encode(body, "UTF-8").alias("content")), stored)


@query("l3_files_by_kind", _PARSED)
def _(t):
    rows = parsed_files(t)
    return rows.select("file_name", "kind", "status", "message", F.when(F.col("kind") != "txt", F.col("text")).alias("text"))


@query("b8_file_log", f"SELECT concat_ws('|', '2024-01-01T00:00:00', file_name, kind, status, message) AS line FROM ({_PARSED})")
def _(t):
    return plan.file_log(parsed_files(t), "2024-01-01T00:00:00")
