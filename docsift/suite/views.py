"""Inputs that queries derive from the given tables, with their SQL twins.

The reference works on contracts, chunk collections and paper lists. These views give
the given tables that shape and cover every row of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clip
from ..operators.chunking.windows import char_windows, word_windows
from ..operators.layout import spread, unfold
from .registry import Tables
from .sqlbits import char_window_cte, word_window_cte

# One closing sentence per document, chosen by id, so that contract features occur.
PHRASES = [
    "Client shall pay the fee under clause 3.1 and clause 4.2.",
    "Either Party must keep information confidential; see Clause 12.4.",
    '"Services" means the work described in Annex A; "Term" means one year;',
    "This agreement ends by termination or when it expires.",
    "The Vendor warrants that no patent is infringed.",
    "Disputes are settled by arbitration before the court.",
    "The Agency agrees to invoice the Client each month.",
    "Neither side answers for an act of god beyond control.",
    "Liability for damages is limited under clause 7.",
    "Notes [1], [2, 3] and [Smith et al., 2021] explain the terms.",
]


def legal_texts(t: Tables) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return spread(t.documents, "doc_id").select(
        "doc_id", "lang", "source", F.concat("text", F.lit("\n3.1 Terms. "), phrase).alias("text")
    )


_SQL_PHRASES = ", ".join("'" + p + "'" for p in PHRASES)
LEGAL_SQL = f"""SELECT doc_id, lang, source, text || chr(10) || '3.1 Terms. ' ||
    ([{_SQL_PHRASES}])[doc_id % {len(PHRASES)} + 1] AS text FROM documents"""


def contracts(t: Tables) -> DataFrame:
    """Documents with numbered lines: every fifth opens a section, the rest are subclauses."""

    def numbered(line, i):
        section = F.floor(i / 5).cast("int") + 1
        sub = i % 5
        return F.when(sub == 0, F.concat(section.cast("string"), F.lit(". "), line)).otherwise(
            F.concat(section.cast("string"), F.lit("."), sub.cast("string"), F.lit(" "), line)
        )

    lines = F.transform(F.split("text", "\n"), numbered)
    return spread(t.documents, "doc_id").select("doc_id", F.array_join(lines, "\n").alias("text"))


CONTRACT_SQL = """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
      lambda l, i: CASE WHEN (i - 1) % 5 = 0 THEN ((i - 1) // 5 + 1) || '. ' || l
                        ELSE ((i - 1) // 5 + 1) || '.' || ((i - 1) % 5) || ' ' || l END), chr(10)) AS text
    FROM documents"""


def chunk_table(t: Tables, known: DataFrame | None = None) -> DataFrame:
    """A chunk collection: word windows and character windows of every document.

    What is ``known`` of a document (by ``doc_id``, few bytes) joins its text before that is cut and goes with its chunks.
    """
    docs, more = spread(t.documents, "doc_id"), []
    if known is not None:
        docs, more = docs.join(known, "doc_id"), [c for c in known.columns if c != "doc_id"]
    out = None
    for i, (method, pieces) in enumerate(
        [("recursive", word_windows(F.col("text"), 120, 0.15)), ("hierarchical", char_windows(F.col("text"), 800, 100))]
    ):
        part = unfold(docs, ["doc_id", "lang", "source", *more], pieces, "text", "pos").select(
            "doc_id", "lang", *more, (F.col("pos") + 1).cast("long").alias("pos"), "text",
            F.lit(method).alias("chunking_method"), F.lit(i).alias("method_ord"),
            F.concat(F.col("source"), F.lit(".txt")).alias("source_file"),
            F.when(F.col("doc_id") % 3 != 0, F.concat(F.col("source"), F.lit(".txt"))).alias("file_name"),
        )
        out = part if out is None else out.unionByName(part)
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return out.withColumns({
        "id": F.concat_ws("-", "doc_id", "method_ord", "pos"),
        "upload_timestamp": F.concat(F.lit("2024-01-"), day, F.lit("T08:00:00")),
        "embedding_model": F.when(F.col("lang") == "en", "model-a").otherwise("model-b"),
        "page": F.floor((F.col("pos") - 1) / 3).cast("long") + 1,
        "chunk_level": (F.col("pos") % 3 + 1).cast("long"),
    })


def chunk_sizes(t: Tables) -> DataFrame:
    """``doc_id, method_ord, n``: chunks per document and method, summed where they are cut."""
    return chunk_table(t).groupBy("doc_id", "method_ord").agg(F.count("*").alias("n"))


CHUNKS_SQL = f"""SELECT *, doc_id || '-' || method_ord || '-' || pos AS id,
      '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T08:00:00' AS upload_timestamp,
      CASE WHEN lang = 'en' THEN 'model-a' ELSE 'model-b' END AS embedding_model,
      (pos - 1) // 3 + 1 AS page, pos % 3 + 1 AS chunk_level
    FROM (SELECT doc_id, lang, pos, text, method AS chunking_method, method_ord, source || '.txt' AS source_file,
                 CASE WHEN doc_id % 3 <> 0 THEN source || '.txt' END AS file_name
          FROM (SELECT *, 'recursive' AS method, 0 AS method_ord FROM ({word_window_cte(120, 102, extra=', lang, source')})
                UNION ALL
                SELECT *, 'hierarchical', 1 FROM ({char_window_cte(800, 100, extra=', lang, source')})))"""


def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


TEXT_QUERIES_SQL = "SELECT item_id AS query_id, text FROM benchmark"


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(".txt")).alias("file_name"))


def papers(t: Tables) -> DataFrame:
    """Papers read off documents: first words as title, text as abstract."""
    from ..functions.text import words

    ws = words(F.col("text"))
    venue = F.element_at(F.array(*map(F.lit, ["NeurIPS", "Journal of Data", "ACL Workshop", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.array_join(F.slice(ws, 1, 6), " ").alias("title"), F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 11 != 0, F.lit(2010).cast("long") + F.col("doc_id") % 16).alias("year"),
        (F.col("n_chars") % 1500).alias("citation_count"), venue.alias("venue"),
        F.concat_ws(", ", F.get(ws, F.lit(0)), F.get(ws, F.lit(1))).alias("author"), "lang", "source",
    )


_W = "list_filter(string_split_regex(text, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')"
PAPERS_SQL = f"""SELECT doc_id AS id, array_to_string({_W}[1:6], ' ') AS title, text AS abstract,
      CASE WHEN doc_id % 11 <> 0 THEN 2010 + doc_id % 16 END AS year, n_chars % 1500 AS citation_count,
      (['NeurIPS', 'Journal of Data', 'ACL Workshop', ''])[doc_id % 4 + 1] AS venue,
      concat_ws(', ', {_W}[1], {_W}[2]) AS author, lang, source FROM documents"""


def preview_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("text_preview", clip(F.col("text"), 200))
