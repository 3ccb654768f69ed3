"""Searches for a whole query table at once.

``corpus(id, text, vec, …)`` and ``queries(query_id, text, vec)``; every result is
``query_id, id, rank, score, …``, one list per query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash, dedup_key
from ..functions.text import words
from ..operators import bm25, fusion, lexical, phrases, rerank, vector
from ..operators.numbering import staged
from ..operators.ranking import confident, distinct_texts, keep_first, ranked, top_k
from ..session import BROADCAST_ROWS, fits_broadcast, small_side


@dataclass
class SearchConfig:
    """What to search with; the weights go by method name."""

    k: int = 5
    methods: list[str] = field(default_factory=lambda: ["semantic", "bm25", "ngram"])
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.4, "bm25": 0.35, "ngram": 0.25})
    threshold: float = 0.3
    search_type: str = "semantic"
    documents: int = 5


def _bounded(results: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    return small_side(results, fits_broadcast(queries, max(1, BROADCAST_ROWS // max(1, width))))


def _join_text(results: DataFrame, corpus: DataFrame, queries: DataFrame, width: int, *cols) -> DataFrame:
    return _bounded(results, queries, width).join(corpus.select("id", *cols), "id")


def _vec(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "vec")


def _keyed(corpus: DataFrame, key: Column) -> DataFrame:
    return corpus.select("id", "vec", key.alias("_key"))


def text_key() -> Column:
    return F.md5(dedup_key(F.col("text")))


def semantic(corpus: DataFrame, queries: DataFrame, k: int, keep_key: bool = False) -> DataFrame:
    """Nearest 2k different texts by cosine, scaled over those, cut to ``k``."""
    found = vector.normalised(vector.top(_keyed(corpus, text_key()), _vec(queries, "query_id"), 2 * k, distinct=True))
    found = found.filter(F.col("rank") <= k)
    return found if keep_key else found.drop("_key")


def keyword(corpus: DataFrame, queries: DataFrame, k: int, vocab: DataFrame | None = None) -> DataFrame:
    return bm25.search(corpus.select("id", "text"), queries.select("query_id", "text"), k, dedup_key(F.col("text")), vocab=vocab)


def mixed(corpus: DataFrame, queries: DataFrame, k: int, vocab: DataFrame | None = None) -> DataFrame:
    """Semantic and keyword lists of 2k different texts fused by reciprocal rank on the text."""
    sem = semantic(corpus, queries, 2 * k, keep_key=True).withColumnRenamed("_key", "key")
    key_list = _join_text(keyword(corpus, queries, 2 * k, vocab), corpus, queries, 2 * k, text_key().alias("key"))
    return top_k(fusion.rrf_by_text(sem, key_list), k, ["query_id"])


def search(corpus: DataFrame, queries: DataFrame, mode: str, k: int = 5, where: Column | None = None) -> DataFrame:
    """Document search in ``semantic``, ``bm25`` or ``mixed`` mode over the rows that pass ``where``."""
    if mode not in ("semantic", "bm25", "mixed"):
        raise ValueError(f"unknown search mode: {mode}")
    if where is not None:
        corpus = corpus.filter(where)
    return {"semantic": semantic, "bm25": keyword, "mixed": mixed}[mode](corpus, queries, k)


def hybrid(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Semantic and lexical lists of 2k different texts fused by id; of equal texts the better stays.

    A column ``text_key`` of the corpus, if there is one, spares digests of the texts.
    """
    key = F.col("text_key") if "text_key" in corpus.columns else text_key()
    # At most 2k rows per query, read for their ids and for their ranks.
    sem = staged(vector.top(_keyed(corpus, key), _vec(queries, "query_id"), 2 * k, distinct=True))
    lex = staged(lexical.top(corpus.select("id", "text", *["text_key"] * ("text_key" in corpus.columns)), queries.select("query_id", "text"), 2 * k, key=key))
    cols = ["query_id", "id", "rank"]
    ids = _bounded(sem.select(*cols).unionByName(lex.select(*cols)).select("id").distinct(), queries, 4 * k)
    heads = corpus.select("id", key.alias("head")).join(ids, "id", "left_semi")
    return fusion.hybrid(sem, lex, heads, k)


def advanced(corpus: DataFrame, queries: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    """Up to three ranked lists of different texts -> weighted fusion -> 2k -> contract boost -> ``k``.

    Equal texts score alike in each list, so they are represented by the same id.
    """
    cfg = cfg or SearchConfig(k=10)
    k, texts, asked, key = cfg.k, corpus.select("id", "text"), queries.select("query_id", "text"), content_hash(F.col("text"))
    makers = {
        "semantic": lambda: vector.top(_keyed(corpus, key), _vec(queries, "query_id"), 4 * k, distinct=True),
        "bm25": lambda: bm25.top(texts, asked, 2 * k, lambda c: words(F.lower(c)), norm="max", key=key),
        "ngram": lambda: phrases.top(texts, asked, 2 * k, key=key),
    }
    lists = [(m, makers[m]()) for m in ("semantic", "bm25", "ngram") if m in cfg.methods]
    fused = fusion.weighted_rrf(lists, [cfg.weights[m] for m, _ in lists])
    rows = top_k(fused, 2 * k, ["query_id"]).drop("rank")
    rows = rerank.legal_boost(_join_text(rows, corpus, queries, 2 * k, "text"), asked)
    one = F.when(F.size("methods") == 1, F.get("methods", F.lit(0))).otherwise("hybrid")
    rows = rows.withColumn("retrieval_method", one).drop("methods")
    return top_k(rows, k, ["query_id"], "final_score")


def nested(results: DataFrame) -> DataFrame:
    """Advanced results in the nested shape an API returns."""
    return results.select(
        "query_id", "rank", F.col("id").cast("string").alias("id"), F.col("text").alias("content"),
        F.struct(F.col("score").alias("base"), F.lit(0.0).alias("rerank"), F.col("final_score").alias("final")).alias("scores"),
        F.struct("clause_type", "section_id", "party_relevance", "is_obligation").alias("legal_context"),
        "retrieval_method",
    )


def candidates(corpus: DataFrame, queries: DataFrame, k: int, more: DataFrame | None = None,
               each: int = 0) -> DataFrame:
    """Best ``k`` per query with text, and ``each`` per further phrasing.

    ``more(query_id, variant, vec)`` holds vectors of the phrasings; a chunk found
    several times keeps its best score.
    """
    found = vector.top(_vec(corpus, "id"), _vec(queries, "query_id"), k).select("query_id", "id", "score")
    if more is not None:
        tagged = more.select(F.struct("query_id", "variant").alias("query_id"), "vec")
        extra = vector.top(_vec(corpus, "id"), tagged, each)
        found = found.unionByName(extra.select(F.col("query_id.query_id").alias("query_id"), "id", "score"))
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    cols = [c for c in corpus.columns if c not in ("id", "vec")]
    return _join_text(found, corpus, queries, k + 9 * each, *cols)


def retrieve(corpus: DataFrame, queries: DataFrame, cfg: SearchConfig, kind: str = "general",
             more: DataFrame | None = None) -> DataFrame:
    """Candidates -> keyword boost -> confidence filter -> ``k``; a lexical search is not boosted."""
    floor = {"summarization": 10, "comparison": 8}
    k = max(cfg.k, floor.get(kind, 0))
    if cfg.search_type not in ("semantic", "lexical", "hybrid"):
        raise ValueError(f"unknown search type: {cfg.search_type}")
    if cfg.search_type == "lexical":
        found = lexical.top(corpus.select("id", "text"), queries.select("query_id", "text"), 2 * k).select("query_id", "id", "score")
        rows = _join_text(found, corpus, queries, 2 * k, *[c for c in corpus.columns if c not in ("id", "vec")])
        return confident(rows, cfg.threshold, ["query_id"]).filter(F.col("rank") <= k)
    if cfg.search_type == "hybrid":
        found = hybrid(corpus, queries, 2 * k).select("query_id", "id", "score")
        found = _join_text(found, corpus, queries, 2 * k, *[c for c in corpus.columns if c not in ("id", "vec")])
    else:
        found = candidates(corpus, queries, 2 * k, more, k)
    rows = rerank.keyword_boost(found, rerank.query_features(queries))
    rows = confident(rows, cfg.threshold, ["query_id"])
    return rows.filter(F.col("rank") <= k)


# What a chunk's score can gain from keywords, cues and phrases (rerank.keyword_boost).
MOST_BOOST = 0.9


def by_documents(corpus: DataFrame, queries: DataFrame, each: int, documents: int) -> DataFrame:
    """``query_id, id, file_name, score``: the best ``each`` chunks of every document that can
    still be among a query's best ``documents`` after the boost.

    Tasks keep their best chunks per query and document. A document's best score only
    grows by the boost, so those whose best stays below that of the last place even
    with the whole boost are left out.
    """
    found = staged(vector.top(corpus.select("id", "vec", "file_name"), _vec(queries, "query_id"), each, group="file_name"))
    first = found.filter(F.col("rank") == 1).select("query_id", "file_name", F.col("score").alias("best"))
    last = top_k(first, documents, ["query_id"], "best", "file_name").filter(F.col("rank") == documents)
    last = last.select("query_id", (F.col("best") - MOST_BOOST).alias("floor"))
    able = first.join(last, "query_id", "left").filter(F.col("floor").isNull() | (F.col("best") >= F.col("floor")))
    return found.drop("rank").join(able.select("query_id", "file_name"), ["query_id", "file_name"], "left_semi")


def retrieve_hierarchical(corpus: DataFrame, queries: DataFrame, cfg: SearchConfig,
                          more: DataFrame | None = None) -> DataFrame:
    """Best documents by their best chunk, then the best chunks of each; needs ``file_name``.

    Of equal texts the one with the smallest id counts. Each document offers three times
    the chunks that its share of the list takes, so no document is missed because another's
    chunks are nearer. A chunk that several phrasings in ``more`` find keeps its best score.
    """
    corpus = distinct_texts(corpus, dedup_key(F.col("text")), "id")
    each = 3 * max(1, cfg.k // cfg.documents)
    found = by_documents(corpus, queries, each, cfg.documents)
    if more is not None:
        tagged = more.select(F.struct("query_id", "variant").alias("query_id"), "vec")
        extra = by_documents(corpus, tagged, each, cfg.documents).withColumn("query_id", F.col("query_id.query_id"))
        found = found.unionByName(extra).groupBy("query_id", "id", "file_name").agg(F.max("score").alias("score"))
    found = found.join(corpus.drop("vec", "file_name"), "id")
    rows = rerank.keyword_boost(found, rerank.query_features(queries))
    rows = rerank.by_document(rows, cfg.k, cfg.documents).drop("rank")
    return confident(rows, cfg.threshold, ["query_id"])


def compare_cohorts(corpus: DataFrame, queries: DataFrame, k: int, cohort: str = "cohort_id") -> DataFrame:
    """Best ``k`` per query in each cohort; every task cuts to k per cohort before the shuffle."""
    return vector.top(corpus.select("id", "vec", cohort), _vec(queries, "query_id"), k, group=cohort)


def synthesis(rounds: list[DataFrame]) -> DataFrame:
    """Union of several retrieval rounds by chunk; the later round wins."""
    out = None
    for i, r in enumerate(rounds):
        r = r.withColumn("_round", F.lit(i))
        out = r if out is None else out.unionByName(r)
    rows = keep_first(out, ["query_id", "id"], [F.col("_round").desc()])
    return ranked(rows.drop("rank", "_round"), ["query_id"])


def context(results: DataFrame, per_query: int, chars: int) -> DataFrame:
    """Prompt context: the first characters of the best chunks, joined in rank order."""
    rows = results.filter(F.col("rank") <= per_query)
    parts = F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def envelope(results: DataFrame, found: DataFrame) -> DataFrame:
    """Counts that go with a result list."""
    shown = results.groupBy("query_id").agg(F.count("*").alias("filtered_count"))
    total = found.groupBy("query_id").agg(
        F.count("*").alias("total_results"), F.count_distinct("file_name").alias("document_count"),
        F.max("score").alias("max_score"),
    )
    count = F.coalesce("filtered_count", F.lit(0))
    return total.join(shown, "query_id", "left").withColumns({
        "filtered_count": count, "status": F.when(count > 0, "success").otherwise("no_results"),
    })
