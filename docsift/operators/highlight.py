"""Marking query terms in texts."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import word_ngrams
from ..session import BROADCAST_ROWS, fits_broadcast, small_side

# The mark put around a hit.
OPEN = '<mark style="background-color: yellow; padding: 2px 4px; border-radius: 3px;">'
CLOSE = "</mark>"


def _mark(text: str, terms) -> str:
    """Wrap the first free occurrence of each n-gram, longest n-grams first.

    Offsets refer to the original text, so marks never match later n-grams.
    """
    spans: list[tuple[int, int]] = []
    for gram in sorted(dict.fromkeys(terms), key=len, reverse=True):
        pattern = r"\b" + r"\s+".join(map(regex.escape, gram.split(" "))) + r"\b"
        for m in regex.finditer(pattern, text, regex.IGNORECASE):
            if all(m.end() <= a or m.start() >= b for a, b in spans):
                spans.append(m.span())
                break
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + OPEN + text[a:b] + CLOSE + text[b:]
    return text


def marker():
    """Column function ``(text, n-grams) -> text with marks``."""

    @F.pandas_udf("string")
    def mark(texts: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([_mark(t, g) for t, g in zip(texts, grams)])

    return mark


def highlight_results(results: DataFrame, corpus: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """Add ``highlighted_text`` to result lists of at most ``width`` rows per query."""
    grams = queries.select("query_id", word_ngrams(F.col("text")).alias("_grams"))
    fits = fits_broadcast(queries, max(1, BROADCAST_ROWS // width))
    rows = small_side(results, fits).join(corpus.select("id", "text"), "id").join(small_side(grams, fits), "query_id")
    return rows.withColumn("highlighted_text", marker()(F.col("text"), F.col("_grams"))).drop("_grams")


def highlight(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Best keyword hits of every query with their terms marked."""
    from ..functions.text import word_tokens
    from .bm25 import top

    found = top(corpus, queries, k, word_tokens)
    return highlight_results(found, corpus, queries, k).select("query_id", "id", "rank", "highlighted_text")
