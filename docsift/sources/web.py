"""Web results from stored pages and raw engine rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clip, strip
from ..functions.web import domain, page_snippet, page_title


def from_pages(pages: DataFrame) -> DataFrame:
    """Engine rows read from ``pages(page_id, url, html)``."""
    return pages.select(
        F.col("page_id").alias("id"), "url", page_title(F.col("html")).alias("title"),
        page_snippet(F.col("html")).alias("snippet"),
    )


def normalised(raw: DataFrame, chars: int | None = None) -> DataFrame:
    """One result shape from rows whose fields go by different names.

    Snippets stay whole for ranking; ``chars`` clips them for display.
    """

    def first(*names: str):
        have = [F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*have, F.lit(""))

    title, url = first("title", "heading", "name"), first("href", "url", "link")
    snippet = strip(first("body", "snippet", "abstract", "description"))
    snippet = snippet if chars is None else clip(snippet, chars)
    keep = (title != "") | ((url != "") & (snippet != ""))
    return raw.filter(keep).select(
        "id", F.when(title == "", url).otherwise(title).alias("title"), url.alias("url"),
        snippet.alias("snippet"), F.lit("web").alias("source"), F.lit("web_search").alias("source_type"),
        domain(url).alias("domain"), F.lit("").alias("author"), F.lit("").alias("date"),
        domain(url).alias("publication"),
    )


def result_text(df: DataFrame, *keep: str) -> DataFrame:
    """``id, text`` and the columns ``keep`` for ranking: title and snippet, or the URL when both are empty."""
    both = strip(F.concat(F.col("title"), F.lit(". "), F.col("snippet")))
    return df.select("id", F.when(both == "", F.col("url")).otherwise(both).alias("text"), *keep)
