"""Web results: domains, source classes, URL checks, reference lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import clip, strip, strip_tags

# Domains by source class, in match order.
SOURCE_CLASSES = [
    ("LinkedIn", ["linkedin.com"]),
    ("Academic", ["researchgate.net", "sciencedirect.com", "arxiv.org"]),
    ("News", ["bbc.com", "cnn.com", "reuters.com", "nytimes.com"]),
]
LOW_QUALITY_DOMAINS = ["spam.com", "advertising.com"]

# The accepted URL shape.
URL = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)


def domain(url: Column) -> Column:
    """Host part without ``www.`` and port."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ":", 1)


def source_class(dom: Column) -> Column:
    out = None
    for name, hosts in SOURCE_CLASSES:
        hit = reduce(lambda a, b: a | b, [dom.contains(h) for h in hosts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(dom.endswith(".pdf"), "PDF/Paper").otherwise("Web")


def is_valid_url(url: Column) -> Column:
    return url.rlike(URL)


def unwrap_redirect(url: Column) -> Column:
    """Target of a search engine's redirect link, percent-decoded."""
    ddg = F.nullif(F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1), F.lit(""))
    goog = F.nullif(F.regexp_extract(url, r"/url\?q=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(ddg), F.try_url_decode(goog), url)


def page_title(html: Column) -> Column:
    return strip(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_snippet(html: Column) -> Column:
    return strip(strip_tags(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)))


def reference_line(n: Column, title: Column, url: Column, publication: Column, snippet: Column) -> Column:
    """One numbered entry of a reference list for a web source."""

    def part(label: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"\n  {label}: "), c)).otherwise(F.lit(""))

    return F.concat(
        F.lit("["), n.cast("string"), F.lit("] **"),
        F.when(title == "", "Untitled").otherwise(title), F.lit("**"),
        F.lit("\n  URL: "), F.when(url == "", "Not available").otherwise(url),
        part("Publication", publication), part("Summary", clip(snippet, 200)),
    )
