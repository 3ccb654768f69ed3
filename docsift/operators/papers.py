"""Academic papers: relevance ranking and source merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import words
from .ranking import fixed, keep_first

# Venues that earn a bonus.
VENUES = "neurips icml iclr acl emnlp naacl aaai ijcai jmlr tacl".split()


def paper_score(topic: Column, current_year: int, min_year: int = 2020, recent: bool = True) -> Column:
    """Recency .4, citations .2, word overlap .4, venue .1; papers before ``min_year`` lose .2."""
    year, cites = F.col("year"), F.coalesce("citation_count", F.lit(0))
    age = F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(current_year) - year) / 10.0)
    recency = F.when(year < min_year, -0.2)
    if recent:
        recency = recency.when(year >= min_year, age * 0.4)
    cited = F.when(cites > 0, F.least(F.lit(1.0), F.log10(cites + 1) / 3.0) * 0.2).otherwise(0.0)
    wanted = F.array_distinct(words(F.lower(topic)))

    def overlap(ws: Column) -> Column:
        return F.size(F.array_intersect(wanted, ws)) / F.greatest(F.size(wanted), F.lit(1))

    title = overlap(words(F.lower(F.coalesce("title", F.lit("")))))
    abstract = overlap(words(F.lower(F.coalesce("abstract", F.lit("")))))
    venue = F.lower(F.coalesce("venue", F.lit("")))
    bonus = F.when(reduce(lambda a, b: a | b, [venue.contains(v) for v in VENUES]), 0.1).otherwise(0.0)
    return fixed(F.coalesce(recency, F.lit(0.0)) + cited + (title * 0.6 + abstract * 0.4) * 0.4 + bonus)


def merge_sources(parts: list[DataFrame], key: str) -> DataFrame:
    """Stack source lists; of rows with the same key (ignoring case) the first list's first row stays.

    Each part needs ``id``; earlier parts win.
    """
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = keep_first(rows.withColumn("_key", F.md5(F.lower(key))), ["_key"], [F.col("_part"), F.col("id")])
    return rows.drop("_key", "_part")


def era(end_year: int) -> Column:
    return F.when(F.col("year") >= end_year - 1, "Recent").otherwise("Foundational")
