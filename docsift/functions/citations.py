"""Citations, BibTeX keys and reference formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import non_empty, strip, words

# Words that cannot open a BibTeX title part.
TITLE_SKIP = "the a an on in for of and or".split()


def numeric_citations(c: Column) -> Column:
    """Distinct numbers cited as ``[n]`` or ``[n, m]``, ascending."""
    groups = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    digits = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: d.cast("long"))))


AUTHOR_YEAR = r"(?i)\[([^,\]]+(?:\s+et\s+al\.?)?)\s*,\s*(\d{4})\]"


def author_year_citations(c: Column) -> Column:
    authors = F.regexp_extract_all(c, F.lit(AUTHOR_YEAR), F.lit(1))
    years = F.regexp_extract_all(c, F.lit(AUTHOR_YEAR), F.lit(2))
    return F.zip_with(authors, years, lambda a, y: F.struct(strip(a).alias("author"), y.alias("year")))


def last_year(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(\d{4})"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def bibtex_key(author: Column, year: Column, title: Column) -> Column:
    first = F.get(words(F.substring_index(author, ",", 1)), F.lit(0))
    who = F.coalesce(F.replace(F.lower(first), F.lit("."), F.lit("")), F.lit("unknown"))
    head = F.filter(F.slice(words(title), 1, 3), lambda w: ~F.lower(w).isin(TITLE_SKIP))
    what = F.coalesce(F.substring(F.lower(F.get(head, F.lit(0))), 1, 8), F.lit(""))
    return F.substring(F.translate(F.concat(who, last_year(year), what), " -", ""), 1, 50)


def bibtex_entry(key: Column, author: Column, title: Column, year: Column, venue: Column, url: Column) -> Column:
    low = F.lower(venue)
    meeting = low.rlike("conference|workshop|proceedings") & ~(low.contains("arxiv") | F.lower(url).contains("arxiv"))

    def field(name: Column, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit("  "), name, F.lit("={"), value, F.lit("}")))

    fields = F.array_compact(F.array(
        F.concat(F.lit("  title={"), title, F.lit("}")),
        field(F.lit("author"), author),
        field(F.lit("year"), last_year(year)),
        field(F.when(meeting, "booktitle").otherwise("journal"), venue),
        field(F.lit("url"), url),
    ))
    kind = F.when(meeting, "@inproceedings").otherwise("@article")
    return F.concat(kind, F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def human_citation(author: Column, title: Column, venue: Column, year: Column) -> Column:
    y = last_year(year)
    parts = F.array_compact(F.array(
        F.nullif(author, F.lit("")),
        F.when(y != "", F.concat(F.lit("("), y, F.lit(")"))),
        F.when(title != "", F.concat(F.lit('"'), title, F.lit('"'))),
        F.when(venue != "", F.concat(F.lit(", "), venue)),
    ))
    return F.concat(F.array_join(parts, ", "), F.lit("."))


def normalize_authors(arr: Column) -> Column:
    return non_empty(F.transform(arr, strip))
