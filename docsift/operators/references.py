"""Resolving citations in texts against a reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.citations import author_year_citations, numeric_citations
from ..functions.text import words
from ..session import localized, small_side
from .layout import unfold
from .numbering import staged
from .ranking import keep_first

GRAM = 3  # characters of a gram; shorter texts are looked for as a whole


def resolve_numeric(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` x ``refs(ordinal, …)``: citation n names the n-th reference."""
    cited = unfold(texts, ["doc_id"], numeric_citations(F.col("text")), "ordinal")
    return cited.join(refs, "ordinal")


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Every ``needle, hay`` with the needle inside the hay, each pair once; empty texts pair with nothing.

    A hay that holds a needle holds each of its grams, so one gram per needle finds all
    its hays. Each needle takes the gram that the fewest hays have, and a needle with a
    gram that no hay has leaves before the join.
    """
    n = needles.select("needle").filter("needle <> ''").distinct()
    h = hays.select("hay").filter("hay <> ''").distinct()
    own = unfold(n, ["needle"], _grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM))), "gram")
    every = F.flatten(F.array(*[_grams(F.col("hay"), F.lit(size)) for size in range(1, GRAM + 1)]))
    held = unfold(h, ["hay"], every, "gram")
    df = held.groupBy("gram").agg(F.count("*").alias("_df"))
    rarest = own.join(df, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "gram")).alias("r"))
    keys = rarest.filter("r.df > 0").select("needle", "r.gram")
    return keys.join(held, "gram").filter(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def author_year_of(texts: DataFrame) -> DataFrame:
    """``doc_id, at, author, year``: the author-year citations of ``texts(doc_id, text)`` by place."""
    rows = unfold(texts, ["doc_id"], author_year_citations(F.col("text")), "c", "at")
    return rows.select("doc_id", "at", F.col("c.author").alias("author"), F.col("c.year").alias("year"))


def first_references(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """``author, year, ordinal``: the first reference that matches each wanted author and year.

    Author texts match when one contains the other or a word of more than three letters of
    the citation occurs in the reference; a year matches a date that holds it or lies in it,
    and an empty date. References are reduced to the first of each author and date before
    anything is joined. An empty author lies in every other one.
    """
    wanted = wanted.select("author", "year", F.lower("author").alias("_low"))
    who, date = F.lower(F.coalesce("author", F.lit(""))), F.coalesce("date", F.lit(""))
    firsts = refs.groupBy(who.alias("_ref"), date.alias("_date")).agg(F.min("ordinal").alias("ordinal"))
    firsts = firsts.withColumn("_y", F.explode(_years("_date")))
    long_words = F.filter(words(F.col("_low")), lambda w: F.length(w) > 3)
    asked = unfold(wanted.select("_low").distinct(), ["_low"], F.array_distinct(F.concat(F.array("_low"), long_words)), "needle")
    authors = firsts.select(F.col("_ref").alias("hay"))
    inside = contained(asked, authors).join(asked, "needle").select("_low", F.col("hay").alias("_ref"))
    around = contained(authors.withColumnRenamed("hay", "needle"), wanted.select(F.col("_low").alias("hay")))
    pairs = inside.unionByName(around.select(F.col("hay").alias("_low"), F.col("needle").alias("_ref"))).distinct()
    # The year is part of the key: a date holds it, or has no year at all.
    years = wanted.withColumn("_y", F.explode(F.array("year", F.lit(""))))
    found = years.join(pairs, "_low").join(firsts, ["_ref", "_y"])
    # An empty author on either side needs the first reference of a date only.
    per_date = lambda rows: rows.groupBy("_y", "_date").agg(F.min("ordinal").alias("ordinal"))
    columns = ["author", "year", "_date", "ordinal"]
    found = found.select(*columns).unionByName(years.join(per_date(firsts.filter("_ref = ''")), "_y").select(*columns))
    found = found.unionByName(years.filter("_low = ''").join(per_date(firsts), "_y").select(*columns))
    hit = F.col("_date").contains(F.col("year")) | F.col("year").contains(F.col("_date"))
    return found.filter(hit).groupBy("author", "year").agg(F.min("ordinal").alias("ordinal"))


def _resolved(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """``cites(…, author, year)`` with the first reference's ``ordinal``, ``ref_title, ref_author, ref_date``, or nulls."""
    wanted, fits = localized(cites.select("author", "year").distinct())
    best = first_references(wanted, refs)
    named = best.join(refs.select("ordinal", F.col("title").alias("ref_title"), F.col("author").alias("ref_author"), F.col("date").alias("ref_date")), "ordinal")
    return cites.join(small_side(named, fits), ["author", "year"], "left")


def resolve_author_year(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """First reference per author-year citation (``first_references``), or a placeholder row.

    ``refs(ordinal, title, author, date)``.
    """
    rows = _resolved(staged(author_year_of(texts)), refs)
    return rows.select("doc_id", "author", "year", "ordinal", _title().alias("title"), _kind().alias("source_type"))


def used_references(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """The reference list of each text: ``doc_id, place, ordinal, title, author, date, source_type``.

    Numbers come first, ascending, then author-year citations by place; of entries with an
    equal title and author (ignoring case; a missing one is empty) the first stays. A number
    without a reference is left out, an author without one becomes a placeholder. A text
    without any citation uses the whole list: it has one row at place 0 that stands for it
    (``source_type`` ``all references``), as long as there are references. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    whole = staged(texts.select("doc_id", numeric_citations(text).alias("n"), author_year_citations(text).alias("c")))
    numbers = unfold(whole, ["doc_id"], F.col("n"), "ordinal").join(refs.select("ordinal", "title", "author", "date"), "ordinal")
    numbers = numbers.select("doc_id", F.lit(0).alias("_part"), F.col("ordinal").alias("_at"), "ordinal", "title", "author", "date", F.lit("reference").alias("source_type"))
    cites = unfold(whole, ["doc_id"], F.col("c"), "_c", "at").select("doc_id", "at", "_c.author", "_c.year")
    named = _resolved(cites, refs)
    known = F.col("ordinal").isNotNull()
    named = named.select(
        "doc_id", F.lit(1).alias("_part"), F.col("at").cast("long").alias("_at"), "ordinal", _title().alias("title"),
        F.when(known, F.col("ref_author")).otherwise(F.col("author")).alias("author"),
        F.when(known, F.col("ref_date")).otherwise(F.col("year")).alias("date"), _kind().alias("source_type"))
    rows = numbers.unionByName(named)
    same = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("title", "author")]
    rows = keep_first(rows.select("*", *same), ["doc_id", "_title", "_author"], [F.col("_part"), F.col("_at")])
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("_part", "_at")))
    columns = ["doc_id", "place", "ordinal", "title", "author", "date", "source_type"]
    bare = whole.filter((F.size("n") == 0) & (F.size("c") == 0)).join(refs.select(F.lit(1)).limit(1), how="left_semi")
    none = {c: F.lit(None).cast(t) for c, t in rows.select("ordinal", "title", "author", "date").dtypes}
    bare = bare.select("doc_id", F.lit(0).alias("place")).withColumns({**none, "source_type": F.lit("all references")})
    return rows.select(*columns).unionByName(bare.select(*columns))


def _title() -> Column:
    return F.when(F.col("ordinal").isNull(), F.concat(F.lit("Research paper by "), "author")).otherwise(F.col("ref_title"))


def _kind() -> Column:
    return F.when(F.col("ordinal").isNull(), "placeholder").otherwise("reference")


def _years(date: str) -> Column:
    """Every four digits in a row of a date; an empty text where there are none."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(date), F.lit("")), F.lit(r"(?=(\d{4}))"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _grams(c: Column, n: Column) -> Column:
    """The different substrings of ``n`` characters."""
    last = F.length(c) - n + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, n)))
