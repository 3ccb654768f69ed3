"""Fixed windows: paragraphs, word windows, character windows, sentences, turns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...functions.binding import let, part
from ...functions.text import words


def word_windows(c: Column, size: int | Column = 500, overlap: float = 0.15) -> Column:
    """Windows of ``size`` words that share ``overlap`` of their length; short tails stay."""
    n = F.lit(size) if isinstance(size, int) else size
    step = n - F.floor(n * F.lit(overlap)).cast("int")

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws), step)
        joined = F.transform(starts, lambda s: F.array_join(part(ws, s, n), " "))
        return F.when(F.size(ws) > 0, joined).otherwise(F.array().cast("array<string>"))

    return let(words(c), windows)


def char_windows(c: Column, size: int = 512, overlap: int = 50) -> Column:
    """Character windows ``size - overlap`` apart; the last one may hold the overlap only.

    The text is cut once into steps and each window borrows the head of the next
    step, so the work stays linear in the text (a substring per window would not).
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("overlap must not exceed half of the window")
    steps = F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    full = F.when(F.length(c) >= size, F.floor((F.length(c) - size) / step) + 1).otherwise(0)

    def windows(pieces: Column) -> Column:
        def window(k: Column) -> Column:
            head = F.coalesce(F.get(pieces, k.cast("int")), F.lit(""))
            tail = F.substring(F.get(pieces, (k + 1).cast("int")), 1, overlap)
            return F.concat(head, F.coalesce(tail, F.lit("")))

        return F.transform(F.sequence(F.lit(0).cast("long"), full), window)

    return F.when(F.length(c) > 0, let(steps, windows)).otherwise(F.array().cast("array<string>"))


def page_of(start: Column, length: Column, pages: Column) -> Column:
    """Page at a text offset: the page list is stretched over the text."""
    at = F.least(F.floor(start / F.nullif(length, F.lit(0)) * F.size(pages)), F.size(pages) - 1)
    return F.when(F.size(pages) > 0, F.get(pages, at.cast("int")))
