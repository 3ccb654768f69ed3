"""Reading what a language model answered: rank lists, scores, JSON, final answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def rank_order(response: Column, n: Column) -> Column:
    """Chunk positions (from 0) in the order a response lists them, the rest appended."""
    digits = F.regexp_extract_all(response, F.lit(r"(\d+)"), F.lit(1))
    numbers = F.transform(digits, lambda d: F.try_cast(d, "long") if hasattr(F, "try_cast") else d.try_cast("long"))
    listed = F.transform(F.filter(numbers, lambda x: (x >= 1) & (x <= n)), lambda x: x - 1)
    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return F.when(n > 0, F.array_union(listed, every)).otherwise(F.array().cast("array<bigint>"))


def position_score(order: Column, position: Column) -> Column:
    """Score of the chunk at a place (from 0) in a rank list: first 1, last 1/n."""
    return (F.size(order) - position) / F.size(order)


def point_score(response: Column, base: Column) -> Column:
    """The first score a response names, or the base score."""
    found = F.nullif(F.regexp_extract(strip(response), r"0?\.\d+|1\.0|0", 0), F.lit(""))
    return F.coalesce(found.try_cast("double"), base)


def failure_score(position: Column) -> Column:
    """Scores when no response came: 1.0, 0.9, 0.8 …"""
    return F.lit(1.0) - F.lit(0.1) * position


def fenced_json(response: Column) -> Column:
    """JSON text without the code fence around it."""
    tagged = F.nullif(F.regexp_extract(response, r"(?s)```json(.*?)```", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(response, r"(?s)```(.*?)```", 1), F.lit(""))
    return strip(F.coalesce(tagged, plain, response))


def final_answer(response: Column) -> Column:
    return strip(F.substring_index(response, "Final Answer:", -1))
