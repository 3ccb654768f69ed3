"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash. A source takes its documents whole times first and
then those with a hash up to a threshold. The threshold comes from nested histograms:
words by source and the hash's first 12 bits show the bucket in which the budget ends,
only that bucket's documents are counted by the next 12 bits, and what is left (one in
16 million) by the hash itself. Documents are filtered by comparing a number; they are
never sorted, and a source with a third of all rows is only ever summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import WORD, small, staged

HASH_DIGITS = 15  # hexadecimal digits of the digest, 60 bits
FINE_BITS = (48, 36)  # bits below the first and the second histogram's buckets


def n_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: str, text: str) -> Column:
    """The document's hash, the same in every run: from 0 to 2^60 - 1."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``_source, source_size, target``: one row per source.

    Targets are the shares by weight of ``share`` times all words; what exceeds
    ``limit`` times a source's size goes to the others by weight, until none is above.
    That ends at min(limit, level * weight) with one level for all. With the sources in
    order of limit / weight, the level that follows from capping the first i sources
    rises as long as capping is right and falls afterwards, so it is the largest.
    """
    each = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    before = W.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    each = each.withColumns({"_weight": weight, "_limit": limit * F.col("source_size")}).withColumn("_level", level)
    target = F.least(F.col("_limit"), F.col("_weight") * F.max("_level").over(everything))
    return each.select("_source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``_source, source_size, target, _times, _upto``: how often a source's documents are
    all taken, and the hash up to which they are taken once more (-1: none)."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_times", times).withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size"))
    plan, above = staged(plan), 60
    left = small(plan.filter("_rest > 0").select("_source", "_rest", F.lit(0).cast("long").alias("_edge")))
    for bits in (*FINE_BITS, 0):
        inside = sizes.filter("size > 0").withColumn("_bucket", F.shiftright("_hash", above))
        rows = inside.alias("r").join(left.alias("l"), F.expr("r._source <=> l._source AND _bucket = _edge"))
        rows, above = rows.select("r._source", "size", "_rest", F.shiftright("_hash", bits).alias("_at")), bits
        counts = rows.groupBy("_source", "_at").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"))
        upto = F.sum("_n").over(W.partitionBy("_source").orderBy("_at"))
        # The bucket in which the budget ends, and what the buckets before it leave.
        edge = counts.withColumn("_upto", upto).filter("_upto >= _rest AND _upto - _n < _rest")
        if bits:
            left = edge.select("_source", F.col("_at").alias("_edge"), (F.col("_rest") - (F.col("_upto") - F.col("_n"))).alias("_rest"))
            left = small(staged(left))
    # The last documents are taken if that comes nearer to the budget than leaving them.
    nearer = F.col("_upto") - F.col("_rest") <= F.col("_rest") - (F.col("_upto") - F.col("_n"))
    ends = edge.select(F.col("_source"), F.when(nearer, F.col("_at")).otherwise(F.col("_at") - 1).alias("_end"))
    out = plan.join(ends, plan["_source"].eqNullSafe(ends["_source"]), "left").select(plan["_source"], "source_size", "target", "_times", F.coalesce("_end", F.lit(-1)).alias("_upto"))
    return small(staged(out))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` counts words; ``weights`` repeat over the sources in code point order, null
    last; ``share`` is the mix's size as a part of all words; ``limit`` is how often a
    source may be repeated at most. ``taken`` is ``copies * size``. A source's taken words
    miss its target by half of one document at most (by half of a group of equal rows,
    which share their hash and so are taken or left together).

    Null texts and texts without words have size 0 and cost nothing. A null id hashes as
    an empty one, a null source is a source of its own. An empty table gives no rows.
    Columns of ``docs`` that bear one of the new names are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    keys = docs.select(F.col(source).alias("_source"), n_words(text).alias("size"), place(doc_id, text).alias("_hash"))
    sizes = staged(keys)
    found = thresholds(sizes, targets(sizes, weights, share, limit)).withColumnRenamed("_source", "_of")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in new]).withColumns({"size": n_words(text), "_hash": place(doc_id, text)})
    rows = rows.join(found, rows[source].eqNullSafe(found["_of"]))
    copies = F.col("_times") + (F.col("_hash") <= F.col("_upto")).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("_hash", "_of", "_times", "_upto")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    rows = mix(rows, doc_id=own["doc_id"], text=own["text"], source=own["source"], **options).filter("copies > 0")
    return rows.select(F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))), *own.values()).select(
        *[F.col(n).alias(c) for c, n in own.items()])
