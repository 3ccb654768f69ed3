"""Sequence numbers over whole tables and what hangs on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ensure_checkpoint_dir, fits_broadcast, small_side

_PART = 33  # bits below the task number in monotonically_increasing_id


def staged(df: DataFrame) -> DataFrame:
    """Write a result once that several later steps read, so it is not computed again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), start: int = 1,
                out: str = "chunk_number") -> DataFrame:
    """Gap-free numbers in ``order`` (unique within a group), over all rows or within groups.

    The rows are range-sorted once on group and order, so even a group that holds
    most rows spreads over many tasks. Each row gets its place in its task and the
    result is staged; the places are then shifted by the rows of the tasks before,
    which needs one count per task only. Within groups the number of the group's
    first row is taken off.
    Pass the keys of wide rows only, and join the rest to the numbers.
    """
    by = list(by)
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(ranged.withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_task": F.shiftright("_m", _PART), "_at": F.col("_m").bitwiseAND(2**_PART - 1)})
    counts = rows.groupBy("_task").agg(F.count("*").alias("_n"))
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # One row per task of the range sort.
    rows = rows.join(F.broadcast(shifts), "_task").withColumn("_g", F.col("_shift") + F.col("_at"))
    if by:
        firsts = rows.groupBy(*by).agg(F.min("_g").alias("_first"))
        rows = rows.join(firsts, by).withColumn("_g", F.col("_g") - F.col("_first"))
    drop = ["_m", "_task", "_at", "_shift", "_g", "_first"]
    return rows.withColumn(out, (F.col("_g") + start).cast("long")).drop(*drop)


def running_totals(sizes: DataFrame, keys: Sequence[str], n: str, out: str = "before") -> DataFrame:
    """``sizes`` with the sum of ``n`` over all rows that come before in the order of ``keys`` (unique).

    Two levels: rows are range-sorted and summed within their task, and the tasks' totals,
    one row each, are summed on top. The staged table has one row per group, not per member.
    Without a size (null), a group counts as empty.
    """
    keys = list(keys)
    ranged = staged(sizes.repartitionByRange(*keys).withColumn("_task", F.spark_partition_id()))
    inside = W.partitionBy("_task").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    tasks = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = ranged.groupBy("_task").agg(F.sum(n).alias("_t")).select("_task", F.coalesce(F.sum("_t").over(tasks), zero).alias("_shift"))
    rows = ranged.withColumn("_in", F.coalesce(F.sum(n).over(inside), zero))
    # One row per task of the range sort.
    return rows.join(F.broadcast(totals), "_task").withColumn(out, F.col("_shift") + F.col("_in")).drop("_task", "_in", "_shift")


def number_pieces(sizes: DataFrame, keys: Sequence[str], n: str = "n", pos: str = "pos", start: int = 1,
                  first: int = 1, out: str = "chunk_number") -> DataFrame:
    """A row per piece with its place and number, from the number of pieces per group.

    Pieces have places ``first``, ``first + 1``, … in their group, so their keys follow from
    its size: groups get the pieces before them (``running_totals``) and are unfolded after
    that. No row of a piece is sorted, shuffled or staged. Empty groups have no rows.
    """
    rows = running_totals(sizes.filter(F.col(n) > 0), keys, n, "_before")
    rows = rows.select(*keys, "_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("_i"))
    return rows.select(*keys, (F.col("_i") + first).alias(pos), (F.col("_before") + F.col("_i") + start).alias(out))


def _gaps() -> Column:
    return F.col("_hi") - F.col("_lo") + 1 != F.col("_n")


def _sizes(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return staged(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi")))


def _starts(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's first place, the rows of the groups before it, and whether its places have gaps."""
    return running_totals(sizes, keys, "_n", "_before").select(*keys, "_lo", "_before", _gaps().alias("_gaps"))


def number_members(rows: DataFrame, keys: Sequence[str], pos: str, start: int = 1, out: str = "chunk_number") -> DataFrame:
    """``rows`` (staged, read twice) numbered in the order of ``keys`` and ``pos``, without gaps.

    Where places are gap-free in their group, a row's number is its place after the groups
    before it, so only the table of groups is sorted and joined. Rows of other groups are
    sorted by their keys (``number_rows``). ``pos`` is unique in its group, keys are not null.
    """
    keys = list(keys)
    sizes = _sizes(rows, keys, pos)
    gaps, groups = _gaps(), _starts(sizes, keys)
    found = rows.join(small_side(groups, fits_broadcast(sizes)), keys)
    place = F.col(pos) - F.col("_lo")
    if not sizes.filter(gaps).isEmpty():
        some = number_rows(found.filter("_gaps").select(*keys, pos), [pos], keys, start=0, out="_place")
        found = found.filter("NOT _gaps").withColumn("_place", place).unionByName(found.filter("_gaps").join(some, [*keys, pos]))
        place = F.col("_place")
    return found.withColumn(out, (F.col("_before") + place + start).cast("long")).drop("_lo", "_before", "_gaps", "_place")


def group_starts(rows: DataFrame, deal: str, group: str, pos: str) -> DataFrame:
    """``deal, _starts``: where each group of ``deal`` begins, as ``number_members`` finds it (read once)."""
    keys = [deal, group]
    found = _starts(_sizes(rows, keys, pos), keys)
    return found.groupBy(deal).agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct("_before", "_lo", "_gaps")))).alias("_starts"))


def number_dealt(rows: DataFrame, deal: str, group: str, pos: str, start: int = 1, out: str = "chunk_number",
                 linked: str | None = None, also: tuple[str, str, Callable] | None = None) -> DataFrame:
    """``rows`` numbered as ``number_members`` does by ``[deal, group]`` and ``pos``, but where they are.

    They bring ``_starts``, and rows of a ``deal`` follow each other in one task. So a row's place in its
    group, and the clause it hangs on (``resolve_parents`` among the rows of a ``deal`` with the same
    ``linked``), are found as the rows pass, and these are neither staged, sorted nor moved.
    ``also`` names a column, its type, and what makes a function that derives it from a table of rows.
    """
    own = F.element_at("_starts", F.col(group))
    kept = [c for c in rows.columns if c != "_starts"]
    rows = rows.select(*kept, own.alias("_own")).select(*kept, "_own._before", "_own._lo", "_own._gaps")
    fields = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*kept).dtypes) + f", `{out}` long" + ", parent_chunk_number long" * bool(linked)
    fields += f", `{also[0]}` {also[1]}" if also else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = also[2]() if also else None
        for table in _whole(batches, deal):
            column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
            doc = np.cumsum(_changes(table.column(deal)))
            kind, at = column(group).astype(np.int64), column(pos).astype(np.int64)
            order = np.lexsort((at, kind, doc))
            new = lambda *xs: np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in xs], axis=0)])
            place, first = np.arange(len(order)), np.flatnonzero(new(doc, kind))
            place -= np.repeat(first, np.diff([*first, len(order)]))
            # Equal places only occur where the key repeats; such rows get all of their places, as from a join.
            tie = np.flatnonzero(new(doc, kind, at))
            ties = np.diff([*tie, len(order)])
            lowest, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            lowest[order], many[order] = np.repeat(place[tie], ties), np.repeat(ties, ties)
            gaps = column("_gaps").astype(bool)
            many = np.where(gaps, many, 1)
            row = np.repeat(np.arange(len(order)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            number = (column("_before") + np.where(gaps, lowest, at - column("_lo")))[row] + nth + start
            found = table.select(kept) if len(row) == len(order) else table.select(kept).take(pa.array(row))
            found = found.append_column(out, pa.array(number, pa.int64()))
            if linked:
                found = found.append_column("parent_chunk_number", _parents(doc[row], found.column(linked), found.column("clause_number"), found.column("parent"), number))
            if derive:
                found = found.append_column(also[0], derive(found))
            yield from found.to_batches()

    return rows.mapInArrow(run, fields)


def _changes(keys: pa.ChunkedArray) -> np.ndarray:
    """Where a key differs from the one before."""
    keys = keys.combine_chunks()
    return np.concatenate([[False], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches cut so that rows of a key, which follow each other, are in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        other = np.flatnonzero(pc.not_equal(keys, keys[-1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(key)[-1] != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _parents(doc: np.ndarray, linked: pa.ChunkedArray, clause: pa.ChunkedArray, parent: pa.ChunkedArray, number: np.ndarray) -> pa.Array:
    """The highest number of the rows of a document (and of equal ``linked``) with the clause that is a row's parent."""
    n = len(number)
    code = pa.chunked_array([*clause.chunks, *parent.chunks], pa.string()).combine_chunks().dictionary_encode().indices
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = linked.combine_chunks().dictionary_encode()
    group = doc * len(kinds.dictionary) + kinds.indices.to_numpy(zero_copy_only=False)
    width = int(code.max(initial=0)) + 1
    own = np.flatnonzero(code[:n] >= 0)
    keys, numbers = group[own] * width + code[:n][own], number[own]
    order = np.lexsort((numbers, keys))
    keys, numbers = keys[order], numbers[order]
    wanted = group * width + code[n:]
    at = np.searchsorted(keys, wanted, "right") - 1
    hit = (code[n:] >= 0) & (at >= 0)
    hit[hit] = keys[at[hit]] == wanted[hit]
    return pa.array(numbers[at] if len(numbers) else np.zeros(n, np.int64), pa.int64(), mask=~hit)


def max_number(col: str = "chunk_number") -> Column:
    """Aggregate: highest chunk number, 0 when there is none; negative and other values don't count."""
    n = F.col(col).try_cast("long")
    return F.coalesce(F.max(F.when(n >= 0, n)), F.lit(0).cast("long"))


def next_number() -> Column:
    """Aggregate: the number after the highest one; 0 for an empty table."""
    n = F.coalesce(F.col("chunk_id").try_cast("long"), F.col("chunk_number").try_cast("long"))
    return F.coalesce(F.max(n) + 1, F.lit(0).cast("long"))


def resolve_parents(chunks: DataFrame) -> DataFrame:
    """Turn a parent clause into the number of the chunk that last defined it."""
    owners = chunks.filter(F.col("clause_number").isNotNull()).groupBy("doc_id", "clause_number").agg(
        F.max("chunk_number").alias("parent_chunk_number")
    ).withColumnRenamed("clause_number", "parent")
    # Few chunks have a parent, and only those move.
    found = chunks.filter(F.col("parent").isNotNull()).join(owners, ["doc_id", "parent"], "left")
    return chunks.filter(F.col("parent").isNull()).withColumn("parent_chunk_number", F.lit(None).cast("long")).unionByName(found)


def fill_missing(df: DataFrame, by: list[str], order: list[str], col: str = "chunk_number") -> DataFrame:
    """Number rows without a number after the highest one of their group, in ``order``."""
    df = staged(df)
    top = df.groupBy(*by).agg(F.coalesce(F.max(col), F.lit(-1)).alias("_top"))
    have = df.filter(F.col(col).isNotNull())
    lack = number_rows(df.filter(F.col(col).isNull()), order, by, out="_nth")
    filled = lack.join(top, by).withColumn(col, F.col("_top") + F.col("_nth")).drop("_top", "_nth")
    return have.unionByName(filled)

