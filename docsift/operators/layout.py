"""How rows are spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


# Bytes of a task of an input that is dealt anew, and how many tasks an estimate may ask for.
TASK, TASKS = 8 << 20, 4_000
# Spark's estimate where it has none.
UNKNOWN = 2**62


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input to tasks of bounded size, before heavy per-row work.

    A table in one file arrives in as many tasks as it has row groups, which leaves cores
    idle if it is small and makes a task as long as its row group if it is large. Every
    input is therefore dealt anew, once, in tasks of about TASK bytes as they are stored,
    and in no fewer than there are cores. The estimate is the optimizer's; nothing is run for
    it, and rows without one (made by the session, not read) stay where they are, as do
    those that were dealt in as many tasks before.
    """
    n = tasks(df)
    return df if n is None or _dealt(df._jdf.queryExecution().optimizedPlan()) >= n else df.repartition(n, *keys)


def together(df: DataFrame, key: str) -> DataFrame:
    """As ``spread``, but in any case with the rows of a key in one task."""
    n = tasks(df)
    return df.repartition(key) if n is None else df.repartition(n, key)


def tasks(df: DataFrame) -> int | None:
    """Tasks for an input of the optimizer's estimate, None where it has none."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    # A projection of an unknown size looks like a known one, so the estimates of what is read count.
    if any(_bytes(leaves.apply(i)) >= UNKNOWN for i in range(leaves.size())):
        return None
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-_bytes(plan) // TASK), TASKS))


def _bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def _dealt(plan) -> int:
    """How many tasks the rows were dealt to, 0 if they were not; staged rows were before they were written."""
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    if plan.nodeName() == "RepartitionByExpression" and plan.optNumPartitions().isDefined():
        return plan.optNumPartitions().get()
    return plan.rdd().getNumPartitions() if plan.nodeName() == "LogicalRDD" else 0


def unfold(df: DataFrame, keep: list, array: Column | str, item: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with its place from 0 when ``pos`` is given.

    A plain explode makes the optimizer test the array for emptiness below it, which
    computes an expensive array twice (and before a shuffle, in fewer tasks). The
    outer form does not, and the row of an empty array is dropped afterwards.
    """
    place = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)


def bounded(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices with about ``most`` bytes or list elements of ``column``; a larger row stands alone.

    Batches come by rows, so long texts make large ones, and what a task derives from one is larger still.
    """
    values = batch.column(column)
    size = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    for lo, hi in cuts(pc.fill_null(size(values), 0).to_numpy(zero_copy_only=False).astype(np.int64), most):
        yield batch.slice(lo, hi - lo)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows that add up to ``most`` at most; a larger row stands alone."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi
