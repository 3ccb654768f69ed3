"""Memory of the steps of a task, apart from Spark."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from docsift.llm import phrases
from docsift.llm.bpe import unpack


def _chunks(n: int, words: int = 16) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{w}" for w in row) for row in rng.integers(0, 5000, (n, words))]
    return pa.RecordBatch.from_arrays(
        [pa.array(["en"] * n), pa.array([False] * n), pa.array(text), pa.array(np.full(n, words, np.int32)), pa.array(np.full(n, 3))], ["lang", "led", "chunk", "new", "n"])


def _sums(found) -> dict[int, int]:
    sums: dict[int, int] = {}
    for batch in found:
        for r in batch.to_pylist():
            for key, times in zip(np.cumsum(unpack(r["steps"]), dtype=np.int64).tolist(), unpack(r["times"]).tolist()):
                sums[r["part"], key] = sums.get((r["part"], key), 0) + times
    return sums


def test_phrase_blocks_are_small():
    batch = _chunks(180_000)  # 15 MB
    batches = [batch.slice(at, 10_000) for at in range(0, len(batch), 10_000)]
    tracemalloc.start()
    try:
        for _ in phrases.bucket_counts(24)(iter(batches)):
            pass
        peak = tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()
    assert peak < 250, peak


@pytest.mark.parametrize("block, held", [(1, 1), (1 << 12, 1 << 30), (1 << 30, 1)])
def test_bucket_sums_do_not_depend_on_blocks(monkeypatch, block, held):
    batch = _chunks(300)
    batches = [batch.slice(at, 50) for at in range(0, len(batch), 50)]
    whole = _sums(phrases.bucket_counts(18)(iter([batch])))
    assert sum(whole.values()) == 300 * 3 * (15 + 14 + 13)
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "HELD", held)
    assert _sums(phrases.bucket_counts(18)(iter(batches))) == whole
