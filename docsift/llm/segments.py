"""Splitting and hashing of whole text columns in numpy.

A column's texts lie in one buffer. Segments (words, pre-tokens) are found by comparing
neighbouring characters' classes, and all of them are hashed with two running sums: the
sum over a segment, divided by the multiplier's power at its start, depends on the segment
alone. One sum is modulo 2^64 with an odd multiplier. Regular words can defeat that (two
long Thue-Morse words over the same letters have one sum, whatever the multiplier), so the
other is modulo a prime, where they don't. Work goes through pieces of bounded size, so a
very long text needs no more memory than a few short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE = 1 << 17  # characters hashed at a time
STRETCH = 1 << 22  # bytes of texts whose words are held at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PRIME, _BASE = (1 << 31) - 1, 1_220_703_125
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole (splitmix64's finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n, PIECE) + 1
        for name, step in (("up", _STEP), ("down", _BACK)):
            a = np.full(size, step, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo the prime."""
    if "prime" not in _powers or len(_powers["prime"]) <= n:
        size = max(n, PIECE) + 1
        for name, step in (("prime", _BASE), ("inverse", pow(_BASE, -1, _PRIME))):
            a = np.ones(1, np.uint64)
            while len(a) < size:  # twice as many each time
                a = np.concatenate([a, a * np.uint64(pow(step, len(a), _PRIME)) % np.uint64(_PRIME)])
            _powers[name] = a[:size]
    return _powers["prime"][: n + 1], _powers["inverse"][: n + 1]


def prime_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The second sum of ``hashes``: 31 bits for each segment."""
    up, down = prime_powers(len(values))
    prime, sums = np.uint64(_PRIME), np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values >> np.uint64(33)) * up[: len(values)] % prime, out=sums[1:])  # below 2^31 each
    return (sums[ends] - sums[starts]) % prime * down[starts] % prime


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the places where they begin and end; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if not pa.types.is_large_binary(texts.type) else texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return whole, at - at[0]


def stretches(texts: pa.Array, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each; a longer text stands alone."""
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def runs(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a border."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = borders[(borders > 0) & (borders < n)]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of ``values`` (64-bit numbers); its length counts."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    first = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mixed(first + mixed(prime_sums(values, starts, ends) + _STEP))


def byte_values(lower: bool) -> np.ndarray:
    """A random number for every byte; A-Z as a-z if ``lower``."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        table[65:91] = table[97:123]
    return table


class Words:
    """Words of a text column: ``doc`` (row), ``hash``, ``start``, ``end`` (bytes in ``data``)."""

    def __init__(self, texts: pa.Array, separators: np.ndarray, lower: bool = True):
        self.data, self.at = buffer_of(texts)
        table, inside = byte_values(lower), ~separators
        found = [(lo + s, lo + e, hashes(table[piece], s, e)) for lo, piece, s, e in self._pieces(inside)]
        none = np.zeros(0, np.int64)
        self.start = np.concatenate([f[0] for f in found]) if found else none
        self.end = np.concatenate([f[1] for f in found]) if found else none
        self.hash = np.concatenate([f[2] for f in found]) if found else none.astype(np.uint64)
        # Words of row i are first[i] .. first[i + 1] - 1.
        self.first = np.searchsorted(self.start, self.at, "left")
        self.first[-1] = len(self.start)

    def _pieces(self, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        lo, n = 0, len(self.data)
        while lo < n:
            hi = min(lo + PIECE, n)
            while hi < n and inside[self.data[hi - 1]] and inside[self.data[hi]]:  # don't cut a word
                ahead = np.flatnonzero(~inside[self.data[hi : hi + PIECE]])
                hi = hi + int(ahead[0]) if len(ahead) else min(hi + PIECE, n)
            piece = self.data[lo:hi]
            starts, ends = runs(inside[piece], self.at[(self.at > lo) & (self.at < hi)] - lo)
            yield lo, piece, starts, ends
            lo = hi

    def rows(self) -> Iterator[tuple[int, slice]]:
        for i in range(len(self.first) - 1):
            yield i, slice(int(self.first[i]), int(self.first[i + 1]))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# Bytes outside [^\x20\x09-\x0D] and outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after lowering A-Z).
WHITE = separators((0x20, 0x20), (0x09, 0x0D))
NO_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; fewer words make one run, none makes none."""
    n, size = len(words), min(k, len(words))
    if not n:
        return words
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : n - size + 1 + j]
    return mixed(out)
