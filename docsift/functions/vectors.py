"""Vectors: the embedding plug point and distance columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

EmbedFn = Callable[[list[str]], np.ndarray]


_TOKEN = regex.compile(r"[\p{L}\p{N}_]+")
# The faster module's \w, which is the same in texts of these characters alone (Latin letters, general
# punctuation), whatever the versions of Unicode.
_WORD, _OTHER = re.compile(r"\w+"), re.compile("[^\x00-\u036f\u2010-\u205e]")
# Tokens a worker remembers.
TOKENS = 1 << 18


class _Slots(dict):
    """Token -> its dimension, behind those of positive sign the negative ones."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        h = md5(token.encode()).hexdigest()
        slot = self[token] = int(h[:2], 16) % self.dim + (0 if int(h[2], 16) < 8 else self.dim)
        return slot


def hashing_embed(dim: int = 64) -> EmbedFn:
    """Deterministic stand-in for a model: signed token hashing, unit length.

    The first two md5 hex digits of a token choose the dimension, the third the sign.
    """
    slots = _Slots(dim)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            low = (text or "").lower()
            tokens = (_TOKEN if _OTHER.search(low) else _WORD).findall(low)
            if len(slots) > TOKENS:
                slots.clear()
            n = np.bincount(np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens)), minlength=2 * dim)
            out[row] = n[:dim] - n[dim:]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return embed


def embed_udf(factory: Callable[[], EmbedFn]):
    """Arrow-batched column function from any ``texts -> matrix`` function.

    ``factory`` runs once per worker so a model is loaded once, not per batch.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for texts in batches:
            yield pd.Series(list(fn(texts.tolist())))

    return embed


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
