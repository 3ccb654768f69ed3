"""Tokens and word n-grams as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..operators.layout import cuts
from .binding import let
from .text import word_tokens, words

# Words that carry no meaning as a search key.
STOP_WORDS = """
the a an and or but in on at to for of with by from as is are was were be been being have has had
do does did will would should could may might must can this that these those what which who when
where why how if then than so such very just only also more most all each every some any no not
too much many few little
""".split()

# Words of a question that name no subject.
QUESTION_WORDS = "what is are the a an define definition explain meaning of".split()


# Bytes of joined tokens whose n-grams are cut at a time, and those that one array may hold.
CUT, HELD = 1 << 19, 2**31 - 1


def cut_ngrams(texts: pa.Array, upto: int) -> pa.Array:
    """All 1..upto n-grams of tokens that are joined by a blank, as a list for each text.

    An n-gram is a stretch of its text, so its bytes are gathered and no string is made.
    """
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    large = texts.cast(pa.large_string())
    _, at, data = large.buffers()
    at = np.frombuffer(at, np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    some, begins = np.diff(at) > 0, np.zeros(len(data), bool)
    begins[1:] = data[:-1] == 0x20
    begins[at[:-1][some]] = True
    start = np.flatnonzero(begins)
    seen = np.searchsorted(start, at)
    n = np.diff(seen)
    end = np.append(start[1:] - 1, 0)
    end[seen[1:][some] - 1] = at[1:][some]
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - seen[:-1][doc]
    sizes = np.stack([np.maximum(n - i, 0) for i in range(upto)])
    lists = np.concatenate([[0], np.cumsum(sizes.sum(axis=0))])
    lo, hi, before = np.empty(lists[-1], np.int64), np.empty(lists[-1], np.int64), lists[:-1].copy()
    for i in range(upto):
        here = np.flatnonzero(place + i < n[doc])
        to = before[doc[here]] + place[here]
        lo[to], hi[to] = start[here], end[here + i]
        before += sizes[i]
    edges = np.concatenate([[0], np.cumsum(hi - lo)])
    if edges[-1] > HELD:
        raise ValueError(f"n-grams of {edges[-1]} bytes don't fit into an array")
    # From byte to byte by steps of one, and from the end of an n-gram to the next one's beginning.
    step = np.ones(edges[-1], np.int32)
    if len(lo):
        step[edges[:-1]] = np.diff(lo, prepend=0) - np.append(0, (hi - lo)[:-1] - 1)
    found = pa.Array.from_buffers(pa.string(), len(lo), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[np.cumsum(step, out=step)])])
    return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), found, mask=texts.is_null())


def ngrams(toks: Column, upto: int = 5) -> Column:
    """All 1..upto word n-grams, joined by a blank, shortest first; for tokens without blanks, none of them empty."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in cuts(size, CUT):
                yield cut_ngrams(texts[lo:hi], upto)

    return cut(F.array_join(toks, " "))


def hashed_ngrams(toks: Column, upto: int = 1, sizes: bool = False) -> Column:
    """All 1..upto word n-grams as 64-bit hashes, shortest first; with ``sizes``, structs of ``gram`` and ``n``."""

    def longer(ws: Column, shorter: Column, n: int, done: list[Column]) -> Column:
        if n > upto:
            return F.concat(*[sized(grams, i) for i, grams in enumerate(done, 1)])
        places = F.sequence(F.lit(0), F.size(ws) - n)
        grown = F.transform(places, lambda i: F.xxhash64(F.get(shorter, i), F.get(ws, i + (n - 1))))
        grams = F.when(F.size(ws) >= n, grown).otherwise(F.array().cast("array<bigint>"))
        return let(grams, lambda g: longer(ws, g, n + 1, [*done, g]))

    def sized(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(n).alias("n"))) if sizes else grams

    return let(F.transform(toks, lambda w: F.xxhash64(w)), lambda ws: longer(ws, ws, 2, [ws]))


def word_ngrams(c: Column, upto: int = 5) -> Column:
    """n-grams over letter/digit tokens, as the keyword search counts them."""
    return ngrams(word_tokens(c), upto)


def blank_ngrams(c: Column, upto: int = 5) -> Column:
    """n-grams over lower-cased white-space words, as the phrase search counts them."""
    return ngrams(words(F.lower(c)), upto)


def keywords(c: Column) -> Column:
    """Search keys: tokens longer than two letters that are no stop words, with repeats."""
    return F.filter(word_tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def key_terms(c: Column) -> Column:
    """Words of a question stripped of punctuation, without question words."""
    bare = F.transform(words(F.lower(c)), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]{}]+|[.,!?;:()\[\]{}]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_WORDS))


def expand_query(c: Column, limit: int | None = None) -> Column:
    """Distinct phrasings of a query, the query itself first; ``limit`` cuts the list."""
    terms = key_terms(F.translate(F.trim(F.lower(c)), "/-", "  "))
    return let(F.array_join(terms, " "), lambda main: _phrasings(c, main, limit))


def _phrasings(c: Column, main: Column, limit: int | None) -> Column:
    def joined(prefix: str, suffix: str) -> Column:
        return F.concat(F.lit(prefix), main, F.lit(suffix))

    # The phrasings, in order.
    forms = [
        joined("", " is"), joined("", " is a"), joined("", " is an"), joined("", " refers to"),
        joined("", " definition"), joined("definition of ", ""), joined("", " problem"),
        joined("", " arises"),
    ]
    variants = F.when(main != "", F.array(c, *forms)).otherwise(F.array(c))
    keyed = F.transform(variants, lambda v: F.struct(F.lower(F.trim(v)).alias("k"), v.alias("v")))
    long_enough = F.filter(keyed, lambda s: F.length(s["k"]) > 3)

    def first_of_each(arr: Column) -> Column:
        keys = F.transform(arr, lambda s: s["k"])
        return F.filter(arr, lambda s, i: F.array_position(keys, s["k"]) == i + 1)

    distinct = let(long_enough, first_of_each)
    found = F.transform(distinct, lambda s: s["v"])
    return found if limit is None else F.slice(found, 1, limit)
