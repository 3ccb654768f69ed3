"""License scans by matching template markup.

A template is wording with marked regions: ``<<beginOptional>> .. <<endOptional>>`` may be
left out, and ``<<var;words=1-3>>`` stands for any one to three words. Everything else is
mandatory and must stand in the text word by word. Each template becomes an automaton over
words; the sets of states that are met are turned into states of one deterministic
automaton as they occur. It only runs from places where two neighbouring words can begin a
template; these are found in numpy over all words of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import segments

# Phrases whose places are always reported.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

TEMPLATES = [
    ("cc-by-nc", "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>the<<endOptional>> cc by nc "
                 "<<beginOptional>><<var;words=1-2>> license<<endOptional>>"),
    ("gpl-notice", "this <<var;words=1-3>> is licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license "
                   "<<beginOptional>>version <<var;words=1-1>><<endOptional>>"),
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0"),
    ("mit-notice", "<<beginOptional>>this <<var;words=1-2>> is<<endOptional>> released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                 "<<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>the software<<endOptional>> "
                 "to deal in the software without restriction"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met"),
    ("isc-text", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose "
                 "with or without fee is hereby granted"),
]

_MARK = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str) -> list[str]:
    """Lower-cased words as the scan sees them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


class Automaton:
    """All templates as one automaton; ``step`` gives state sets numbers as they are met."""

    def __init__(self, templates: Iterable[tuple[str, str]], vocabulary: Mapping[str, int]):
        self.labels: list[str] = []
        self.arcs: list[list[tuple[int | None, int]]] = []  # word number (None: any word), next state
        self.free: list[list[int]] = []  # next states without a word
        self.ends: dict[int, int] = {}
        begin = self._state()
        for label, text in templates:
            self.labels.append(label)
            self.ends[self._read(text, begin, vocabulary)] = len(self.labels) - 1
        self._sets: dict[frozenset[int], int] = {}
        self.known: list[dict[int, int]] = []
        self.accepts: list[list[int]] = []
        self._members: list[frozenset[int]] = []
        self.dead = self._number(frozenset())
        self.begin = self._number(self._closed({begin}))

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _word(self, at: int, word: int | None) -> int:
        to = self._state()
        self.arcs[at].append((word, to))
        return to

    def _read(self, text: str, begin: int, vocabulary: Mapping[str, int]) -> int:
        at, opened = self._state(), []
        self.free[begin].append(at)
        for i, part in enumerate(_MARK.split(text)):
            if i % 2 == 0:
                for word in words_of(part):
                    at = self._word(at, vocabulary[word])
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                self.free[opened.pop()].append(at)
            else:
                low, high = map(int, re.search(r"words=(\d+)-(\d+)", part).groups())
                skips = []
                for k in range(high):
                    if k >= low:
                        skips.append(at)
                    at = self._word(at, None)
                for s in skips:
                    self.free[s].append(at)
        if opened:
            raise ValueError(f"an optional region is not closed: {text}")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self._sets:
            self._sets[states] = len(self._members)
            self._members.append(states)
            self.known.append({})
            self.accepts.append(sorted(self.ends[s] for s in states if s in self.ends))
        return self._sets[states]

    def step(self, state: int, word: int) -> int:
        to = self.known[state].get(word)
        if to is None:
            reached = {t for s in self._members[state] for w, t in self.arcs[s] if w is None or w == word}
            to = self.known[state][word] = self._number(self._closed(reached))
        return to

    def openings(self, n: int) -> np.ndarray:
        """Which pairs of neighbouring words (n: no word of the vocabulary, or none) can begin a match."""
        out = np.zeros((n + 1, n + 1), bool)
        for a in range(n + 1):
            one = self.step(self.begin, a)
            if one != self.dead:
                out[a] = [bool(self.accepts[one]) or self.step(one, b) != self.dead for b in range(n + 1)]
        return out


class Scanner:
    def __init__(self, templates: Iterable[tuple[str, str]], phrases: Mapping[str, str]):
        texts = [_MARK.sub(" ", t) for _, t in templates] + list(phrases)
        words = sorted({w for t in texts for w in words_of(t)})
        found = segments.Words(pa.array(words), segments.NO_ALNUM).hash
        order = np.argsort(found)
        self.hashes, self.numbers, self.n = found[order], order, len(words)
        vocabulary = {w: i for i, w in enumerate(words)}
        self.automaton = Automaton(templates, vocabulary)
        self.pairs = self.automaton.openings(self.n)
        self.phrases = [(label, [vocabulary[w] for w in words_of(p)]) for p, label in phrases.items()]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(self.n - 1, 0))
        return np.where(self.hashes[at] == hashes, self.numbers[at], self.n) if self.n else np.zeros(len(hashes), np.int64)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list, list]:
        """Words per row; (row, label, word) of the phrases; (row, label, first, last + 1) of the templates."""
        words = segments.Words(texts, segments.NO_ALNUM)
        ids, first = self.number(words.hash), words.first
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        end = first[1:][row]  # behind the last word of a word's row
        places, n = [], len(ids)
        for label, phrase in self.phrases:
            at = np.flatnonzero(ids == phrase[0])
            at = at[at + len(phrase) <= end[at]]
            for j, w in enumerate(phrase[1:], 1):
                at = at[ids[at + j] == w]
            places += [(int(row[i]), label, int(i - first[row[i]])) for i in at]
        following = np.full(n, self.n)
        following[:-1] = np.where(row[1:] == row[:-1], ids[1:], self.n) if n else 0
        matches, a = [], self.automaton
        for i in np.flatnonzero(self.pairs[ids, following]) if n else []:
            state, longest = a.begin, {}
            for j in range(i, end[i]):
                state = a.step(state, int(ids[j]))
                if state == a.dead:
                    break
                for k in a.accepts[state]:
                    longest[k] = j + 1
            f = first[row[i]]
            matches += [(int(row[i]), a.labels[k], int(i - f), int(e - f)) for k, e in longest.items()]
        return counts, places, matches


def _lists(n: int, found: list[tuple], kind: pa.DataType) -> pa.Array:
    """One list of structs per row from (row, field, field ...), in order."""
    found = sorted(found, key=lambda x: (x[0], *x[2:], x[1]))
    counts = np.bincount(np.array([x[0] for x in found], np.int64), minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    structs = pa.array([dict(zip(kind.names, x[1:], strict=True)) for x in found], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, str]] = tuple(TEMPLATES),
         phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``doc_id, n_words, places, matches``, one row per row of ``docs``.

    ``places`` holds (label, word) for every place of a phrase, ``matches`` holds
    (label, first, last) for the longest match of a template from each word; words count
    from 0 and ``last`` is included. Nothing is shuffled. Null and empty texts have no
    words and empty lists; a null id stays null; repeated rows give equal rows; an empty
    table gives none. Other columns of ``docs`` are not read.
    """
    templates, phrases = list(templates), dict(phrases)
    place, match = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for lo, hi in segments.stretches(batch.column(1)):
                counts, places, matches = scanner.scan(batch.column(1)[lo:hi])
                matches = [(r, label, a, b - 1) for r, label, a, b in matches]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(counts, pa.int64()), _lists(len(counts), places, place), _lists(len(counts), matches, match)],
                    ["doc_id", "n_words", "places", "matches"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, places array<struct<label: string, word: long>>, "
                                "matches array<struct<label: string, first: long, last: long>>")
