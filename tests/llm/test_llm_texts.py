"""Splitting, BPE, license scan, URL filter and mixing against plain versions."""

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

import public_tokenizers
from docsift.llm import bpe, licenses, mixing, segments, urls

LOWER = {c: c + 32 for c in range(65, 91)}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHARS = st.text(alphabet="ab'S  \n\ts1é½. lvredm-  ²Ⅷ\U0001f600", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), CHARS), max_size=5))
def test_words_are_the_patterns_matches(texts):
    for table, pattern in ((segments.WHITE, r"[^\x20\x09-\x0D]+"), (segments.NO_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = segments.Words(pa.array(texts, pa.string()), table)
        seen = {}
        for i, s in words.rows():
            got = [bytes(words.data[a:b]).decode().translate(LOWER) for a, b in zip(words.start[s], words.end[s])]
            assert got == re.findall(pattern, (texts[i] or "").translate(LOWER))
            for word, h in zip(got, words.hash[s]):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), CHARS), max_size=4), st.sampled_from([5, 1 << 18]))
def test_pretokens_are_the_patterns_matches(texts, piece):
    old, bpe.PIECE = bpe.PIECE, piece
    try:
        data, starts, ends, _, first = bpe.cut(pa.array(texts, pa.string()))
    finally:
        bpe.PIECE = old
    raw = data.tobytes()
    for i, text in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == regex.findall(public_tokenizers.PATTERN, text or "")


def test_words_longer_than_a_piece():
    text = "x" * (3 * segments.PIECE) + " y"
    words = segments.Words(pa.array([text, None, "y"]), segments.WHITE)
    assert np.diff(words.first).tolist() == [2, 0, 1] and words.hash[1] == words.hash[2]


def test_numbers_survive_packing():
    for values in ([], [0], [1, 255, 256, 2**32 - 1]):
        assert bpe.unpack(bpe.pack(np.array(values, np.int64))).tolist() == values


def test_bpe_round_trip(spark):
    texts = [(1, None), (None, "a b"), (2, ""), (3, "a b"), (3, "a b"), (4, "é" * 20_000), (5, "It's  the\n\n end "), (6, "<|endoftext|> x")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, ids string").repartition(4)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in rows) == want
    assert bpe.encode(docs.limit(0), RANKS).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [64, None])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded and bytes(r.decoded)) for r in bpe.decode(odd, RANKS).collect()) == [(1, None), (2, b"a")]


def test_template_regions():
    markup = [("t", "<<beginOptional>>the<<endOptional>> left <<var;words=1-2>> right <<beginOptional>>end<<endOptional>>")]
    scanner = licenses.Scanner(markup, {"left x": "p"})
    texts = ["The LEFT x right end", "left x y right.", "left right", "left a b c right", "no", None, "left x left x y right end end"]
    _, places, matches = scanner.scan(pa.array(texts))
    # The longest match from each word; an optional word before it opens a match of its own.
    assert matches == [(0, "t", 0, 5), (0, "t", 1, 5), (1, "t", 0, 4), (6, "t", 2, 7)]
    assert places == [(0, "p", 1), (1, "p", 0), (6, "p", 0), (6, "p", 2)]
    with pytest.raises(ValueError):
        licenses.Scanner([("t", "a <<beginOptional>>b")], {})


def test_license_scan(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (None, "CC-BY cc by"), (3, ""), (4, "x " * 30_000 + "GNU General, Public License")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, matches string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [(m.label, m.first, m.last) for m in got[1].matches] == [("mit-notice", 0, 4)]
    assert [(p.label, p.word) for p in got[None].places] == [("cc-by", 0), ("cc-by", 2)]
    assert (got[2].n_words, got[2].places, got[3].matches) == (0, [], [])
    assert got[4].n_words == 30_004 and [p.word for p in got[4].places] == [30_000]
    assert licenses.scan(docs.limit(0)).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_rules(spark):
    cases = {
        "http://a.EXAMPLE.net/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"), "http://x.net/": ("x.net", "/", "net/", "block"),
        "http://x.net": ("x.net", "", None, None), "http://notnet/": ("notnet", "/", None, None), "ftp://w.org/fr/#a": ("w.org", "/fr/", "org/fr/", "allow"),
        "http://myexample.com/de/": ("myexample.com", "/de/", None, None), "example.com/de/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "http://x.net:80/": ("x.net:80", "/", None, None),
    }
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    model = urls.fit(urls.examples(spark))
    got = {r.url: r for r in urls.judge(rows, RULES, model).collect()}
    for url, (host, path, rule, verdict) in cases.items():
        r = got[url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge(rows.limit(0), RULES, model).count() == 0


def test_url_model_is_gradient_ascent_on_the_weights(spark):
    table = urls.examples(spark)
    got = urls.fit(table).first()
    rows = table.withColumn("f", urls.buckets(urls.host_of("url"), urls.path_of("url"))).collect()
    x = np.zeros((len(rows), urls.BUCKETS + 1))
    for i, r in enumerate(rows):
        for b in r.f:
            x[i, b] += 1 / math.sqrt(len(r.f))
        x[i, -1] = 1
    y, w = np.array([r.label for r in rows]), np.zeros(urls.BUCKETS + 1)
    for _ in range(urls.EPOCHS):
        w = w * (1 - urls.DECAY) + urls.RATE / len(rows) * (y - 1 / (1 + np.exp(-x @ w))) @ x
    assert np.allclose(got.weights, w[:-1], atol=1e-8) and abs(got.bias - w[-1]) < 1e-8
    right = [(r.score >= 0.5) == (r.label == 1) for r in urls.judge(table, [], urls.fit(table)).collect()]
    assert np.mean(right) > 0.95


def plain_mix(rows, weights=(3, 1, 2), share=1.5, limit=2.0):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not above:
            return sizes, target | {s: level * weight[s] for s in open_}
        target |= {s: limit * sizes[s] for s in above}
        left -= sum(target[s] for s in above)
        open_ -= above


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{min(i % 9, 4)}") for i in range(900)]
    rows += [(None, None, None), (1000, "a b", None), (1001, "", "é"), (1001, "", "é"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix(docs).collect()
    sizes, target = plain_mix(rows)
    assert len(got) == len(rows)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_thresholds_are_refined(spark, monkeypatch):
    """With coarse buckets, the boundary needs every level of the histograms."""
    monkeypatch.setattr(mixing, "FINE_BITS", (59, 57))
    docs = spark.createDataFrame([(i, "w", f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 1), share=0.5).groupBy("source").sum("taken").collect()
    assert [r[1] for r in got] == [100, 100]


def test_digest_of_a_place_is_stable(spark):
    row = spark.createDataFrame([(1, "a")], "doc_id long, text string").select(mixing.place("doc_id", "text").alias("h")).first()
    assert row.h == int(hashlib.md5(b"1 a").hexdigest()[:15], 16)


def test_block_names_tell_borders_of_texts():
    """Equal joined bytes cut at other places are other words."""
    names = set()
    for texts in (["ab", "c"], ["a", "bc"], ["abc", None], [None, "abc"]):
        block = bpe.Block(keep_words=False)
        block.add(pa.array(range(2)), pa.array(texts))
        names.add(block.digest.digest())
    assert len(names) == 4
