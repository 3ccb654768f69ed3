"""Structure repair, collocations and packing against brute force; regular words and odd numbers."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docsift.llm import bpe, nearest, neardup, packing, phrases, queries, repair, topk

SF = "/root/testdata/sf0.001"


# ---- structure repair ----------------------------------------------------------

def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said, fault = out[conv], zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        said += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def repaired(rows):
    """Dijkstra over rows and states, cheapest and then least edits first."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        due, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, due, (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, due, (*out, (name, text))))
                if role[:1] == due or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
    turns, count = [t for t, _, _ in rows if t is not None], Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def compared(rows, out):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in columns) for r in out}
    assert len(got) == len(out) and got == {c: repaired(v) for c, v in damaged(rows).items()}


def test_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    compared([tuple(r) for r in rows], queries.QUERIES["op11_structure_repair"](spark, SF).collect())


def test_repair_odd_conversations(spark):
    """Null ids, turns, roles and texts, ties, copies, parts of more than 256 rows, other columns."""
    rng = random.Random(5)
    rows = [(c or None, rng.choice([t, t, None, t + 1]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "so", "", " \n", None, "ok? ", "é."]))
            for c in range(120) for t in range(rng.choice([1, 3, 6, 12]))]
    rows += [(900, t, rng.choice(["user", "assistant", "tool"]), f"text {rng.randrange(300)}{rng.choice('.!a')}") for t in range(700)]
    rows += [(901, 0, "user", "a.")] * 300
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seg long, said string")
    compared(rows, repair.for_all(df, repair.repair(repair.damage(df))).collect())
    assert repair.repair(df.limit(0)).count() == 0


def test_repair_solves_halves():
    """The divide and conquer equals the whole table of costs, whatever the kinds."""
    rng = random.Random(6)
    for _ in range(300):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 9)))
        for begin in repair.STATES:
            costs, _ = repair.forward(kinds, begin)
            for end in repair.STATES:
                if costs[end] < repair.NONE:
                    edits, state, cost = repair.solved(kinds, begin, end), begin, 0
                    for kind, edit in zip(kinds, edits):
                        state, cost = next((to, cost + c) for (q, to), (c, e) in repair.steps(kind).items() if q == state and e == edit)
                    assert (state, cost) == (end, costs[end])


# ---- collocations --------------------------------------------------------------

def collocated(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    longer = defaultdict(int)
    for (lang, w), a in f.items():
        if a >= least:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least and 100 * longer[lang, w] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def test_collocations_of_odd_texts(spark):
    """Null texts and languages, copies, long pieces without signs, blanks of two kinds, ties, other columns."""
    rng = random.Random(7)
    some = ["On", "the", "é", "of x", "A", "b'c", "zz"]
    rows = [(rng.choice(["en", None, ""]), rng.choice([" ", "\t", "  "]).join(rng.choice(some) for _ in range(rng.randrange(60))) + rng.choice([".", "\r\n", "?!", ""])) for _ in range(60)]
    rows += [("en", "on the é of x. " * 40), ("en", None), (None, ""), ("en", "a " * 2000)] + [("en", "same words come again, and again")] * 9
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, text string, n long, chunk string")
    got = sorted(tuple(r) for r in phrases.collocations(df, least=6, top=25).collect())
    assert got == collocated(rows, 6, 25) and got
    assert phrases.collocations(df.limit(0)).count() == 0


def test_chunks_cover_every_phrase_once(spark):
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000))
    chunks, led, _, new = phrases.parsed(pa.array([text]))
    assert len(chunks) > 50 and sum(new) == 3000
    found = Counter()
    for chunk, lead in zip(chunks.to_pylist(), led.tolist()):
        words = chunk.split()
        found.update(tuple(words[j - 3 : j + 1]) for j in range(3 * lead or 3, len(words)) if j >= 3)
    words = text.split()
    assert found == Counter(tuple(words[i : i + 4]) for i in range(len(words) - 3))


# ---- packing -------------------------------------------------------------------

def packed_right(rows, out, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = Counter(), 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            want[doc, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in places.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]
        assert sum(n for _, n in inside) <= capacity
    return len(places), -(-total // capacity)


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used, least = packed_right(rows, queries.QUERIES["op13_best_fit_packing"](spark, SF).collect())
    assert used <= least + 1


def test_packing_of_odd_texts(spark):
    """Special tokens' strings, letters that lowering parts, white space of all kinds, long and empty texts, copies, null ids."""
    texts = ["", None, "<|endoftext|> A<|ENDOFTEXT|>b don't DON'T'll x.y. É́.. H̱ a b　c İx İ. Σας ﬁn.", "word " * 9000,
             "x" * 5000, "\x1c\x1d a\x85b \x00c. d​. e﻿", "…. «a». 3.14 12a.", "<|endoftext|>. <|startoftext|>, a<|endoftext|>b."]
    rows = [*enumerate(texts), (None, "a b"), (None, "a b"), (3, "q")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, piece int, length long")
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(df, path, ids=True)
    packed_right(rows, packed.collect())
    whole = packing.sequences(packed).collect()
    assert max(len(r["ids"]) for r in whole) <= 4096 and sum(len(r["doc_ids"]) for r in whole) == packed.count()
    assert packing.pack(df.limit(0), path).count() == 0


def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            at = bins.index(room)
            go(i + 1, [*bins[:at], room + items[i], *bins[at + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0] if items else 0


def test_dominance_keeps_the_optimum():
    """What is fixed and the best packing of the rest are together a best packing."""
    rng = random.Random(9)
    for _ in range(400):
        capacity = rng.randrange(5, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(1, 10))), reverse=True)
        fixed, rest = packing.reduce(Counter(items), capacity)
        assert all(sum(s * n for s, n in p) <= capacity for _, p in fixed)
        assert sum(m for m, _ in fixed) + fewest(sorted(Counter(rest).elements(), reverse=True), capacity) == fewest(items, capacity)


# ---- regular words and odd numbers ---------------------------------------------

@pytest.fixture(scope="module")
def regular():
    """The two Thue-Morse words of 2,048 letters, which one running sum cannot tell apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_are_encoded_apart(spark, regular):
    df = spark.createDataFrame(list(enumerate(regular)), "doc_id long, text string").coalesce(1)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: own.encode_ordinary(text) for i, text in enumerate(regular)}


def test_regular_words_are_not_linked(spark, regular):
    df = spark.createDataFrame([(i + 1, text) for i, text in enumerate(regular)], "doc_id long, text string").coalesce(1)
    assert all(r["kept"] for r in neardup.near_duplicates(df, k=2).collect())


def test_vectors_of_any_finite_size_are_found(spark):
    rows = [(0, [1.0, 2.0]), (2, [1e200, 1.0]), (3, [1.0, 1.0]), (5, [1e-320, 0.0]), (6, [-1e308, 1e308]), (7, [3e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in nearest.nearest(df, k=5).orderBy("rank").collect()]
    want = sorted((math.hypot(1.0 - x, 2.0 - y), v) for v, (x, y) in rows if v)
    assert [v for v, _ in got] == [v for _, v in want] and all(math.isclose(s, w) for (_, s), (w, _) in zip(got, want))
    large = nearest.nearest(spark.createDataFrame([(0, [1e200, 1.0])] + rows[1:], df.schema), k=9).orderBy("rank").collect()
    assert [r["vec_id"] for r in large][:1] == [2] and len(large) == 5


def test_products_beyond_longs_are_the_nearest_long(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e18, 2.0]), (2, [-1e300, 2.0]), (3, [1e308, 1e308]), (4, [0.5, 1e-320])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_products(df).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 64 * 32), (2, -(2**63))]
