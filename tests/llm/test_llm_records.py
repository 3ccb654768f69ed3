"""WARC archives, chat formatting, toxicity, the registered queries and the pipeline."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docsift.llm import chat, mixing, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "http://x/ \r\né", "a"), (3, "u", "a"), (None, "u", "a"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 400_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    archives = warc.write(pages)
    got = warc.read(archives, payloads=True).collect()
    assert sum(r.records for r in archives.collect()) == len(rows) == len(got) and all(r.error is None for r in got)
    want = sorted((str(p), len((h or "").encode()), digest((h or "").encode()), "revisit" if p not in (3, 6, 7) else "response",
                   None if p in (3, 6, 7) else 6 if p == 5 else 3) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got if r.page_id == 3} == {"u", "http://x/ \r\né"}
    assert [bytes(r.payload) for r in got if r.page_id == 7] == ["é".encode() * 400_000]
    assert {r.page_id for r in warc.read(warc.write(pages, least=1)).filter("record_type = 'response'").collect()} == {3, 5, 6, 7}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_breaks_are_found(spark, tmp_path):
    good = warc.record(1, "u", b"abc", 3, digest(b"abc"), None)
    cases = {
        "digest differs": warc.member(good.replace(b"abc", b"abd")), "shorter": warc.member(good[:-7]), "longer": warc.member(good + b"x"),
        "no complete head": warc.member(b"WARC/1.1"), "content length": warc.member(good.replace(b"msgtype=response\r\nContent-Length", b"msgtype=response\r\nContent-Size")), "ends within": warc.member(good)[:-9],
    }
    paths = []
    for i, (name, data) in enumerate(cases.items()):
        paths.append((str(tmp_path / f"{i}.warc.gz"), name))
        with open(paths[-1][0], "wb") as f:
            f.write(warc.member(good) + data + (b"" if name == "ends within" else warc.member(good)))
    got = warc.read(spark.createDataFrame(paths + [(None, "")], "path string, name string")).collect()
    for path, name in paths:
        mine = [r for r in got if r.path == path]
        assert sum(r.error is None for r in mine) == (1 if name == "ends within" else 2)
        assert [name in r.error for r in mine if r.error] == [True]


def test_chat_spans(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### assistant: x", "\\", "", "<", "###", "a\n", chat.MARKER, "é\U0001f600"]
    rows = [(i % 3, i, ["user", "assistant", "a: </turn>"][i % 2 if i < 30 else i % 3], nasty[i % len(nasty)]) for i in range(300)]
    rows += [(None, 0, None, None), (None, None, "assistant", "first"), (9, 1, "assistant", "x" * 200_000), (9, 1, "assistant", "x" * 200_000)]
    table = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        groups.setdefault(c, []).append((r or "", x or ""))
    assert {c: [(t.role, t.text) for t in r.said] for c, r in got.items()} == groups
    assert {c: r.loss for c, r in got.items()} == {c: [x for r, x in g if r == "assistant"] for c, g in groups.items()}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_templates():
    turns = [("user", f"t{i}") for i in range(100)]
    whole, spans, rewrites = chat.spans(lambda ts: "<s>" + "".join(f"[{r}]{x}\n" for r, x in ts), turns)
    assert not rewrites and [whole[s[2] : s[3]] for s in spans] == [x for _, x in turns]
    # Looks at the turn before the last one only where a stretch has begun: rendered in full.
    numbered = lambda ts: "".join(f"{i}:{x}|" for i, (_, x) in enumerate(ts))
    whole, spans, rewrites = chat.spans(numbered, turns)
    assert not rewrites and [whole[s[2] : s[3]] for s in spans] == [x for _, x in turns]
    forgets = lambda ts: "".join(x + "|" for _, x in ts[-3:])
    assert chat.spans(forgets, turns[:5]) == ("t2|t3|t4|", None, [3, 4])


def test_network_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(rng, np.arange(3, dtype=np.uint64)).items()}
    x = rng.standard_normal((7, 2 * toxicity.WIDTH))
    word, filled = rng.integers(0, 7, (5, 4)), np.array([[True] * 4] * 3 + [[True, False, True, True]] * 2)
    label, weight = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss(m):
        p = toxicity.sigmoid(toxicity.run(m, toxicity.gates_of(m, x), word, filled, False)[1].astype(np.float64))
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum())

    grad, present = toxicity.gradients(model, toxicity.gates_of(model, x), word, filled, label, weight)
    grad |= {"xf": x[present].T @ grad["gates"]["f"], "cb": grad["gates"]["b"].sum(0)}
    for name in ("v", "w", "b", "uf", "ub", "xf", "cb"):
        at = tuple(rng.integers(0, n) for n in model[name].shape)
        up, down = (model | {name: model[name].copy()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - grad[name][at]) < 2e-3


def test_windows_overlap_and_cover():
    texts = toxicity.Texts(pa.array(["a " * n for n in (0, 1, 64, 65, 200)]))
    row, start, length = texts.windows()
    for i, n in enumerate((0, 1, 64, 65, 200)):
        mine = [(int(s - texts.first[i]), int(k)) for r, s, k in zip(row, start, length) if r == i]
        assert {w for s, k in mine for w in range(s, s + k)} == set(range(n))
        assert all(b[0] < a[0] + a[1] for a, b in zip(mine, mine[1:]))


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    bad = ["vilest", "vileness", "vilely", "vileish"]
    words = lambda n: [f"{'kot rin sab lum'.split()[rng.integers(4)]}{rng.integers(60)}" for _ in range(n)]
    rows, marks = [], []
    for i in range(500):
        text, toxic = words(int(rng.integers(5, 400))), i % 4 == 0
        if toxic:
            text[rng.integers(len(text))] = bad[i // 4 % 4]
        rows.append((i, " ".join(text), 1.0))
        marks.append((i, int(toxic)))
    rows += [(None, None, 1.0), (1000, "", 1.0), (1001, "!? ", 1.0), (1002, " ".join(words(30_000)) + " Vilest! " + " ".join(words(30_000)), 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame(marks + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in docs.filter(toxicity.held_out()).collect()} >= set(held)
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.95
    assert got[None] == got[1000] == got[1001] == 0 and all(0 <= s <= 1 for s in got.values()) and got[1002] >= 0.5
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert toxicity.score(docs, None).agg({"score": "max"}).first()[0] == 0 and toxicity.score(docs.limit(0), model).count() == 0


def rows_of(df):
    return sorted(tuple("NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    assert rows_of(got) == rows_of(want) and sorted(got.columns) == sorted(want.columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    clean = {r.doc_id for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("toxic = 0").collect()}
    assert len(clean - {r.doc_id for r in kept.collect()}) <= 0.1 * len(clean)
    some = docs.limit(0).unionByName(spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, "a b c d e f", None, None, None), (4, "other words than these are", "en", "t", 1), (5, None, None, None, None)], docs.schema))
    single = stages["near_duplicates"](spark, some, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "4", "5", "None"] and single.columns == docs.columns
    mixed = stages["mixing"](spark, single, SF)
    taken = {str(r.doc_id): r.copies for r in mixing.mix(single).collect()}
    assert mixed.count() == sum(taken.values()) and mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in out)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_license_base_columns(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op6_license_scan"](spark, SF).collect()}
    phrases = {tuple(p.split()): label for p, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_chat_finds_passing_rewrites():
    """A turn far back is hidden while turn 49 is last, and shown again in the whole."""
    turns = [("user", f"t{i}") for i in range(60)]
    hides = lambda ts: "".join("" if i == 0 and x == "t0" and ts[-1][1] == "t49" else x + "|" for i, (_, x) in enumerate(ts))
    assert chat.spans(hides, turns, every=False)[2] == []
    assert chat.spans(hides, turns)[1:] == (None, [49, 50])
