"""Files, stored artefacts, ingestion and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift import schema
from docsift.operators import catalog, filters, layout, numbering, vector
from docsift.operators.highlight import CLOSE, OPEN, highlight
from docsift.operators.numbering import number_members, resolve_parents, staged
from docsift.plans import ingest as plan
from docsift.plans import evaluate
from docsift.sources import artifacts, exports, files, transcripts
from docsift.streaming.ingest import ingest_stream


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\n\n\nx")
    (tmp_path / "sub" / "b.txt").write_text("Title\nA longer line that ends with a stop.")
    got = {r["file_name"]: r["text"] for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# T\n\nx", "b.txt": "## Title\nA longer line that ends with a stop."}


def test_latin1_fallback(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes("café".encode())
    got = {r["file_name"]: r["text"] for r in files.read_plain(spark, str(tmp_path)).collect()}
    assert got == {"l.txt": "café", "u.txt": "café"}


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = f"<w:document {ns}><w:body>{para('Top', 'Heading 2')}{para('item', 'ListBullet')}{para('plain')}</w:body></w:document>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/i.png", b"x")
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    raw = files.read_binary(spark, str(tmp_path), "*.docx")
    rows = files.read_pages(raw, files.docx_paragraphs).orderBy("page").collect()
    assert [r["text"] for r in rows] == ["## Top", "- item", "plain"]
    assert [r["text"] for r in files.read_pages(raw, files.docx_images).collect()] == ["word/media/i.png"]


def test_join_pages(spark):
    pages = spark.createDataFrame([("p", 2, "second page here."), ("p", 1, "first.\nline.")], "path string, page int, text string")
    row = files.join_pages(pages).first()
    assert row["text"] == "<!-- Page 1 -->\n\nfirst.\nline.\n\n<!-- Page 2 -->\n\nsecond page here."
    assert row["page_numbers"] == [1, 1, 2]


def test_subtitles(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nHello\nthere\n\n2\n00:00:03.000 --> 00:00:04.000\nEnd"
    rows = transcripts.subtitle_segments(spark.createDataFrame([(1, vtt)], "doc_id int, text string")).orderBy("segment").collect()
    assert [(r["start_time"], r["end_time"], r["text"]) for r in rows] == [
        ("00:00:01.000", "00:00:02.500", "Hello there"), ("00:00:03.000", "00:00:04.000", "End")]


def test_json_transcripts_of_both_shapes(spark):
    docs = [(1, json.dumps([{"speaker": "A", "text": "x", "index": 4}, {"text": "y"}])), (2, json.dumps({"turns": [{"speaker": "B", "text": "z"}]}))]
    rows = transcripts.json_turns(spark.createDataFrame(docs, "doc_id int, json string")).orderBy("doc_id", "pos").collect()
    assert [(r["text"], r["turn_index"]) for r in rows] == [("A: x", 4), ("unknown: y", 0), ("B: z", None)]


def test_artifacts(spark, tmp_path):
    (tmp_path / "rel.json").write_text(json.dumps({"a<SEP>b": {"chunk_ids": ["c1", "c2"], "count": 2}}))
    rows = artifacts.kv_store(spark, str(tmp_path / "rel.json"), artifacts.CHUNK_LINKS)
    got = sorted((r["source"], r["target"], r["chunk_id"]) for r in artifacts.relation_links(rows).collect())
    assert got == [("a", "b", "c1"), ("a", "b", "c2")]
    xml = ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" attr.name="weight"/><graph>'
           '<node id="x"/><node id="y"/><edge source="x" target="y"><data key="d0">2.5</data></edge></graph></graphml>')
    nodes, edges = artifacts.graph_tables(spark.createDataFrame([(xml.encode(),)], "content binary"))
    assert nodes.count() == 2 and edges.first()["weight"] == 2.5


def documents(spark, names):
    rows = [(i, f"{n}.txt", f"1. Alpha of {n}\nThe Client shall pay.\n1.1 Mail {n}@x.org now.\n2. Beta\nEnd.", "2024-01-01T00:00:00") for i, n in names]
    return spark.createDataFrame(rows, "doc_id long, source_file string, text string, upload_timestamp string")


def test_ingest_links_numbers_and_entities(spark):
    rows = plan.ingest(documents(spark, [(1, "a"), (2, "b")]), ["structural", "recursive"], start=11).orderBy("chunk_number").collect()
    assert [r["chunk_number"] for r in rows] == list(range(11, 11 + len(rows)))
    by_key = {(r["source_file"], r["chunking_method"], r["clause_number"]): r for r in rows}
    child = by_key[("a.txt", "structural", "1.1")]
    assert child["parent_chunk_number"] == by_key[("a.txt", "structural", "1")]["chunk_number"]
    assert by_key[("a.txt", "structural", "1")]["email"] == "a@x.org"
    assert len({r["chunk_pk"] for r in rows}) == len(rows) and len(rows[0]["embedding"]) == 64
    assert [f.name for f in schema.CHUNK] == list(rows[0].asDict())


def test_upsert_replaces_equal_keys(spark, tmp_path):
    stored = plan.ingest(documents(spark, [(1, "a"), (2, "b")]), ["recursive"])
    again = plan.ingest(documents(spark, [(2, "b"), (3, "c")]), ["recursive"], start=50)
    path = str(tmp_path / "t")
    plan.upsert(stored, again, path)
    got = spark.read.parquet(path)
    assert sorted(r["source_file"] for r in got.select("source_file").distinct().collect()) == ["a.txt", "b.txt", "c.txt"]
    assert got.filter("source_file = 'b.txt'").agg(F.min("chunk_number")).first()[0] >= 50
    assert catalog.check_vectors(got, 64).count() == 0
    with pytest.raises(ValueError):
        schema.require(stored.drop("embedding_model"))


def test_ingest_moves_no_chunks(spark, tmp_path):
    """Texts are dealt once, and neither staged nor shuffled as chunks; documents may come twice."""
    rows = documents(spark, [(i, f"f{i}") for i in (3, 1, 2, 3)])
    rows.write.parquet(str(tmp_path / "d"))
    methods = ["structural", "recursive", "hierarchical", "agentic"]
    got = plan.ingest(spark.read.parquet(str(tmp_path / "d")), methods, start=5)
    shown = got._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("RepartitionByExpression") == 3 and "Window" not in shown and "Aggregate" not in shown
    # As numbered and joined by the operators that move rows.
    chunks = number_members(staged(plan.chunk_documents(rows, methods)), ["doc_id", "method_ord"], "pos", 5)
    linked = [resolve_parents(chunks.filter(F.col("chunking_method") == m)) for m in ("structural", "hierarchical")]
    flat = chunks.filter(~F.col("chunking_method").isin("structural", "hierarchical"))
    want = linked[0].unionByName(linked[1]).unionByName(flat, allowMissingColumns=True)
    want = plan.attach_entities(want, rows).join(rows.select("doc_id", "source_file"), "doc_id")
    cols = ["source_file", "chunking_method", "chunk_number", "parent_chunk_number", "clause_number", "text", "email"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.filter("size(embedding) = 64").count() == want.count() > 0


def test_unknown_sizes_are_not_dealt(spark):
    rows = documents(spark, [(1, "a"), (2, "b")])
    assert layout.spread(rows.select("doc_id", "text"), "doc_id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    dealt = layout.spread(read, "doc_id")
    again = layout.spread(numbering.staged(dealt).filter("doc_id > 1"), "doc_id")
    for df in (layout.spread(dealt.filter("doc_id > 1"), "doc_id"), again):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == (0 if df is again else 1)


def test_stream_skips_stored_files(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    kind = documents(spark, [(1, "a")]).schema
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        documents(spark, batch).coalesce(1).write.mode("append").parquet(src)
        ingest_stream(spark.readStream.schema(kind).parquet(src), table, ckpt, ["recursive"]).awaitTermination()
    rows = spark.read.parquet(table)
    per_file = {r["source_file"]: r["n"] for r in rows.groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert set(per_file) == {"a.txt", "b.txt", "c.txt"} and len(set(per_file.values())) == 1
    numbers = [r["chunk_number"] for r in rows.select("chunk_number").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_highlight_prefers_long_terms_and_marks_once(spark):
    corpus = spark.createDataFrame([(1, "Pay the fee. The fee is due; pay THE FEE.")], "id long, text string")
    q = spark.createDataFrame([(1, "the fee")], "query_id long, text string")
    got = highlight(corpus, q).first()["highlighted_text"]
    assert got == f"Pay {OPEN}the fee{CLOSE}. {OPEN}The{CLOSE} {OPEN}fee{CLOSE} is due; pay THE FEE."


def test_vector_search_in_blocks_equals_one_block(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, vector.top(v, q, 3).collect()))
    monkeypatch.setattr(vector, "BLOCK", 100)
    assert sorted(map(tuple, vector.top(v, q, 3).collect())) == one


def test_queries_of_many_blocks_stay_off_the_driver(spark, monkeypatch):
    """Only one block is ever collected, whatever the number of queries."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3).alias("part"), F.md5(F.col("label").cast("string")).alias("_key"))
    v = v.filter("id < 120")
    q = v.select(F.col("id").alias("query_id"), "vec")
    runs = [lambda: vector.top(v.drop("part", "_key"), q, 3), lambda: vector.top(v.drop("_key"), q, 2, group="part"),
            lambda: vector.top(v.drop("part"), q, 3, distinct=True), lambda: vector.scores(v.drop("part", "_key"), q)]
    one = [sorted(map(str, run().collect())) for run in runs]
    seen = []
    collect = type(q).toPandas
    monkeypatch.setattr(type(q), "toPandas", lambda df: seen.append(len(out := collect(df))) or out)
    monkeypatch.setattr(vector, "BLOCK", 25)
    monkeypatch.setattr(vector, "ROWS", 16)
    assert [sorted(map(str, run().collect())) for run in runs] == one
    assert seen == [26] * 4


def test_empty_inputs(spark):
    v = spark.createDataFrame([], "id long, vec array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<float>")
    assert vector.top(v, q, 3).count() == 0
    assert vector.top(v.limit(0), q.limit(0), 3).count() == 0


def test_filters_reach_the_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("lang", "chunking_method")
    plan_text = t.filter(filters.chunk_filter("en")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan_text and "struct<doc_id:bigint,lang:string>" in plan_text


def test_metric_summary_ties_and_nulls(spark):
    rows = spark.createDataFrame([("b", "m", 1.0), ("a", "m", 1.0), ("c", "m", None), ("d", "m", 0.5)], "combination string, metric string, value double")
    r = evaluate.metric_summary(rows).first()
    assert (r["best"], r["worst"], r["mean"]) == ("a", "d", 0.833333)


def test_every_file_has_a_status(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>In a paragraph.</w:t></w:r></w:p></w:document>')
    rows = [
        ("x/a.txt", b"A longer line that ends with a stop."), ("x/b.md", b"# T\n\n\n\nx"), ("x/c.VTT", b"WEBVTT\n\n1\n00:01 --> 00:02\nHello"),
        ("x/d.json", b'{"turns": [{"speaker": "B", "text": "z"}, {"text": null}]}'), ("x/e.json", b"[oops"), ("x/f.docx", buf.getvalue()),
        ("x/g.docx", b"not a zip"), ("x/h.xyz", b"?"), ("x/i", b"?"), ("x/j.txt", None), ("x/k.txt", b" "), ("x/l.docx", b"not read")]
    df = spark.createDataFrame(rows, "path string, content binary")
    stored = spark.createDataFrame([("l.docx",), ("l.docx",), (None,)], "file_name string")
    got = {r["file_name"]: (r["status"], r["message"], r["text"]) for r in files.parse_files(df, stored).collect()}
    assert len(got) == len(rows)
    assert got["a.txt"] == ("APPLIED", None, "A longer line that ends with a stop.") and got["b.md"][2] == "# T\n\nx" and got["c.VTT"][2] == "Hello"
    assert got["d.json"][2] == "B: z\nunknown: " and got["e.json"][:2] == ("ERROR", "no turns") and got["f.docx"][2] == "In a paragraph."
    assert got["g.docx"][0] == "ERROR" and got["g.docx"][1].startswith("BadZipFile") and got["g.docx"][2] is None
    assert got["h.xyz"][1] == "unsupported file type: xyz" and got["i"][1] == "unsupported file type: "
    assert got["j.txt"][1] == "no content" and got["k.txt"][1] == "no text" and got["l.docx"] == ("SKIPPED", "already processed", None)
    assert files.parse_files(df.limit(0)).count() == 0


def test_merge_takes_the_same_row_of_a_tie(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept")], "k string, n int, text string")
    new = [("a", 2, "x"), ("a", 2, "y"), ("a", 1, "z"), ("a", 2, "x"), (None, None, "p"), (None, None, "q")]
    runs = set()
    for rows in (new, new[::-1], new[3:] + new[:3]):
        merged = catalog.merge_by_key(old, spark.createDataFrame(rows, "k string, n int, text string").repartition(3), "k", "n")
        runs.add(tuple(sorted(map(str, merged.collect()))))
    assert len(runs) == 1 and len(runs.pop()) == 3


def test_exports_come_back_whole(spark, tmp_path):
    texts = ["plain", "", None, ' lead and trail ', 'say "so", twice ""', "two\nlines\r\nthree\n", "back\\slash \\\" end", ",", "é\u2028x\t", '"', "null", "\\N", "x" * 300_000]
    schema = "id long, text string, score double"
    df = spark.createDataFrame([(i, t, None if i % 2 else i / 3) for i, t in enumerate(texts)], schema).repartition(3)
    want = sorted(map(str, df.collect()))
    for name, write, read in (("j", exports.write_jsonl, exports.read_jsonl), ("c", exports.write_csv, exports.read_csv)):
        for part, rows in (("", df), ("-empty", df.limit(0))):
            write(rows, f"{tmp_path}/{name}{part}")
        assert sorted(map(str, read(spark, f"{tmp_path}/{name}", schema).collect())) == want
        assert read(spark, f"{tmp_path}/{name}-empty", schema).count() == 0
        with pytest.raises(Exception, match="already exists"):
            write(df, f"{tmp_path}/{name}")


def test_upsert_moves_a_text_once(spark):
    """Numbers go to the documents, not texts to the numbers; of what comes in, each row moves once."""
    from docsift.suite import QUERIES

    shown = QUERIES["b2_upsert"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in shown.splitlines() if "Join " in line]
    assert joins and not any("pos#" in line for line in joins)
    old = spark.createDataFrame([("a", 1, "old"), (None, 1, "kept"), ("c", 1, "c"), ("c", 1, "c")], "k string, n int, text string")
    new = spark.createDataFrame([("a", None, "x"), ("a", 2, "y"), (None, 1, "z"), ("b", None, None)], "k string, n int, text string")
    merged = catalog.merge_by_key(old, new, "k", "n")
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, [(None, 1, "kept"), ("c", 1, "c"), ("c", 1, "c"), ("a", 2, "y"), (None, 1, "z"), ("b", None, None)]))
