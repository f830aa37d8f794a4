"""Sources, sinks, captures, datasets, pipelines, streaming."""

import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from loomgraph.operators import capture, dataset, evaluate
from loomgraph.operators import graph as G
from loomgraph.plans import inputs, pipelines
from loomgraph.sources import files, graph_io, sinks
from loomgraph.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes():
    body = f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>First </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title xmlns:dc="d">T</dc:title></c>')
    return out.getvalue()


def test_parsers():
    text, meta = files.docx_parts(docx_bytes())
    assert text == "First line\n\nc1 | c2" and meta["title"] == "T" and meta["num_tables"] == 1
    stream = zlib.compress(b"BT (Some long enough text to be taken as a page of words.) Tj ET")
    text, meta = files.pdf_pages(b"%PDF-1.4\nstream\n" + stream + b"\nendstream")
    assert text.startswith("[Page 1]\nSome long enough") and meta["num_pages"] == 1
    assert files.pdf_pages(b"%PDF nothing")[0] == ""
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([8, 2])
    assert files.image_parts(png)[1] == {"format": "PNG", "width": 3, "height": 2, "mode": "RGB"}


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_text("---\ntitle: T\nfilename: own\n---\n# Head\n\nSome **bold** [link](http://x) text.\n\n- Heat causes fire\n")
    (tmp_path / "sub" / "b.txt").write_text("Plain https://youtu.be/abcdefghijk text")
    (tmp_path / "c.url").write_text("[x]\nURL=https://youtu.be/abcdefghijk")
    (tmp_path / "d.docx").write_bytes(docx_bytes())
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.html").write_text("<p>no reader</p>")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    rows = {r.path.rpartition("/")[2]: r for r in files.documents(spark, str(tmp_path), as_of="2024-01-01").collect()}
    assert set(rows) == {"a.MD", "b.txt", "c.url", "d.docx", "e.docx", "g.pdf"}
    md = rows["a.MD"]
    assert md.content == "Head Some bold link text. Heat causes fire" and md.metadata["fm_title"] == "T" and md.metadata["filename"] == "a.MD" and md.metadata["processor"] == "markdown"
    assert rows["b.txt"].metadata["processor"] == "markdown" and rows["c.url"].metadata["video_id"] == "abcdefghijk"
    assert rows["d.docx"].content == "First line c1 | c2" and rows["e.docx"].error and rows["e.docx"].content is None
    assert files.good(files.documents(spark, str(tmp_path))).count() == 5

    docs = pipelines.ingest(spark, str(tmp_path))
    sinks.write_documents(docs.select("content", "chunks", "metadata"), str(tmp_path / "out"))
    assert files.json_documents(spark, str(tmp_path / "out" / "documents")).count() == 5
    sinks.write_documents(docs.select("content", "chunks", "metadata").coalesce(1), str(tmp_path / "one"))
    (tmp_path / "one" / "documents" / "0001_more.json").write_text(json.dumps({"content": "more", "chunks": ["more"], "metadata": {}}, indent=2))
    assert sorted(r.content for r in files.json_documents(spark, str(tmp_path / "one" / "documents")).collect()) == sorted(["more", *[r.content for r in docs.collect()]])
    summary = spark.read.json(str(tmp_path / "out" / "_summary") + "/*.json").first()
    assert summary.total_documents == 5
    assert [r.path for r in docs.orderBy("doc_id").collect()] == sorted(r.path for r in docs.collect())
    found = pipelines.extract_documents(docs)
    assert ("Heat", "CAUSES", "Fire") in {(r.subject, r.relation, r.object) for r in found.collect()}
    sinks.write_triples(found, str(tmp_path / "triples"))
    assert spark.read.parquet(str(tmp_path / "triples")).count() == found.count()


def test_many_small_files(spark, tmp_path, monkeypatch):
    """A file for each text without a folder of its own, and few tasks that read them all."""
    at = tmp_path / "texts"
    sinks.write_texts(spark.createDataFrame([(f"l{i % 3}", f"text {i}\nwith lines") for i in range(300)], "lang string, text string"), str(at), "lang")
    assert sorted(p.name for p in at.iterdir() if p.is_dir()) == ["lang=l0", "lang=l1", "lang=l2"] and len(list(at.glob("*/*.txt"))) == 300
    assert len(list(at.rglob("*.txt"))) == 300
    every = files.scan(spark, str(at))
    parts = every.rdd.getNumPartitions()
    assert parts > 4
    monkeypatch.setattr(files, "SCAN_TASKS", 4)
    joined = files.scan(spark, str(at))
    assert joined.rdd.getNumPartitions() == 4
    assert sorted(bytes(r.content).decode() for r in joined.collect()) == sorted(f"text {i}\nwith lines\n" for i in range(300))


def test_paragraphs_keep_their_ends(spark):
    """Only blanks at the ends go, not digits that are the paragraph's place."""
    parts = ["0" * 101, "x1" * 60 + "1", "\u00a0 " + "y2" * 60 + "2 \u3000", "\t" + "z" * 100]
    rows = spark.createDataFrame([(1, "\n\n".join(parts)), (2, None)], "doc_id long, text string")
    got = dataset.paragraphs(rows).orderBy("pos").collect()
    assert [(r.pos, r.paragraph) for r in got] == [(0, parts[0]), (1, parts[1]), (2, parts[2].strip("\u00a0 \u3000")), (3, parts[3])]


def test_report_writes_numbers_as_sql_does(spark):
    import duckdb

    numbers = [0.00031, 0.00099999, 1e-4, 1.25e-7, 2.0e-3, 1.0, 12345678.5, 1e7, 1e15, 1e16, 2.3e22, -0.0005, 0.1 + 0.2]
    names = ["graph_density", "connectivity", "coverage", *[f"v{i}" for i in range(len(numbers))]]
    one = spark.createDataFrame([(7, 1.0, 1.0, 1.0, *numbers, None)], "n long, " + ", ".join(f"{x} double" for x in [*names, "none"]))
    want = duckdb.sql("SELECT " + ", ".join(f"CAST({x!r} AS DOUBLE) || ''" for x in numbers)).fetchall()[0]
    assert evaluate.report(one).first().value.split("\n") == ["Evaluation", "n: 7", *[f"{x}: 1.0" for x in names[:3]], *[f"v{i}: {x}" for i, x in enumerate(want)]]


def test_graph_files(spark, data, tmp_path):
    n, e = inputs.business_graph(spark, data)
    want = {(r.src, r.dst, r.relation) for r in e.collect()}
    graph_io.write_tables(n, e, f"{tmp_path}/t")
    assert {(r.src, r.dst, r.relation) for r in graph_io.read_tables(spark, f"{tmp_path}/t")[1].collect()} == want
    graph_io.write_node_link(n, e, f"{tmp_path}/j")
    n2, e2 = graph_io.read_node_link(spark, f"{tmp_path}/j")
    assert {(r.src, r.dst, r.relation) for r in e2.collect()} == want and n2.count() == n.count()
    graph_io.write_nodes_edges(n, e, f"{tmp_path}/k")
    n5, e5 = graph_io.read_nodes_edges(spark, f"{tmp_path}/k")
    assert {(r.src, r.dst, r.relation) for r in e5.collect()} == want and {r.label for r in n5.collect()} == {r.label for r in n.collect()}
    graph_io.write_schema(n, e, f"{tmp_path}/s")
    n3, e3 = graph_io.read_schema(spark, f"{tmp_path}/s")
    assert {r.id for r in n3.collect()} == {r.id for r in n.collect()} and e3.count() == len(want)
    graph_io.write_graphml(n, e, f"{tmp_path}/g")
    n4, e4 = graph_io.read_graphml(spark, f"{tmp_path}/g/nodes", f"{tmp_path}/g/edges")
    assert {(r.src, r.dst, r.relation) for r in e4.collect()} == want and {r.label for r in n4.collect()} == {r.label for r in n.collect()}
    graph_io.write_gexf(n, e, f"{tmp_path}/x")
    assert graph_io.read_gexf(spark, f"{tmp_path}/x/edges")[1].where("src IS NOT NULL").count() == len(want)
    graph_io.clear(f"{tmp_path}/t/nodes", n)
    assert spark.read.parquet(f"{tmp_path}/t/nodes").count() == 0


def test_captures(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/b", "T: x", "hello big world"), (None, "t", None), ("http://c", " ", None)], "url string, title string, content string")
    checked = capture.validate_pages(rows)
    assert [r.error for r in checked.collect()] == [None, "missing url", "missing title"]
    page = capture.render_page(checked).first()
    assert page.filename == "T_ x.md" and "hello big world" in page.markdown and checked.first().wordCount == 3
    video = spark.createDataFrame([("abcdefghijk", "u", None, 65, 1234, "20240102", "text")], "videoId string, url string, title string, seconds long, views long, uploaded string, transcript string")
    named = capture.validate_videos(video)
    shown = capture.render_video(named).first()
    assert "1:05" in shown.markdown and "1,234" in shown.markdown and "2024-01-02" in shown.markdown and shown.filename == "Video abcdefghijk.md"
    (tmp_path / "log.json").write_text(json.dumps([{"url": "http://x", "title": "t", "type": "pdf"}]))
    assert files.capture_log(spark, str(tmp_path / "log.json"), "pages_array").count() == 1
    (tmp_path / "s.json").write_text(json.dumps({"events": [{"segs": [{"utf8": "hi "}, {"utf8": "you"}]}, {}]}))
    assert files.subtitles(spark, str(tmp_path / "s.json")).first()["text"] == "hi you"


def test_datasets(spark, tmp_path):
    rows = dataset.synthetic(spark, 95)
    assert rows.count() == 95 and all(len(r.output.split("\n")) in (2, 3) and "{" not in r.input for r in rows.collect())
    parts = dataset.split(rows, "id")
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 76, "val": 9, "test": 10}
    sinks.write_dataset(parts, str(tmp_path / "d"), "instruction")
    back = spark.read.json(str(tmp_path / "d"))
    assert back.where("split = 'train'").count() == 76 and "instruction" in back.columns
    (tmp_path / "m.json").write_text(json.dumps([{"text": "t", "triples": ["S:a|R:B|O:c"], "metadata": {"source": "me"}}, {"text": "u", "triples": []}]))
    got = dataset.manual(files.annotations(spark, str(tmp_path / "m.json"))).collect()
    assert [r.metadata["source"] for r in got] == ["me", "manual"]
    assert dataset.prompts(rows).first()["text"].startswith("### Instruction:")
    assert dataset.count_sources(rows.withColumn("source", F.lit(None).cast("string"))).first()["source"] == "unknown"


def test_stream_grows_a_graph(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    line = lambda u, t: json.dumps({"url": u, "title": "t", "content": t, "savedAt": "2024-01-01T00:00:00"}) + "\n"
    (landing / "1.json").write_text(line("http://a", "Heat causes fire") + line("http://a", "Heat causes fire"))
    run = lambda: ingest.grow(spark, str(landing), str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (landing / "2.json").write_text(line("http://b", "Fire causes smoke") + line("http://a", "Never again"))
    run()
    last = max(int(p.name[1:]) for p in (tmp_path / "g").iterdir())
    edges = spark.read.parquet(str(tmp_path / "g" / f"v{last}" / "edges"))
    assert {(r.src, r.dst, r.n_provenance) for r in edges.collect()} == {("heat", "fire", 1), ("fire", "smoke", 1)}


def test_windows_and_sessions_on_replayed_events(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert ingest.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_questions_are_answered(spark, data):
    from loomgraph.operators import retrieve
    from loomgraph.plans.config import Config

    t = inputs.doc_triples(spark, data)
    n, e = pipelines.build(t)
    rows = inputs.doc_chunks(spark, data).withColumnRenamed("chunk", "text").limit(50)
    index = retrieve.build_index(rows).cache()
    asked = index.orderBy("id").limit(2).select(F.monotonically_increasing_id().alias("query_id"), F.col("text").alias("question"))
    out = pipelines.ask(index, asked, n, e, Config(similarity=0.9))
    assert out["answers"].count() == 2 and "Relevance: 1.00" in out["answers"].first()["answer"]
    out["context"].collect()
    assert G.search_labels(n, "e").count() == 10


def test_analysis_bundle(spark, data):
    out = pipelines.analyse(inputs.business_triples(spark, data), topic="asia")
    assert set(out) == {"gaps", "contradictions", "threads", "inferred_edges", "nodes", "edges", "recommendations"}
    assert out["recommendations"].count() == 5
