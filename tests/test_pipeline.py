import pytest
from pyspark.sql import functions as F

from blockmill.operators.extract import exploded_blocks, extract_documents, rejects
from blockmill.plans.pipeline import parse_documents
from blockmill.sources import builders as make
from blockmill.sources.frames import assemble_frames, read_files
from blockmill.sources.tables import latest_rows
from blockmill.streaming.ingest import watch_folder, write_chunks

OPTIONS = "target_chars int, overlap_chars int, max_chars int"


def documents(spark, rows):
    return spark.createDataFrame([(n, name, kind, None if c is None else bytearray(c), None, None, None) for n, (name, kind, c) in enumerate(rows)], f"doc_id int, filename string, content_type string, content binary, {OPTIONS}")


def test_end_to_end(spark):
    raw = documents(spark, [("notes.txt", "", b"First paragraph.\n\nSecond paragraph."), ("guide.docx", "", make.docx([("Heading1", "A"), ("", "b")])), ("deals.csv", "", b"h\nx"), ("deck.pptx", "", make.pptx(["s"])), ("", "", b"<html><p>x"), ("bad.txt", "", b"a\xffb")])
    got = {r.doc_id: [] for r in raw.collect()}
    for r in parse_documents(raw).chunks.orderBy("doc_id", "idx").collect():
        got[r.doc_id].append((r["format"], r.text, r.anchor_kind, r.token_count))
    assert got[0] == [("txt", "First paragraph.\n\nSecond paragraph.", "Section", 8)]
    assert got[1] == [("docx", "A\n\nb", "Section", 1)]
    assert [t for _, t, _, _ in got[2]] == ["columns: h. 1 data rows.\nSample rows:\nh: x", "h: x"]
    assert got[3] == [("pptx", "Slide 1\ns", "Slide", 2)]
    assert got[4] == [("html", "x", "Section", 1)]
    assert got[5] == [("txt", "a�b", "Section", 1)]


def test_rejects(spark):
    raw = documents(spark, [("a", "", b""), ("b", "", None), ("c.doc", "", bytes.fromhex("D0CF11E0A1B11AE1")), ("d", "", b"PK\x03\x04garbage"), ("e.txt", "", b"ok")])
    assert [(r.doc_id, r.code) for r in rejects(extract_documents(raw)).orderBy("doc_id").collect()] == [(0, "INVALID"), (1, "INVALID"), (2, "UNSUPPORTED"), (3, "INVALID")]


def test_one_scan_and_one_parse(spark, tmp_path):
    path = str(tmp_path / "raw.parquet")
    documents(spark, [("a.html", "", b"<p>x")]).write.parquet(path)
    extracted = extract_documents(spark.read.parquet(path))
    blocks = exploded_blocks(extracted).where("kind = 'Paragraph'")
    for frame in (blocks, rejects(extracted), parse_documents(spark.read.parquet(path)).chunks):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        assert plan.count("ArrowEvalPython") == 1
        assert "Exchange hash" not in plan


def test_frames(spark):
    schema = "upload_id int, frame_no int, payload binary, filename string, content_type string, target_chars int, overlap_chars int, max_chars int"
    rows = [(1, 2, bytearray(b"b"), *[None] * 5), (1, 0, None, "old", None, 1, 0, 0), (1, 1, bytearray(b"a"), *[None] * 5), (1, 3, None, "new", None, 2, 0, 0), (2, 0, bytearray(b"z"), *[None] * 5)]
    got = {r.upload_id: (bytes(r.content), r.filename, r.target_chars) for r in assemble_frames(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (b"ab", "new", 2), 2: (b"z", None, None)}


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo")
    (folder / "b.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1"))
    assert read_files(spark, str(folder), "*.txt").select("filename").collect()[0].filename == "a.txt"
    stream = watch_folder(spark, str(folder))
    write_chunks(stream, str(tmp_path / "chunks"), str(tmp_path / "rejects"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "chunks")).collect()] == ["one\n\ntwo"]
    assert [r.code for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["UNSUPPORTED"]


def test_latest_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (2, None, "d")], "k int, t int, v string")
    assert {r.k: r.v for r in latest_rows(rows, ["k"], "t", ["k", "v"]).collect()} == {1: "b", 2: "d"}


def test_unused_content_is_not_read(spark, data):
    uploads = spark.read.parquet(f"{data}/uploads.parquet")
    plan = uploads.where(F.col("upload_id") > 5).select("upload_id")._jdf.queryExecution().executedPlan().toString()
    assert "content_bytes" not in plan and "PushedFilters" in plan


@pytest.mark.parametrize("name", ["udtf"])
def test_sql_table_function(spark, name):
    from blockmill.plans.table_function import register

    register(spark)
    rows = spark.sql("SELECT p.* FROM (SELECT encode('a\n\nb', 'utf-8') AS content) t, LATERAL parse_document(content, 'x.txt') p").collect()
    assert [(r.kind, r.text) for r in rows] == [("Paragraph", "a"), ("Paragraph", "b")]
