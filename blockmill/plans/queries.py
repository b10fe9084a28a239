"""The registered queries of the core engine, with equivalent SQL for DuckDB where SQL can state them.

Round trips write real containers from table rows, run them through detection and extraction, and are held against plain
SQL over the rows they were written from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.text import byte_pieces, column_name, paragraph_list, tokens_estimated, trimmed, without_quotes
from blockmill.operators.chunk import PATH_MARK, chunk_prose, chunk_sheets, chunk_slides, cut_to_max, heading_paths, sheet_rows, sheet_summaries
from blockmill.operators.detect import detect_format
from blockmill.operators.extract import exploded_blocks, extract_documents, rejects
from blockmill.plans.pipeline import parse_documents, with_sizes
from blockmill.sources import builders
from blockmill.sources.frames import assemble_frames
from blockmill.sources.tables import latest_rows, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

# ---- inputs ----

BLOCK_FIELDS = ["upload_id", "block_no", "kind", "block_level", "text", "cells", "row_no", "anchor_kind", "slide", "sheet"]


def _sized(df: DataFrame, target: int = 0, overlap: int = 0, maximum: int = 0) -> DataFrame:
    return with_sizes(df.withColumns({"target_chars": F.lit(target), "overlap_chars": F.lit(overlap), "max_chars": F.lit(maximum)}))


def upload_blocks(spark: SparkSession, sf_dir: str, anchors: list[str]) -> DataFrame:
    """Blocks of the given anchor kinds, each once, with the sizes in force of their uploads."""
    rows = read_table(spark, sf_dir, "blocks").where(F.col("anchor_kind").isin(anchors))
    once = latest_rows(rows, ["block_id"], "loaded_at", ["block_id", *BLOCK_FIELDS])
    uploads = latest_rows(read_table(spark, sf_dir, "uploads"), ["upload_id"], "received_at", ["upload_id", "target_chars", "overlap_chars", "max_chars"])
    return with_sizes(once.join(uploads, "upload_id", "left"))


def _text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("a.txt").alias("filename"), F.lit("").alias("content_type"))


def _lines() -> Column:
    """Lines of the text without control characters, trimmed, not empty."""
    plain = F.regexp_replace(F.col("text"), "[\\x00-\\x09\\x0B-\\x1F\\x7F\\x{FFFE}\\x{FFFF}]", " ")
    return F.filter(F.transform(F.split(plain, "\n", -1), trimmed), lambda t: t != "")


def _built(parts: DataFrame, builder: Callable[[list[str]], bytes], filename: str = "", content_type: str = "") -> DataFrame:
    """Documents written from (doc_id, parts array<string>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [builder(list(p)) for p in frame["parts"]]})

    made = spread(parts.select("doc_id", "parts")).mapInPandas(run, "doc_id bigint, content binary")
    return made.withColumns({"filename": F.lit(filename), "content_type": F.lit(content_type)})


def _extracted(documents: DataFrame) -> DataFrame:
    return exploded_blocks(extract_documents(documents))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _lines().alias("parts")).where("size(parts) > 0")


def _decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "blocks").where("kind = 'SlideBody'")
    once = latest_rows(rows, ["block_id"], "loaded_at", ["block_id", "upload_id", "block_no", "text"]).withColumn("text", F.array_join(_lines(), "\n"))
    grouped = once.where("text <> ''").groupBy(F.col("upload_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("x"))
    return grouped.select("doc_id", F.transform("x", lambda s: s["text"]).alias("parts"))


#: Rows of a sheet that is written for a round trip; a sheet of any table is of bounded size.
SHEET_ROWS = 1000


def _customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of the customers of each nation, by ranges of keys: a header and rows, cells joined by a separator."""
    sheet = F.floor(F.col("c_custkey") / SHEET_ROWS) * 100 + F.col("c_nationkey")
    rows = read_table(spark, sf_dir, "customer").select(sheet.cast("bigint").alias("doc_id"), "c_custkey", F.concat_ws("\x1f", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))).alias("x"))
    return grouped.select("doc_id", F.concat(F.array(F.lit("key\x1fname\x1fsegment")), F.transform("x", lambda r: r["line"])).alias("parts"))


def _grid(parts: list[str]) -> list[list[str]]:
    return [p.split("\x1f") for p in parts]


# ---- kernels ----


def token_estimate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", tokens_estimated(F.col("text")).alias("token_count"))


def split_paragraphs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode_outer(paragraph_list(F.col("text"))).alias("n", "paragraph")).where("n IS NOT NULL")


def hard_split(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", F.lit(1000).alias("maximum"))
    return cut_to_max(docs, at="n")


def col_letter(spark, sf_dir):
    keys = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("n"))
    return keys.select("n", column_name(F.col("n")).alias("letter"))


def strip_quoted(spark, sf_dir):
    rows = read_table(spark, sf_dir, "blocks").where("anchor_kind = 'Email' AND text IS NOT NULL")
    return rows.select("block_id", without_quotes(F.col("text")).alias("kept")).distinct()


def detect_formats(spark, sf_dir):
    uploads = read_table(spark, sf_dir, "uploads").where("content_bytes IS NOT NULL")
    found = detect_format(uploads, content_col="content_bytes")
    return found.select("upload_id", F.coalesce("format", "reject_code").alias("found")).distinct()


# ---- chunkers ----


def _chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "idx", "text", "source_label", "token_count")


def text_chunks_default(spark, sf_dir):
    parsed = parse_documents(_text_documents(spark, sf_dir).withColumns({c: F.lit(0) for c in ("target_chars", "overlap_chars", "max_chars")}))
    return parsed.chunks.select("doc_id", "idx", "text", "token_count")


def text_chunks_small(spark, sf_dir):
    sizes = {"target_chars": F.lit(700), "overlap_chars": F.lit(0), "max_chars": F.lit(900)}
    return parse_documents(_text_documents(spark, sf_dir).withColumns(sizes)).chunks.select("doc_id", "idx", "text", "token_count")


def _line_blocks(spark, sf_dir) -> DataFrame:
    rows = _document_lines(spark, sf_dir).select("doc_id", F.posexplode_outer("parts").alias("block_no", "text")).where("block_no IS NOT NULL")
    return rows.withColumns({"kind": F.lit("Paragraph"), "block_level": F.lit(0), "anchor_kind": F.lit("Section")})


def line_pack(spark, sf_dir):
    return _chunks(chunk_prose(_sized(_line_blocks(spark, sf_dir), 500, 0, 6000), ["doc_id"]), ["doc_id"])


def line_pack_overlap(spark, sf_dir):
    return _chunks(chunk_prose(_sized(_line_blocks(spark, sf_dir), 500, 80, 6000), ["doc_id"]), ["doc_id"])


def heading_path(spark, sf_dir):
    blocks = upload_blocks(spark, sf_dir, ["Section"])
    return heading_paths(blocks, ["upload_id"]).select("upload_id", "block_no", "section", F.array_join("heading_path", PATH_MARK).alias("path"))


def _flat(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.withColumn("heading_path", F.array_join("heading_path", PATH_MARK)).select(*keys, "idx", "text", "source_label", "anchor_kind", "slide", "sheet", "cell_range", "heading_path", "token_count")


def prose_chunks(spark, sf_dir):
    return _flat(chunk_prose(upload_blocks(spark, sf_dir, ["Section", "Email"]), ["upload_id"]), ["upload_id"])


def sheet_rows_serialized(spark, sf_dir):
    rows = sheet_rows(upload_blocks(spark, sf_dir, ["Sheet"]), ["upload_id"])
    return rows.where("place > 1").select("upload_id", "sheet", "block_no", "line")


def sheet_summary(spark, sf_dir):
    sheets = sheet_summaries(sheet_rows(upload_blocks(spark, sf_dir, ["Sheet"]), ["upload_id"]), ["upload_id"])
    return sheets.select("upload_id", "sheet", "text", "source_label", "cell_range")


def sheet_chunks(spark, sf_dir):
    return _flat(chunk_sheets(upload_blocks(spark, sf_dir, ["Sheet"]), ["upload_id"]), ["upload_id"]).select("upload_id", "idx", "text", "source_label", "cell_range", "token_count")


def slide_chunks(spark, sf_dir):
    return _flat(chunk_slides(upload_blocks(spark, sf_dir, ["Slide"]), ["upload_id"]), ["upload_id"]).select("upload_id", "idx", "text", "source_label", "slide", "token_count")


def customer_sheets(spark, sf_dir):
    """A delimited file for each nation, taken through the whole pipeline."""
    documents = _built(_customer_rows(spark, sf_dir), lambda p: builders.delimited(_grid(p)), "customers.csv").withColumns({"target_chars": F.lit(2000), "overlap_chars": F.lit(0), "max_chars": F.lit(6000)})
    return parse_documents(documents).chunks.select("doc_id", "idx", "text", "source_label", "cell_range", "token_count")


# ---- sources ----


def upload_chunks(spark, sf_dir):
    """All uploads with content, through detection, extraction and chunking with their own sizes."""
    columns = ["upload_id", "filename", "content_type", "content_bytes", "target_chars", "overlap_chars", "max_chars"]
    uploads = latest_rows(read_table(spark, sf_dir, "uploads").where("content_bytes IS NOT NULL"), ["upload_id"], "received_at", columns)
    return _flat(parse_documents(uploads.withColumnRenamed("content_bytes", "content"), "upload_id").chunks, ["upload_id", "format"])


def html_paragraphs(spark, sf_dir):
    """Texts of the blocks of uploads that are HTML by name, declared type or content."""
    uploads = latest_rows(read_table(spark, sf_dir, "uploads").where("content_bytes IS NOT NULL"), ["upload_id"], "received_at", ["upload_id", "filename", "content_type", "content_bytes"])
    rows = exploded_blocks(extract_documents(uploads, id_col="upload_id", content_col="content_bytes"), "upload_id").where("format = 'html'")
    return rows.select("upload_id", "block_no", "text").distinct()


def framed_uploads(spark, sf_dir):
    """Contents cut into frames and put together again."""
    uploads = latest_rows(read_table(spark, sf_dir, "uploads").where("content_bytes IS NOT NULL"), ["upload_id"], "received_at", ["upload_id", "filename", "content_bytes", "target_chars"])
    size = 300
    cut = uploads.withColumn("frame_no", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.octet_length("content_bytes") / size).cast("int"))))).select("upload_id", F.col("frame_no"), F.substring(F.col("content_bytes"), (F.col("frame_no") - 1) * size + 1, F.lit(size)).alias("payload"), *[F.lit(None).cast(t).alias(c) for c, t in (("filename", "string"), ("content_type", "string"), ("target_chars", "int"), ("overlap_chars", "int"), ("max_chars", "int"))])
    options = uploads.select("upload_id", F.lit(0).alias("frame_no"), F.lit(None).cast("binary").alias("payload"), "filename", F.lit(None).cast("string").alias("content_type"), "target_chars", F.lit(0).alias("overlap_chars"), F.lit(0).alias("max_chars"))
    whole = assemble_frames(cut.union(options))
    return whole.select("upload_id", F.md5("content").alias("digest"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("target_chars", F.lit(0)).alias("target_chars"))


BAD_DOCUMENTS = [
    (1, "", "", b""),
    (2, "a.doc", "", bytes.fromhex("D0CF11E0A1B11AE1") + b"x"),
    (3, "a.docx", "", b"PK\x03\x04garbage"),
    (4, "a.zip", "", builders.zipped({"x.txt": "x"})),
    (5, "a.docx", "", builders.zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": "<a>&none;</a>"})),
    (6, "a.odt", "", builders.zipped({"mimetype": "application/vnd.oasis.opendocument.text"})),
    (7, "a.epub", "", builders.zipped({"META-INF/container.xml": "<container/>"})),
    (8, "a.eml", "", b"no header here\n\nbody"),
    (9, "a.txt", "", b"fine"),
]


def rejected_documents(spark, sf_dir):
    """Every region's copy of the inputs that cannot be taken, and one that can."""
    bad = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("filename"), F.lit(kind).alias("content_type"), F.lit(bytearray(data)).alias("content")) for n, name, kind, data in BAD_DOCUMENTS])
    documents = read_table(spark, sf_dir, "region").select("r_regionkey", F.inline(bad)).withColumn("doc_id", (F.col("r_regionkey") * 100 + F.col("n")).cast("bigint"))
    return rejects(extract_documents(documents)).select("doc_id", "code")


def relationship_join(spark, sf_dir):
    """Decks whose slide numbers are the relationship ids: one that is declared for several blocks means the last of them, one of a slide with
    a block of many words is not declared and left out."""
    blocks = upload_blocks(spark, sf_dir, ["Slide"]).select("upload_id", "block_no", F.concat(F.lit("r"), F.col("slide").cast("string")).alias("rid"), F.coalesce(F.array_join(_lines(), " "), F.lit("")).alias("text")).where("text <> ''")
    known = blocks.groupBy("upload_id", "rid").agg(F.max(F.length("text")).alias("longest"))
    rows = blocks.join(known, ["upload_id", "rid"]).groupBy(F.col("upload_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("block_no", "rid", "text", "longest"))).alias("x"))
    parts = rows.select("doc_id", F.transform("x", lambda r: F.concat_ws("\x1f", r["block_no"].cast("string"), r["rid"], F.when(r["longest"] < LONG_SLIDE, "declared").otherwise("not"), r["text"])).alias("parts"))

    def build(lines: list[str]) -> bytes:
        held = [line.split("\x1f") for line in lines]
        return builders.pptx_linked(list(dict.fromkeys(rid for _, rid, _, _ in held)), [(rid, f"p{no}.xml") for no, rid, said, _ in held if said == "declared"], {f"p{no}.xml": text for no, _, _, text in held})

    return _extracted(_built(parts, build)).select("doc_id", "slide", "text")


#: Characters of a slide's longest block from which relationship_join leaves it undeclared.
LONG_SLIDE = 150


# ---- round trips ----


def _paragraph_trip(spark, sf_dir, builder, filename: str = ""):
    return _extracted(_built(_document_lines(spark, sf_dir), builder, filename)).select("doc_id", "block_no", "text")


def docx_roundtrip(spark, sf_dir):
    return _paragraph_trip(spark, sf_dir, lambda p: builders.docx([("", t) for t in p]))


def odt_roundtrip(spark, sf_dir):
    return _paragraph_trip(spark, sf_dir, lambda p: builders.odt([(0, t) for t in p]))


def rtf_roundtrip(spark, sf_dir):
    return _paragraph_trip(spark, sf_dir, lambda p: builders.rtf("\n\n".join(p)))


def epub_roundtrip(spark, sf_dir):
    from html import escape

    chapters = lambda p: ["".join(f"<p>{escape(t)}</p>" for t in p[k : k + 20]) for k in range(0, len(p), 20)]
    return _paragraph_trip(spark, sf_dir, lambda p: builders.epub(chapters(p)))


def html_roundtrip(spark, sf_dir):
    from html import escape

    return _paragraph_trip(spark, sf_dir, lambda p: ("<!doctype html><ul>" + "".join(f"<li>{escape(t)}" for t in p) + "</ul>").encode(), "a.html")


def eml_roundtrip(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array("text").alias("parts"))
    return _extracted(_built(docs, lambda p: builders.eml(p[0]), "m.eml")).select("doc_id", "block_no", "text")


def _deck_trip(spark, sf_dir, builder):
    return _extracted(_built(_decks(spark, sf_dir), builder)).select("doc_id", "slide", "text")


def docx_styles_roundtrip(spark, sf_dir):
    """Headings, list items and paragraphs of uploads by their styles."""
    blocks = upload_blocks(spark, sf_dir, ["Section"]).select(F.col("upload_id").alias("doc_id"), "block_no", "kind", "block_level", F.array_join(_lines(), " ").alias("text")).where("text <> ''")
    style = F.when(F.col("kind") == "Heading", F.concat(F.lit("heading "), F.col("block_level").cast("string"))).when(F.col("kind") == "ListItem", "List").otherwise("")
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", F.concat_ws("\x1f", style, "text").alias("line")))).alias("x"))
    made = _built(rows.select("doc_id", F.transform("x", lambda r: r["line"]).alias("parts")), lambda p: builders.docx([tuple(line.split("\x1f")) for line in p]))
    return _extracted(made).select("doc_id", "block_no", "kind", "block_level", "text")


def invalid_bytes_roundtrip(spark, sf_dir):
    """Plain text whose lines are parted by runs of bytes that are no UTF-8: each run shows as one replacement character."""
    return _paragraph_trip(spark, sf_dir, lambda p: b"\xff\xfe\x80".join(t.encode() for t in p), "a.txt")


def duplicate_members(spark, sf_dir):
    """Archives with two members of each name: the first counts."""
    return _paragraph_trip(spark, sf_dir, lambda p: builders.odt([(0, t) for t in p], then={"content.xml": "<x>not this</x>", "mimetype": "application/epub+zip"}))


def eml_quoted_printable(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array("text").alias("parts"))
    return _extracted(_built(docs, lambda p: builders.eml(p[0].replace("\r\n", "\n"), quoted_printable=True), "m.eml")).select("doc_id", "block_no", "text")


def odp_roundtrip(spark, sf_dir):
    return _deck_trip(spark, sf_dir, builders.odp)


def pptx_order_roundtrip(spark, sf_dir):
    return _deck_trip(spark, sf_dir, builders.pptx)


def pptx_file_order(spark, sf_dir):
    """Decks without a presentation part: slides by the numbers in their names."""
    return _deck_trip(spark, sf_dir, builders.pptx_loose)


def _sheet_trip(spark, sf_dir, builder, filename: str = ""):
    return _extracted(_built(_customer_rows(spark, sf_dir), builder, filename)).select("doc_id", "row_no", F.array_join("cells", "|").alias("line"))


def csv_roundtrip(spark, sf_dir):
    return _sheet_trip(spark, sf_dir, lambda p: builders.delimited(_grid(p)), "a.csv")


def tsv_roundtrip(spark, sf_dir):
    return _sheet_trip(spark, sf_dir, lambda p: builders.delimited(_grid(p), "\t"), "a.tsv")


def ods_roundtrip(spark, sf_dir):
    return _sheet_trip(spark, sf_dir, lambda p: builders.ods({"s": _grid(p)}))


def xlsx_roundtrip(spark, sf_dir):
    return _sheet_trip(spark, sf_dir, lambda p: builders.xlsx({"s": _grid(p)}))


def _line_cells(spark, sf_dir, table: str, key: str, cells: list[Column], order: list[str]) -> DataFrame:
    """Sheets of a table by ranges of its key, cells joined by a separator."""
    rows = read_table(spark, sf_dir, table).select(F.floor(F.col(key) / SHEET_ROWS).cast("bigint").alias("doc_id"), *order, F.concat_ws("\x1f", *cells).alias("line"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("x")).select("doc_id", F.transform("x", lambda r: r["line"]).alias("parts"))


def xlsx_typed_roundtrip(spark, sf_dir):
    """Quantities, percentages, prices and dates of order lines, stored as numbers and shown by their format codes."""
    days = F.datediff(F.col("l_shipdate"), F.lit("1899-12-30").cast("date")).cast("string")
    columns = [F.col("l_orderkey").cast("string"), *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_extendedprice")], days, days]
    rows = _line_cells(spark, sf_dir, "lineitem", "l_orderkey", columns, ["l_orderkey", "l_linenumber"])
    codes = [None, "0.0", "0%", "#,##0.00", "yyyy-mm-dd", "d-mmm-yy"]
    made = _built(rows, lambda p: builders.coded_xlsx(_grid(p), codes))
    return _extracted(made).select("doc_id", "row_no", F.array_join("cells", "|").alias("line"))


def ods_values_roundtrip(spark, sf_dir):
    """Parts with a repeated cell, an empty one, and a stored price under a text that only shows it."""
    rows = _line_cells(spark, sf_dir, "part", "p_partkey", [F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_size").cast("string")], ["p_partkey"])
    row = lambda key, brand, size: [(brand, "", 3), ("", "", 2), (f"about {size}", size, 1), (key, "", 1), ("", "", 500)]
    made = _built(rows, lambda p: builders.ods_values([row(*line.split("\x1f")) for line in p]))
    return _extracted(made).select("doc_id", "row_no", F.array_join("cells", "|").alias("line"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        *(token_estimate, split_paragraphs, hard_split, col_letter, strip_quoted, detect_formats),
        *(text_chunks_default, text_chunks_small, line_pack, line_pack_overlap, heading_path, prose_chunks),
        *(sheet_rows_serialized, sheet_summary, sheet_chunks, slide_chunks, customer_sheets),
        *(upload_chunks, html_paragraphs, framed_uploads, rejected_documents, relationship_join),
        *(docx_roundtrip, odt_roundtrip, rtf_roundtrip, epub_roundtrip, html_roundtrip, eml_roundtrip),
        *(invalid_bytes_roundtrip, duplicate_members, docx_styles_roundtrip, eml_quoted_printable, pptx_file_order, xlsx_typed_roundtrip, ods_values_roundtrip),
        *(odp_roundtrip, pptx_order_roundtrip, csv_roundtrip, tsv_roundtrip, ods_roundtrip, xlsx_roundtrip),
    )
}

# ---- equivalent SQL ----

_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _lines_sql(x: str) -> str:
    plain = f"regexp_replace({x}, '[\\x00-\\x09\\x0B-\\x1F\\x7F\\x{{FFFE}}\\x{{FFFF}}]', ' ', 'g')"
    return f"list_filter(list_transform(string_split({plain}, chr(10)), lambda t: {_trim('t')}), lambda t: t <> '')"


def _paragraphs_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda p: {_trim('p')}), lambda p: p <> '')"


_TOKENS = "CAST(CASE WHEN strlen({0}) = 0 THEN 0 ELSE greatest(1, strlen({0}) // 4) END AS INTEGER)"

_SIZES = """
    sizes AS (
        SELECT upload_id, target, overlap_chars AS asked, greatest(CASE WHEN max_chars > 0 THEN max_chars ELSE 6000 END, target) AS most FROM (
            SELECT *, CASE WHEN target_chars > 0 THEN target_chars ELSE 5500 END AS target, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC) AS n FROM uploads)
        WHERE n = 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC) AS n FROM blocks) WHERE n = 1)"""


def _cut_sql(source: str, keys: str, limit: str, made: str = "pieces") -> str:
    """Recursive pieces of at most `limit` bytes of the rows (keys, text) of `source`: pieces(keys, piece, n)."""
    fit = f"substring(rest, 1, list_max(list_filter(range(least({limit}, length(rest)) // 4, least({limit}, length(rest)) + 1), lambda k: strlen(substring(rest, 1, CAST(k AS INTEGER))) <= {limit})))"
    return f"""
    {made}_cut AS (
        SELECT {keys}, CASE WHEN strlen(text) <= {limit} THEN text END AS whole, text AS rest, CAST('' AS VARCHAR) AS piece, CAST(-1 AS INTEGER) AS n FROM {source}
        UNION ALL
        SELECT {keys}, NULL, substring(rest, length(p) + 1), p, n + 1 FROM (SELECT *, CASE WHEN strlen(rest) <= {limit} THEN rest ELSE {fit} END AS p FROM {made}_cut WHERE rest <> '')
    ),
    {made} AS (SELECT {keys}, piece, n FROM {made}_cut WHERE n >= 0)"""


def _prose_sql(items: str, target: int, most: int, extra: str = "") -> str:
    """Chunks without headings and overlap of items(doc_id, n, t)."""
    return f"""
    WITH RECURSIVE {items},
    numbered AS (SELECT doc_id, t, strlen(t) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n FROM items),
    fold AS (
        SELECT doc_id, n, t, b, 0 AS grp, b AS held, b > {most} AS closed FROM numbered WHERE n = 1
        UNION ALL
        SELECT x.doc_id, x.n, x.t, x.b,
               f.grp + CAST(x.b > {most} OR f.closed OR f.held + x.b > {target} AS INTEGER),
               CASE WHEN x.b > {most} OR f.closed OR f.held + x.b > {target} THEN x.b ELSE f.held + x.b END, x.b > {most}
        FROM fold f JOIN numbered x ON x.doc_id = f.doc_id AND x.n = f.n + 1
    ),
    groups AS (SELECT doc_id, grp, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM fold GROUP BY ALL),
    {_cut_sql("groups", "doc_id, grp", str(most))}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, n) - 1 AS INTEGER) AS idx, piece AS text, {_TOKENS.format("piece")} AS token_count{extra} FROM pieces"""


def _closing_sql(x: str, size: str) -> str:
    """The last words of x, of at most `size` bytes."""
    end = f"right({x}, list_max(list_filter(range(CAST({size} // 4 AS BIGINT), CAST({size} + 1 AS BIGINT)), lambda k: strlen(right({x}, CAST(k AS INTEGER))) <= {size})))"
    words = f"CASE WHEN regexp_matches({end}, '^[^ \\n\\t]*[ \\n\\t](?s:.)') THEN regexp_replace({end}, '^[^ \\n\\t]*[ \\n\\t]', '') ELSE {end} END"
    return f"CASE WHEN {size} <= 0 THEN '' WHEN strlen({x}) <= {size} THEN {_trim(x)} ELSE {_trim(words)} END"


def _filled_sql(keys: str) -> str:
    """Bodies of sections, filled with overlap: filled(keys, label, target, most, overlap, grp, body, alone) from
    numbered(keys, label, target, most, overlap, k, t), where k counts the bodies of a section."""
    same = " AND ".join(f"x.{key} = f.{key}" for key in keys.split(", "))
    new = "(NOT f.open OR strlen(x.t) > x.most OR f.held + strlen(x.t) > x.target)"
    tail = f"CASE WHEN f.open AND strlen(x.t) <= x.most THEN {_closing_sql('f.body', 'x.overlap')} ELSE '' END"
    names = ", ".join(f"x.{key}" for key in keys.split(", "))
    return f"""
    fold AS (
        SELECT {keys}, label, target, most, overlap, k, 0 AS grp, t AS body, strlen(t) AS held, strlen(t) <= most AS open FROM numbered WHERE k = 1
        UNION ALL
        SELECT {names}, x.label, x.target, x.most, x.overlap, x.k, f.grp + CAST({new} AS INTEGER),
               CASE WHEN NOT {new} THEN f.body || chr(10) || chr(10) || x.t WHEN {tail} <> '' THEN {tail} || chr(10) || chr(10) || x.t ELSE x.t END,
               CASE WHEN {new} THEN strlen(x.t) + strlen({tail}) ELSE f.held + strlen(x.t) END, strlen(x.t) <= x.most
        FROM fold f JOIN numbered x ON {same} AND x.k = f.k + 1),
    filled AS (SELECT {keys}, label, target, most, overlap, grp, max_by(body, k) AS body, NOT bool_and(open) AS alone FROM fold GROUP BY ALL)"""


_SECTIONS = f"""
    p AS (
        SELECT b.upload_id, block_no, kind, anchor_kind, greatest(coalesce(block_level, 1), 1) AS lv, {_trim("coalesce(text, '')")} AS t, coalesce(target, 5500) AS target, coalesce(most, 6000) AS most,
               least(greatest(coalesce(asked, 0), 0), coalesce(target, 5500) - 1) AS overlap, row_number() OVER (PARTITION BY b.upload_id ORDER BY block_no) AS n
        FROM b LEFT JOIN sizes USING (upload_id) WHERE anchor_kind IN ('Section', 'Email')),
    walk AS (
        SELECT upload_id, n, CAST(kind = 'Heading' AS INTEGER) AS section, CASE WHEN kind = 'Heading' THEN list_concat(list_transform(range(lv - 1), lambda x: ''), [t]) ELSE CAST([] AS VARCHAR[]) END AS path FROM p WHERE n = 1
        UNION ALL
        SELECT p.upload_id, p.n, w.section + CAST(p.kind = 'Heading' AS INTEGER),
               CASE WHEN p.kind = 'Heading' THEN list_concat(list_transform(range(1, p.lv), lambda k: coalesce(w.path[k], '')), [p.t]) ELSE w.path END
        FROM walk w JOIN p ON p.upload_id = w.upload_id AND p.n = w.n + 1),
    numbered AS (
        SELECT upload_id, section, array_to_string(list_filter(path, lambda x: x <> ''), ' › ') AS label, target, most, overlap, row_number() OVER (PARTITION BY upload_id, section ORDER BY n) AS k, t
        FROM walk JOIN p USING (upload_id, n) WHERE kind <> 'Heading' AND t <> '')"""

_PARAGRAPH_ITEMS = f"items AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS t FROM (SELECT doc_id, {_paragraphs_sql('text')} AS p FROM documents WHERE text <> ''))"
_LINE_ITEMS = f"items AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS t FROM (SELECT doc_id, {_lines_sql('text')} AS p FROM documents WHERE text IS NOT NULL))"


def _line_trip(shown: str) -> str:
    return f"SELECT doc_id, CAST(n - 1 AS INTEGER) AS block_no, {shown} AS text FROM (SELECT doc_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS t FROM (SELECT doc_id, {_lines_sql('text')} AS p FROM documents WHERE text IS NOT NULL))"


_COLLAPSED = f"trim(regexp_replace(t, '{_WS}+', ' ', 'g'))"
_DECK_TRIP = f"""
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC) AS n FROM blocks) WHERE n = 1 AND kind = 'SlideBody')
    SELECT upload_id AS doc_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY block_no) AS INTEGER) AS slide, t AS text
    FROM (SELECT upload_id, block_no, array_to_string({_lines_sql('text')}, chr(10)) AS t FROM b WHERE text IS NOT NULL) WHERE t <> ''"""
_SHEET_KEY = "CAST(c_custkey // 1000 * 100 + c_nationkey AS BIGINT)"
_SHEET_TRIP = f"""
    SELECT {_SHEET_KEY} AS doc_id, CAST(1 + row_number() OVER (PARTITION BY {_SHEET_KEY} ORDER BY c_custkey) AS INTEGER) AS row_no, concat_ws('|', c_custkey, c_name, c_mktsegment) AS line FROM customer
    UNION ALL SELECT DISTINCT {_SHEET_KEY}, 1, 'key|name|segment' FROM customer"""

_LETTER = "CASE WHEN {0} < 26 THEN chr(65 + {0}) WHEN {0} < 702 THEN chr(65 + ({0} - 26) // 26) || chr(65 + ({0} - 26) % 26) ELSE chr(65 + ({0} - 702) // 676) || chr(65 + ({0} - 702) // 26 % 26) || chr(65 + ({0} - 702) % 26) END"
_NAMED = "'Sheet \"' || replace(replace(sheet, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
_ROWS = f"""
    r AS (
        SELECT upload_id, coalesce(sheet, '') AS sheet, block_no, row_no, coalesce(cells, CAST([] AS VARCHAR[])) AS cells FROM b WHERE kind = 'SheetRow'),
    s AS (
        SELECT *, row_number() OVER w AS place, first_value(cells) OVER w AS header, min(block_no) OVER v AS sheet_order, count(*) OVER v AS rows, CAST(max(len(cells)) OVER v - 1 AS INTEGER) AS width,
               first_value(row_no) OVER w AS first_row, max(row_no) OVER v AS last_row
        FROM r WINDOW w AS (PARTITION BY upload_id, sheet ORDER BY block_no), v AS (PARTITION BY upload_id, sheet)),
    lines AS (
        SELECT *, {_LETTER.format("greatest(width, 0)")} AS last_column,
               array_to_string(list_concat(CASE WHEN sheet <> '' THEN [{_NAMED}] ELSE [] END,
                   list_filter(list_transform(range(1, len(cells) + 1), lambda k: CASE WHEN {_trim("coalesce(cells[k], '')")} <> '' THEN
                       CASE WHEN {_trim("coalesce(header[k], '')")} <> '' THEN {_trim("header[k]")} ELSE 'Col ' || {_LETTER.format("CAST(k - 1 AS INTEGER)")} END || ': ' || {_trim("cells[k]")} END), lambda x: x IS NOT NULL)), ' | ') AS line
        FROM s)"""
_SUMMARY = f"""
    summary AS (
        SELECT upload_id, sheet, min(sheet_order) AS sheet_order,
               CASE WHEN sheet <> '' THEN {_NAMED} || ' — ' ELSE '' END || 'columns: ' ||
               array_to_string(list_filter(list_transform(any_value(header), lambda h: {_trim("coalesce(h, '')")}), lambda h: h <> ''), ', ') || '. ' || (max(rows) - 1) || ' data rows.' ||
               CASE WHEN max(rows) > 1 THEN chr(10) || 'Sample rows:' || string_agg(chr(10) || line, '' ORDER BY place) FILTER (place BETWEEN 2 AND 4) ELSE '' END AS text,
               CASE WHEN sheet <> '' THEN {_NAMED} || ' summary' ELSE 'Summary' END AS source_label,
               'A' || any_value(first_row) || ':' || any_value(last_column) || max_by(row_no, place) AS cell_range
        FROM lines GROUP BY upload_id, sheet)"""

_SHEET_CHUNKS = f"""
        d AS (SELECT upload_id, sheet, sheet_order, last_column, row_no, line, strlen(line) AS n, target, most, row_number() OVER (PARTITION BY upload_id, sheet ORDER BY place) AS k FROM lines LEFT JOIN sizes USING (upload_id) WHERE place > 1 AND line <> ''),
        fold AS (
            SELECT *, 0 AS grp, n AS held, n > coalesce(most, 6000) AS one FROM d WHERE k = 1
            UNION ALL
            SELECT d.*, f.grp + CAST(d.n > coalesce(d.most, 6000) OR f.one OR f.held + d.n > coalesce(d.target, 5500) AS INTEGER),
                   CASE WHEN d.n > coalesce(d.most, 6000) OR f.one OR f.held + d.n > coalesce(d.target, 5500) THEN d.n ELSE f.held + d.n END, d.n > coalesce(d.most, 6000)
            FROM fold f JOIN d ON d.upload_id = f.upload_id AND d.sheet = f.sheet AND d.k = f.k + 1),
        packed AS (
            SELECT upload_id, sheet, sheet_order, grp, string_agg(line, chr(10) ORDER BY k) AS text,
                   CASE WHEN sheet <> '' THEN {_NAMED} || ' ' ELSE '' END || CASE WHEN sheet <> '' THEN 'row' ELSE 'Row' END || CASE WHEN bool_or(one) THEN ' ' || min_by(row_no, k) ELSE 's ' || min_by(row_no, k) || '-' || max_by(row_no, k) END AS source_label,
                   'A' || min_by(row_no, k) || ':' || any_value(last_column) || max_by(row_no, k) AS cell_range
            FROM fold GROUP BY upload_id, sheet, sheet_order, grp),
        every AS (
            SELECT upload_id, sheet_order, grp, text, source_label, cell_range, coalesce(most, 6000) AS most FROM
                (SELECT upload_id, sheet_order, -1 AS grp, text, source_label, cell_range FROM summary UNION ALL SELECT upload_id, sheet_order, grp, text, source_label, cell_range FROM packed) LEFT JOIN sizes USING (upload_id)),
        {_cut_sql("every", "upload_id, sheet_order, grp, source_label, cell_range, most", "most")}
        SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY sheet_order, grp, n) - 1 AS INTEGER) AS idx, piece AS text, source_label, cell_range, {_TOKENS.format("piece")} AS token_count FROM pieces"""

_MAIL_TRIP = f"""
        SELECT doc_id, CAST(unnest(generate_series(1, len(p))) - 1 AS INTEGER) AS block_no, unnest(p) AS text FROM (
            SELECT doc_id, {_paragraphs_sql("array_to_string(list_filter(CASE WHEN list_position(l, '-- ') > 0 THEN l[1:list_position(l, '-- ') - 1] ELSE l END, lambda x: NOT starts_with(" + _trim("x") + ", '>')), chr(10))")} AS p
            FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""

ORACLES: dict[str, str] = {
    "token_estimate": f"SELECT doc_id, {_TOKENS.format('text')} AS token_count FROM documents WHERE text IS NOT NULL",
    "split_paragraphs": f"SELECT doc_id, CAST(unnest(generate_series(1, len(p))) - 1 AS INTEGER) AS n, unnest(p) AS paragraph FROM (SELECT doc_id, {_paragraphs_sql('text')} AS p FROM documents WHERE text IS NOT NULL)",
    "hard_split": f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents WHERE text <> ''), {_cut_sql('src', 'doc_id', '1000')} SELECT doc_id, n, piece AS text, 1000 AS maximum FROM pieces",
    "col_letter": f"SELECT CAST(s_suppkey AS INTEGER) AS n, {_LETTER.format('CAST(s_suppkey AS INTEGER)')} AS letter FROM supplier",
    "strip_quoted": f"""
        SELECT DISTINCT block_id, array_to_string(list_filter(CASE WHEN list_position(l, '-- ') > 0 THEN l[1:list_position(l, '-- ') - 1] ELSE l END, lambda x: NOT starts_with({_trim('x')}, '>')), chr(10)) AS kept
        FROM (SELECT block_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM blocks WHERE anchor_kind = 'Email' AND text IS NOT NULL)""",
    "detect_formats": r"""
        WITH u AS (
            SELECT upload_id, hex(content_bytes) AS h, lower(regexp_extract(regexp_extract(coalesce(filename, ''), '([^/]*)$', 1), '(\.[^.]*)$', 1)) AS ext, lower(coalesce(content_type, '')) AS ct
            FROM uploads WHERE content_bytes IS NOT NULL),
        k AS (
            SELECT *, CASE WHEN ext <> '' THEN ext WHEN contains(ct, 'csv') THEN '.csv' WHEN contains(ct, 'tab-separated') THEN '.tsv' WHEN contains(ct, 'html') THEN '.html' WHEN contains(ct, 'rfc822') THEN '.eml' WHEN contains(ct, 'rtf') THEN '.rtf' ELSE '' END AS hint,
                   regexp_replace(substring(h, 1, 2048), '(..)', '\1.', 'g') AS head FROM u)
        SELECT DISTINCT upload_id, CASE
            WHEN h = '' THEN 'INVALID' WHEN starts_with(h, 'D0CF11E0A1B11AE1') THEN 'UNSUPPORTED' WHEN starts_with(h, '7B5C727466') THEN 'rtf'
            WHEN starts_with(h, '504B0304') AND NOT contains(h, '504B0506') THEN 'INVALID' -- no directory, so no archive
            WHEN hint = '.csv' THEN 'csv' WHEN hint = '.tsv' THEN 'tsv' WHEN hint IN ('.html', '.htm', '.xhtml') THEN 'html' WHEN hint = '.eml' THEN 'eml' WHEN hint = '.rtf' THEN 'rtf' WHEN hint IN ('.txt', '.log') THEN 'txt'
            WHEN regexp_matches(head, '3C\.21\.[46]4\.[46]F\.[46]3\.[57]4\.[57]9\.[57]0\.[46]5\.20\.[46]8\.[57]4\.[46]D\.[46]C\.|3C\.[46]8\.[57]4\.[46]D\.[46]C\.|3C\.[46]2\.[46]F\.[46]4\.[57]9\.') THEN 'html' ELSE 'txt' END AS found
        FROM k""",
    "text_chunks_default": _prose_sql(_PARAGRAPH_ITEMS, 5500, 6000),
    "text_chunks_small": _prose_sql(_PARAGRAPH_ITEMS, 700, 900),
    "line_pack": _prose_sql(_LINE_ITEMS, 500, 6000, ", '' AS source_label"),
    "line_pack_overlap": f"""
        WITH RECURSIVE {_LINE_ITEMS},
        numbered AS (SELECT doc_id, '' AS label, 500 AS target, 6000 AS most, 80 AS overlap, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, t FROM items),
        {_filled_sql("doc_id")},
        whole AS (SELECT doc_id, grp, body AS text FROM filled),
        {_cut_sql("whole", "doc_id, grp", "6000")}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, n) - 1 AS INTEGER) AS idx, piece AS text, '' AS source_label, {_TOKENS.format("piece")} AS token_count FROM pieces""",
    "prose_chunks": f"""
        WITH RECURSIVE {_SIZES}, {_SECTIONS}, {_filled_sql("upload_id, section")},
        bodies AS (SELECT upload_id, section, label, grp, most, CASE WHEN alone THEN most ELSE 2147483647 END AS part, body AS text FROM filled),
        {_cut_sql("bodies", "upload_id, section, label, grp, most, part", "part", "parts")},
        labelled AS (SELECT upload_id, section, label, grp, most, n AS part_no, CASE WHEN label <> '' THEN label || chr(10) || chr(10) ELSE '' END || piece AS text FROM parts),
        {_cut_sql("labelled", "upload_id, section, label, grp, most, part_no", "most")},
        mail AS (SELECT upload_id, bool_or(kind <> 'Heading' AND anchor_kind = 'Email') AS mail FROM p GROUP BY upload_id)
        SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY section, grp, part_no, n) - 1 AS INTEGER) AS idx, piece AS text, label AS source_label, CASE WHEN mail THEN 'Email' ELSE 'Section' END AS anchor_kind,
               0 AS slide, '' AS sheet, '' AS cell_range, label AS heading_path, {_TOKENS.format("piece")} AS token_count FROM pieces JOIN mail USING (upload_id)""",
    "html_paragraphs": f"""
        WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC) AS n FROM uploads WHERE content_bytes IS NOT NULL) WHERE n = 1),
        k AS (SELECT upload_id, decode(content_bytes) AS x, hex(content_bytes) AS h, lower(regexp_extract(regexp_extract(coalesce(filename, ''), '([^/]*)$', 1), '(\\.[^.]*)$', 1)) AS ext, lower(coalesce(content_type, '')) AS ct FROM u WHERE content_bytes <> ''::BLOB AND NOT starts_with(hex(content_bytes), '504B0304') AND NOT starts_with(hex(content_bytes), 'D0CF11E0A1B11AE1') AND NOT starts_with(hex(content_bytes), '7B5C727466') AND try(decode(content_bytes)) IS NOT NULL),
        f AS (SELECT upload_id, x FROM k WHERE ext IN ('.html', '.htm', '.xhtml') OR ext = '' AND contains(ct, 'html') AND NOT contains(ct, 'csv') AND NOT contains(ct, 'tab-separated')
              OR regexp_matches(lower(left(x, 1024)), '<!doctype html|<html|<body') AND ext NOT IN ('.csv', '.tsv', '.eml', '.rtf', '.txt', '.log') AND NOT (ext = '' AND regexp_matches(ct, 'csv|tab-separated|rfc822|rtf'))),
        e AS (SELECT upload_id, unnest(regexp_extract_all(x, '<(?:h[1-6]|p|li|td|th|blockquote|pre|caption|figcaption)[^>]*>((?s:.*?))</(?:h[1-6]|p|li|td|th|blockquote|pre|caption|figcaption)>', 1)) AS t, unnest(generate_series(1, len(regexp_extract_all(x, '<(?:h[1-6]|p|li|td|th|blockquote|pre|caption|figcaption)[^>]*>((?s:.*?))</(?:h[1-6]|p|li|td|th|blockquote|pre|caption|figcaption)>', 1)))) AS n FROM f),
        d AS (SELECT upload_id, n, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '{_WS}+', ' ', 'g')) AS t FROM e)
        SELECT DISTINCT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY n) - 1 AS INTEGER) AS block_no, t AS text FROM d WHERE t <> ''""",
    "heading_path": f"""
        WITH RECURSIVE {_SIZES},
        p AS (SELECT upload_id, block_no, kind, greatest(coalesce(block_level, 1), 1) AS lv, {_trim("coalesce(text, '')")} AS t, row_number() OVER (PARTITION BY upload_id ORDER BY block_no) AS n FROM b WHERE anchor_kind = 'Section'),
        walk AS (
            SELECT upload_id, block_no, n, CAST(kind = 'Heading' AS INTEGER) AS section, CASE WHEN kind = 'Heading' THEN list_concat(list_transform(range(lv - 1), lambda x: ''), [t]) ELSE CAST([] AS VARCHAR[]) END AS path FROM p WHERE n = 1
            UNION ALL
            SELECT p.upload_id, p.block_no, p.n, w.section + CAST(p.kind = 'Heading' AS INTEGER),
                   CASE WHEN p.kind = 'Heading' THEN list_concat(list_transform(range(1, p.lv), lambda k: coalesce(w.path[k], '')), [p.t]) ELSE w.path END
            FROM walk w JOIN p ON p.upload_id = w.upload_id AND p.n = w.n + 1)
        SELECT upload_id, block_no, section, array_to_string(list_filter(path, lambda x: x <> ''), ' › ') AS path FROM walk""",
    "sheet_rows_serialized": f"WITH {_SIZES}, {_ROWS} SELECT upload_id, sheet, block_no, line FROM lines WHERE place > 1",
    "sheet_summary": f"WITH {_SIZES}, {_ROWS}, {_SUMMARY} SELECT upload_id, sheet, text, source_label, cell_range FROM summary",
    "sheet_chunks": f"WITH RECURSIVE {_SIZES}, {_ROWS}, {_SUMMARY}, {_SHEET_CHUNKS}",
    "customer_sheets": f"""
        WITH RECURSIVE rows AS ({_SHEET_TRIP}),
        b AS (SELECT doc_id AS upload_id, 'SheetRow' AS kind, '' AS sheet, CAST(row_no - 1 AS INTEGER) AS block_no, row_no, string_split(line, '|') AS cells FROM rows),
        sizes AS (SELECT DISTINCT doc_id AS upload_id, 2000 AS target, 6000 AS most FROM rows),
        {_ROWS}, {_SUMMARY}, {_SHEET_CHUNKS.replace("SELECT upload_id, CAST(row_number", "SELECT upload_id AS doc_id, CAST(row_number")}""",
    "slide_chunks": f"""
        WITH RECURSIVE {_SIZES},
        t AS (SELECT upload_id, coalesce(slide, 0) AS slide, block_no, {_trim("coalesce(text, '')")} AS t FROM b WHERE anchor_kind = 'Slide'),
        u AS (SELECT upload_id, slide, min(block_no) AS first_no, string_agg(t, chr(10) ORDER BY block_no) FILTER (t <> '') AS text FROM t GROUP BY upload_id, slide),
        d AS (SELECT upload_id, slide, 'Slide ' || slide || chr(10) || text AS text, coalesce(target, 5500) AS target, coalesce(most, 6000) AS most, row_number() OVER (PARTITION BY upload_id ORDER BY first_no) AS k FROM u LEFT JOIN sizes USING (upload_id) WHERE text IS NOT NULL),
        fold AS (
            SELECT *, 0 AS grp, strlen(text) AS held FROM d WHERE k = 1
            UNION ALL
            SELECT d.*, f.grp + CAST(f.held + strlen(d.text) > d.target AS INTEGER), CASE WHEN f.held + strlen(d.text) > d.target THEN strlen(d.text) ELSE f.held + strlen(d.text) END
            FROM fold f JOIN d ON d.upload_id = f.upload_id AND d.k = f.k + 1),
        packed AS (
            SELECT upload_id, grp, any_value(most) AS most, min_by(slide, k) AS slide, CASE WHEN min_by(slide, k) = max_by(slide, k) THEN 'Slide ' || min_by(slide, k) ELSE 'Slides ' || min_by(slide, k) || '-' || max_by(slide, k) END AS source_label,
                   string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM fold GROUP BY upload_id, grp),
        {_cut_sql("packed", "upload_id, grp, most, slide, source_label", "most")}
        SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY grp, n) - 1 AS INTEGER) AS idx, piece AS text, source_label, slide, {_TOKENS.format("piece")} AS token_count FROM pieces""",
    "framed_uploads": """
        SELECT upload_id, md5(content_bytes) AS digest, coalesce(filename, '') AS filename, coalesce(target_chars, 0) AS target_chars FROM
            (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC) AS n FROM uploads WHERE content_bytes IS NOT NULL) WHERE n = 1""",
    "rejected_documents": "SELECT CAST(r_regionkey * 100 + n AS BIGINT) AS doc_id, code FROM region, (VALUES (1, 'INVALID'), (2, 'UNSUPPORTED'), (3, 'INVALID'), (4, 'UNSUPPORTED'), (5, 'INVALID'), (6, 'INVALID'), (7, 'INVALID'), (8, 'INVALID')) v(n, code)",
    "relationship_join": f"""
        WITH {_SIZES},
        t AS (SELECT upload_id, block_no, slide, coalesce(array_to_string({_lines_sql('text')}, ' '), '') AS t FROM b WHERE anchor_kind = 'Slide'),
        s AS (SELECT upload_id, slide, min(block_no) AS first_no, max(length(t)) AS longest, max_by(t, block_no) AS t FROM t WHERE t <> '' GROUP BY upload_id, slide)
        SELECT upload_id AS doc_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY first_no) AS INTEGER) AS slide, t AS text FROM s WHERE longest < {LONG_SLIDE}""",
    "docx_styles_roundtrip": f"""
        WITH {_SIZES},
        t AS (SELECT upload_id, block_no, kind, block_level, array_to_string({_lines_sql('text')}, ' ') AS t FROM b WHERE anchor_kind = 'Section' AND text IS NOT NULL)
        SELECT upload_id AS doc_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY block_no) - 1 AS INTEGER) AS block_no, CASE WHEN kind = 'Caption' THEN 'Paragraph' ELSE kind END AS kind,
               CAST(CASE WHEN kind = 'Heading' THEN block_level ELSE 0 END AS INTEGER) AS block_level, t AS text FROM t WHERE t <> ''""",
    "pptx_file_order": _DECK_TRIP,
    "xlsx_typed_roundtrip": """
        SELECT CAST(l_orderkey // 1000 AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_extendedprice AS VARCHAR), l_shipdate) AS INTEGER) AS row_no,
               concat_ws('|', l_orderkey, format('{:.1f}', l_quantity), CAST(round(l_discount * 100) AS INTEGER) || '%', format('{:,.2f}', l_extendedprice), strftime(l_shipdate, '%Y-%m-%d'), strftime(l_shipdate, '%-d-%b-%y')) AS line FROM lineitem""",
    "ods_values_roundtrip": """
        SELECT CAST(p_partkey // 1000 AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) AS INTEGER) AS row_no,
               concat_ws('|', p_brand, p_brand, p_brand, '', '', p_size, p_partkey) AS line FROM part""",
    "docx_roundtrip": _line_trip("t"),
    "odt_roundtrip": _line_trip("t"),
    "rtf_roundtrip": _line_trip("t"),
    "duplicate_members": _line_trip("t"),
    "invalid_bytes_roundtrip": f"SELECT doc_id, CAST(0 AS INTEGER) AS block_no, array_to_string(p, '�') AS text FROM (SELECT doc_id, {_lines_sql('text')} AS p FROM documents WHERE text IS NOT NULL) WHERE len(p) > 0",
    "epub_roundtrip": _line_trip(_COLLAPSED),
    "html_roundtrip": _line_trip(_COLLAPSED),
    "eml_roundtrip": _MAIL_TRIP,
    "eml_quoted_printable": _MAIL_TRIP,
    "odp_roundtrip": _DECK_TRIP,
    "pptx_order_roundtrip": _DECK_TRIP,
    "csv_roundtrip": _SHEET_TRIP,
    "tsv_roundtrip": _SHEET_TRIP,
    "ods_roundtrip": _SHEET_TRIP,
    "xlsx_roundtrip": _SHEET_TRIP,
}
