"""Blocks to anchored chunks: prose by heading, sheets by rows, slides by slides.

Each chunker takes blocks with the key columns of a document, block_no, kind, block_level, text, cells, row_no, anchor_kind, slide
and sheet, and the sizes in force (`target`, `overlap`, `maximum`, in bytes). Running state that windows can state (the
header and width of a sheet) is left to Catalyst; the heading path and the greedy fill, which depend on all that went
before, are one pass over sorted rows and hold a batch, not a document. These are for tables of blocks; whole documents
take the same rules in operators/document_chunks.py without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.functions.text import byte_pieces, column_name, tokens_estimated, trim, trimmed
from blockmill.operators.blocks import ANCHOR_CODES, HEADING, Block
from blockmill.operators.document_chunks import PATH_MARK, SAMPLE_ROWS, Chunk, below, chunks_of, fill_section, labels, opens_group

CHUNK_COLUMNS = ["idx", "text", "source_label", "anchor_kind", "anchor_code", "page_start", "page_end", "slide", "sheet", "cell_range", "heading_path", "token_count"]


# ---- shared steps ----


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else byte_pieces(t, int(m)) for t, m in zip(texts, limits)])


def cut_to_max(rows: DataFrame, text: str = "text", maximum: str = "maximum", at: str = "piece_no") -> DataFrame:
    """Rows whose text is beyond its maximum become several, numbered in `at`. Only those go to Python."""
    large = F.octet_length(text) > F.col(maximum)
    parts = rows.withColumn("__large", _pieces(F.when(large, F.col(text)), F.col(maximum))).withColumn("__parts", F.coalesce("__large", F.array(text)))
    others = [c for c in rows.columns if c != text]
    return parts.select(*others, F.posexplode_outer("__parts").alias(at, text)).where(F.col(at).isNotNull())


def greedy_groups(rows: DataFrame, keys: list[str], order: list[str], size: str, target: str, alone: str | None = None) -> DataFrame:
    """`rows` with `grp`: consecutive rows of a key share a group while their sizes stay within the target; a row that
    `alone` marks is a group by itself. A group holds at least one row."""
    # The window asks for the rows of a key together and in order, and shuffles only if they are not so already.
    made = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", grp int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group, held = None, -1, None
        for frame in frames:
            groups = []
            single = frame[alone].tolist() if alone else [False] * len(frame)
            for key, n, most, one in zip(zip(*(frame[k].tolist() for k in keys)), frame[size].tolist(), frame[target].tolist(), single):
                if key != now:
                    now, group, held = key, -1, None
                new = opens_group(held, n, most, bool(one))
                group += new
                held = None if one else n if new else held + n
                groups.append(group)
            frame["grp"] = pd.array(groups, dtype="int32")
            yield frame

    return made.mapInPandas(run, schema).drop("__at")


def _code() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ANCHOR_CODES.items() for x in pair]), F.col("anchor_kind"))


def _finished(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Chunks in their common shape, numbered from 0 within a document."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    none = {"slide": F.lit(0), "sheet": F.lit(""), "cell_range": F.lit(""), "heading_path": F.array().cast("array<string>")}
    extra = {c: v for c, v in none.items() if c not in rows.columns}
    out = rows.withColumn("idx", number).withColumns({**extra, "page_start": F.lit(0), "page_end": F.lit(0), "token_count": tokens_estimated(F.col("text")), "anchor_code": _code()})
    return out.select(*keys, *CHUNK_COLUMNS)


def _text(column: str = "text") -> Column:
    return trimmed(F.coalesce(F.col(column), F.lit("")))


# ---- prose ----


def heading_paths(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """`blocks` with `section` (headings so far) and `heading_path` (the headings a block stands under, of any depth, blank ones left
    out): a heading ends all that are not of a higher level. One pass over the sorted rows of a document."""
    made, names = blocks.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("block_no"))), blocks.columns
    marks = ["__kind", "__level", "__text"]
    narrow = made.withColumns({"__kind": F.col("kind"), "__level": F.greatest(F.coalesce("block_level", F.lit(1)), F.lit(1)), "__text": F.when(F.col("kind") == HEADING, F.coalesce("text", F.lit("")))})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", section int, heading_path array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, path, shown, section = None, (), [], 0
        for frame in frames:
            sections, paths = [], []
            for key, kind, level, text in zip(zip(*(frame[k].tolist() for k in keys)), *(frame[c].tolist() for c in marks)):
                if key != now:
                    now, path, shown, section = key, (), [], 0
                if kind == HEADING:
                    path, section = below(path, int(level), trim(text)), section + 1
                    shown = list(labels(path))
                sections.append(section)
                paths.append(shown)
            out = frame[names].copy()
            out["section"] = pd.array(sections, dtype="int32")
            out["heading_path"] = paths
            yield out

    return narrow.mapInPandas(run, schema)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sections(texts: pd.Series, labels: pd.Series, targets: pd.Series, overlaps: pd.Series, maxima: pd.Series) -> pd.Series:
    return pd.Series([fill_section(list(t), label, int(a), int(b), int(c)) for t, label, a, b, c in zip(texts, labels, targets, overlaps, maxima)])


def chunk_prose(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of contiguous body text under one heading path, each with the path as its first line."""
    mail = F.max(F.when((F.col("kind") != "Heading") & (F.col("anchor_kind") == "Email"), 1).otherwise(0)).over(Window.partitionBy(*keys))
    placed = heading_paths(blocks.withColumn("__mail", mail), keys).withColumn("text", _text())
    body = placed.where("kind <> 'Heading' AND text <> ''")
    sections = body.groupBy(*keys, "section").agg(
        F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("__rows"),
        *[F.first(c).alias(c) for c in ("heading_path", "__mail", "target", "overlap", "maximum")],
    )
    label = F.array_join("heading_path", PATH_MARK)
    sections = sections.withColumn("source_label", label).withColumn("anchor_kind", F.when(F.col("__mail") == 1, "Email").otherwise("Section"))
    filled = sections.withColumn("__texts", _sections(F.transform("__rows", lambda r: r["text"]), "source_label", "target", "overlap", "maximum"))
    rows = filled.select(*keys, "section", "source_label", "anchor_kind", "heading_path", F.posexplode_outer("__texts").alias("__part", "text")).where("__part IS NOT NULL")
    return _finished(rows, keys, [F.col("section"), F.col("__part")])


# ---- sheets ----


def _named(sheet: Column) -> Column:
    """Sheet "name", or nothing for a sheet without one."""
    escaped = sheet
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('Sheet "'), escaped, F.lit('"'))


def serialized_row(cells: Column, header: Column, sheet: Column) -> Column:
    """The cells that are not blank as `label: value`, after the name of the sheet."""

    def cell(value: Column, at: Column) -> Column:
        name = trimmed(F.coalesce(F.get(header, at), F.lit("")))
        label = F.when(name != "", name).otherwise(F.concat(F.lit("Col "), column_name(at)))
        shown = trimmed(F.coalesce(value, F.lit("")))
        return F.when(shown != "", F.concat(label, F.lit(": "), shown))

    parts = F.filter(F.transform(cells, cell), lambda x: x.isNotNull())
    return F.array_join(F.concat(F.when(sheet != "", F.array(_named(sheet))).otherwise(F.array().cast("array<string>")), parts), " | ")


def sheet_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sheet, block_no, row_no, place, sheet_order, rows, last_column, header, line): every row of a sheet serialized with the labels of
    its header, which is the first row of the sheet."""
    rows = blocks.where("kind = 'SheetRow'").withColumn("sheet", F.coalesce("sheet", F.lit(""))).withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))
    whole = Window.partitionBy(*keys, "sheet")
    ordered = whole.orderBy("block_no")
    rows = rows.withColumns(
        {
            "place": F.row_number().over(ordered),
            "header": F.first("cells").over(ordered),
            "sheet_order": F.min("block_no").over(whole),
            "rows": F.count("*").over(whole).cast("int"),
            "last_column": column_name(F.max(F.size("cells")).over(whole) - 1),
        }
    )
    return rows.withColumn("line", serialized_row(F.col("cells"), F.col("header"), F.col("sheet")))


def _range(first: Column, last: Column) -> Column:
    return F.concat(F.lit("A"), first.cast("string"), F.lit(":"), F.col("last_column"), last.cast("string"))


def _label(suffix: Column) -> Column:
    bare = F.concat(F.upper(F.substring(suffix, 1, 1)), F.expr("substring(__suffix, 2)"))
    return F.when(F.col("sheet") != "", F.concat(_named(F.col("sheet")), F.lit(" "), suffix)).otherwise(bare)


def sheet_summaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each sheet: its columns, the number of rows and the first of them."""
    held = F.sort_array(F.collect_list(F.when(F.col("place").between(2, SAMPLE_ROWS + 1), F.struct("place", "line"))))
    sheets = rows.groupBy(*keys, "sheet").agg(
        held.alias("__sample"),
        F.min("sheet_order").alias("sheet_order"),
        F.min(F.struct("place", "row_no")).alias("__first"),
        F.max(F.struct("place", "row_no")).alias("__last"),
        *[F.first(c).alias(c) for c in ("header", "rows", "last_column", "target", "maximum")],
    )
    names = F.filter(F.transform("header", lambda h: trimmed(F.coalesce(h, F.lit("")))), lambda h: h != "")
    title = F.when(F.col("sheet") != "", F.concat(_named(F.col("sheet")), F.lit(" — "))).otherwise("")
    counted = F.concat(title, F.lit("columns: "), F.array_join(names, ", "), F.lit(". "), (F.col("rows") - 1).cast("string"), F.lit(" data rows."))
    sample = F.when(F.col("rows") > 1, F.concat(F.lit("\nSample rows:"), F.array_join(F.transform("__sample", lambda s: F.concat(F.lit("\n"), s["line"])), ""))).otherwise("")
    return sheets.withColumn("text", F.concat(counted, sample)).withColumn("cell_range", _range(F.col("__first.row_no"), F.col("__last.row_no"))).withColumn("__suffix", F.lit("summary")).withColumn("source_label", _label(F.col("__suffix")))


def chunk_sheets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """A summary of each sheet, then its rows, as many whole rows in a chunk as the target allows."""
    rows = sheet_rows(blocks, keys)
    columns = [*keys, "sheet", "sheet_order", "text", "source_label", "cell_range", "maximum"]
    summary = sheet_summaries(rows, keys).select(*columns, F.lit(-1).alias("grp"))
    data = rows.where("place > 1 AND line <> ''").select(*keys, "sheet", "sheet_order", "place", "row_no", "line", "last_column", "target", "maximum", F.octet_length("line").alias("__size"), (F.octet_length("line") > F.col("maximum")).alias("__alone"))
    grouped = greedy_groups(data, [*keys, "sheet"], ["place"], "__size", "target", "__alone").groupBy(*keys, "sheet", "grp").agg(
        F.sort_array(F.collect_list(F.struct("place", "line", "row_no"))).alias("__rows"), F.max("__alone").alias("__alone"), *[F.first(c).alias(c) for c in ("sheet_order", "last_column", "maximum")]
    )
    first, last = F.element_at("__rows", 1)["row_no"], F.element_at("__rows", -1)["row_no"]
    suffix = F.when(F.col("__alone"), F.concat(F.lit("row "), first.cast("string"))).otherwise(F.concat(F.lit("rows "), first.cast("string"), F.lit("-"), last.cast("string")))
    packed = grouped.withColumn("text", F.array_join(F.transform("__rows", lambda r: r["line"]), "\n")).withColumn("cell_range", _range(first, last)).withColumn("__suffix", suffix).withColumn("source_label", _label(F.col("__suffix")))
    parts = cut_to_max(summary.unionByName(packed.select(*columns, "grp"))).withColumn("anchor_kind", F.lit("Sheet"))
    return _finished(parts, keys, [F.col("sheet_order"), F.col("grp"), F.col("piece_no")])


# ---- slides ----


def slide_texts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slide, slide_order, text): the texts of each slide, one below the other; slides without text left out."""
    texts = blocks.withColumn("text", _text()).withColumn("slide", F.coalesce("slide", F.lit(0)))
    grouped = texts.groupBy(*keys, "slide").agg(
        F.min("block_no").alias("slide_order"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("block_no", "text")))), lambda x: x["text"]), "\n").alias("text"),
        *[F.first(c).alias(c) for c in ("target", "maximum")],
    )
    return grouped.where("text <> ''")


def chunk_slides(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Whole slides, as many in a chunk as the target allows."""
    units = slide_texts(blocks, keys).withColumn("text", F.concat(F.lit("Slide "), F.col("slide").cast("string"), F.lit("\n"), F.col("text"))).withColumn("__size", F.octet_length("text"))
    grouped = greedy_groups(units, keys, ["slide_order"], "__size", "target").groupBy(*keys, "grp").agg(F.sort_array(F.collect_list(F.struct("slide_order", "slide", "text"))).alias("__rows"), F.first("maximum").alias("maximum"))
    first, last = F.element_at("__rows", 1)["slide"], F.element_at("__rows", -1)["slide"]
    label = F.when(first == last, F.concat(F.lit("Slide "), first.cast("string"))).otherwise(F.concat(F.lit("Slides "), first.cast("string"), F.lit("-"), last.cast("string")))
    packed = grouped.select(*keys, "grp", "maximum", F.array_join(F.transform("__rows", lambda r: r["text"]), "\n\n").alias("text"), label.alias("source_label"), first.alias("slide"), F.lit("Slide").alias("anchor_kind"))
    return _finished(cut_to_max(packed), keys, [F.col("grp"), F.col("piece_no")])


# ---- whole documents ----

_TEXT, _NUMBER = T.StringType(), T.IntegerType()
CHUNKS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("text", _TEXT), ("source_label", _TEXT), ("anchor_kind", _TEXT), ("slide", _NUMBER), ("sheet", _TEXT), ("cell_range", _TEXT), ("heading_path", T.ArrayType(_TEXT)))]))


def as_rows(chunks: list[Chunk]) -> list[dict]:
    return [c._asdict() | {"heading_path": list(c.heading_path)} for c in chunks]


@F.pandas_udf(CHUNKS)
def _document(shapes: pd.Series, blocks: pd.Series, targets: pd.Series, overlaps: pd.Series, maxima: pd.Series) -> pd.Series:
    made = []
    for shape, rows, target, overlap, maximum in zip(shapes, blocks, targets, overlaps, maxima):
        held = [Block(r["kind"], r["block_level"] or 0, r["text"] or "", list(r["cells"]) if r["cells"] is not None else None, r["row_no"] or 0, r["anchor_kind"], r["slide"] or 0, r["sheet"] or "") for r in rows]
        made.append(as_rows(chunks_of(shape, held, int(target), int(overlap), int(maximum))))
    return pd.Series(made)


def exploded_chunks(documents: DataFrame, keys: list[str], column: str = "chunks") -> DataFrame:
    """The rows of an array of chunks, in their common shape."""
    # The outer form: Catalyst would evaluate the chunks again for a filter on the size of a plain one.
    rows = documents.select(*keys, F.posexplode_outer(column).alias("idx", "c")).where("idx IS NOT NULL").select(*keys, "idx", "c.*")
    rows = rows.withColumns({"page_start": F.lit(0), "page_end": F.lit(0), "token_count": tokens_estimated(F.col("text")), "anchor_code": _code()})
    return rows.select(*keys, *CHUNK_COLUMNS)


def chunk_blocks(blocks: DataFrame, keys: list[str], shape_col: str = "shape") -> DataFrame:
    """Chunks of a table of blocks of any shape; `shape_col` says which chunker a document takes. The blocks of a document are brought
    together (they are those of one file of at most 150 MiB) and chunked at once: one scan and one shuffle for all shapes."""
    fields = ["block_no", "kind", "block_level", "text", "cells", "row_no", "anchor_kind", "slide", "sheet"]
    sizes = ["target", "overlap", "maximum"]
    documents = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__blocks"), *[F.first(c).alias(c) for c in (shape_col, *sizes)])
    return exploded_chunks(documents.withColumn("chunks", _document(F.col(shape_col), F.col("__blocks"), *map(F.col, sizes))), keys)
