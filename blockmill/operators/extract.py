"""Documents to blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from blockmill.functions.text import paragraph_list
from blockmill.operators import office_formats as office
from blockmill.operators import plain_formats as plain
from blockmill.operators.blocks import SHAPES, Block
from blockmill.operators.chunk import CHUNKS, as_rows
from blockmill.operators.detect import archive_format, detect_format
from blockmill.operators.document_chunks import chunks_of
from blockmill.sources.archives import MAX_DOCUMENT, Rejected
from blockmill.sources.tables import spread

EXTRACTORS: dict[str, Callable[[bytes], list[Block]]] = {
    "txt": plain.text_blocks,
    "csv": lambda data: plain.delimited_blocks(data, ","),
    "tsv": lambda data: plain.delimited_blocks(data, "\t"),
    "html": plain.html_blocks,
    "eml": plain.mail_blocks,
    "rtf": plain.rtf_blocks,
    "docx": office.docx_blocks,
    "xlsx": office.xlsx_blocks,
    "pptx": office.pptx_blocks,
    "odt": office.odt_blocks,
    "ods": office.ods_blocks,
    "odp": office.odp_blocks,
    "epub": office.epub_blocks,
}


def blocks_of(format_name: str, data: bytes) -> tuple[list[Block] | None, str | None, str | None]:
    """(blocks, None, None), or (None, code, message)."""
    try:
        return EXTRACTORS[format_name](data), None, None
    except Rejected as e:
        return None, e.code, e.message
    except Exception as e:  # one bad document is a row of the rejects, never a failed job
        return None, "INTERNAL", f"{type(e).__name__}: {e}"


_RESULT = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("block_level", T.IntegerType()),
                        T.StructField("text", T.StringType()),
                        T.StructField("cells", T.ArrayType(T.StringType())),
                        T.StructField("row_no", T.IntegerType()),
                        T.StructField("anchor_kind", T.StringType()),
                        T.StructField("slide", T.IntegerType()),
                        T.StructField("sheet", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


def _opened(format_name: str | None, content: bytes | None) -> tuple[str | None, list[Block] | None, str | None, str | None]:
    """(format, blocks, code, message) of a document; no format if there is nothing to open."""
    if format_name is None or content is None:
        return None, None, None, None
    data = bytes(content)
    if format_name == "zip":
        found = archive_format(data)
        code, colon, message = found.partition(": ")
        if colon:
            return None, None, code, message
        format_name = found
    return format_name, *blocks_of(format_name, data)


_ARROW = to_arrow_type(_RESULT)
_BLOCKS = _ARROW.field("blocks").type


def _rows_of(blocks: list[Block]) -> pa.Array:
    fields = list(_BLOCKS.value_type)
    return pa.StructArray.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*blocks), fields)], fields=fields)


def _parse(formats: pa.Array, contents: pa.Array) -> pa.Array:
    """Documents to blocks, one after the other straight to Arrow, so that only one at a time is held as objects."""
    found, rows, starts = [], [], [0]
    for kind, content in zip(formats, contents):
        format_name, blocks, code, message = _opened(kind.as_py(), content.as_py())
        found.append((format_name, blocks is None, code, message))
        if blocks:
            rows.append(_rows_of(blocks))
        starts.append(starts[-1] + len(blocks or ()))
    names, without, codes, messages = zip(*found) if found else ((), (), (), ())
    every = pa.concat_arrays(rows) if rows else pa.array([], _BLOCKS.value_type)
    del rows
    listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), every, type=_BLOCKS, mask=pa.array(without, pa.bool_()))
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), listed, pa.array(codes, pa.string()), pa.array(messages, pa.string())], fields=list(_ARROW))


# Not deterministic by declaration: else Catalyst would run it again for a filter on its result.
_parse_udf = F.arrow_udf(_parse, _RESULT).asNondeterministic()


_CHUNKED = T.StructType([T.StructField("format", T.StringType()), T.StructField("chunks", CHUNKS), T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])


def _chunked(formats: pd.Series, contents: pd.Series, targets: pd.Series, overlaps: pd.Series, maxima: pd.Series) -> pd.DataFrame:
    out = []
    for kind, content, target, overlap, maximum in zip(formats, contents, targets, overlaps, maxima):
        found, blocks, code, message = _opened(kind, content)
        out.append((found, None if blocks is None else as_rows(chunks_of(found, blocks, int(target), int(overlap), int(maximum))), code, message))
    return pd.DataFrame(out, columns=_CHUNKED.names)


_chunk_udf = F.pandas_udf(_chunked, _CHUNKED).asNondeterministic()


def _known(raw: DataFrame, id_col: str, content_col: str, filename_col: str, type_col: str, keep: list[str]) -> DataFrame:
    """(__id, __keep_..., content, __large, format, reject_code, reject_message): documents with their detected format. Those beyond 150 MiB
    lose their bytes before anything opens them."""
    sized = spread(raw).select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__keep_{c}") for c in keep], F.col(content_col).alias("content"), F.col(filename_col).alias("filename"), F.col(type_col).alias("content_type"))
    large = F.octet_length("content") > MAX_DOCUMENT
    return detect_format(sized.withColumn("__large", large).withColumn("content", F.when(~large, F.col("content"))), open_archives=False)


def _message() -> Column:
    return F.when(F.col("__large"), f"document exceeds {MAX_DOCUMENT} bytes").otherwise(F.coalesce("reject_message", "__parsed.message"))


def chunk_documents(raw: DataFrame, *, id_col: str = "doc_id", content_col: str = "content", filename_col: str = "filename", type_col: str = "content_type") -> DataFrame:
    """(id_col, format, chunks array<struct>, reject_code, reject_message): one row for each document of `raw`, which holds the sizes in
    force as target, overlap and maximum.

    One scan and one Python stage, in which a document is parsed and chunked; no shuffle. Rejected documents have null chunks.
    """
    sizes = ["target", "overlap", "maximum"]
    known = _known(raw, id_col, content_col, filename_col, type_col, sizes)
    made = known.withColumn("__parsed", _chunk_udf(F.col("format"), F.col("content"), *[F.col(f"__keep_{c}") for c in sizes]))
    return made.select(F.col("__id").alias(id_col), F.col("__parsed.format").alias("format"), F.col("__parsed.chunks").alias("chunks"), F.coalesce("reject_code", "__parsed.code").alias("reject_code"), _message().alias("reject_message"))


def extract_documents(raw: DataFrame, *, id_col: str = "doc_id", content_col: str = "content", filename_col: str = "filename", type_col: str = "content_type", keep: list[str] | None = None) -> DataFrame:
    """(id_col, keep..., format, blocks array<struct>, reject_code, reject_message): one row for each document.

    One scan and one Python stage. Documents beyond 150 MiB are INVALID, and their bytes never reach Python. Well-formed plain text is
    split by Catalyst, and nothing of it goes to Python either. Rejected documents have null blocks.
    """
    keep = keep or []
    known = _known(raw, id_col, content_col, filename_col, type_col, keep)
    text = F.col("content").cast("string")
    is_plain = (F.col("format") == "txt") & F.coalesce(F.is_valid_utf8(text), F.lit(False))
    block = F.transform(paragraph_list(text), lambda p: F.struct(F.lit("Paragraph").alias("kind"), F.lit(0).alias("block_level"), p.alias("text"), F.lit(None).cast("array<string>").alias("cells"), F.lit(0).alias("row_no"), F.lit("Section").alias("anchor_kind"), F.lit(0).alias("slide"), F.lit("").alias("sheet")))
    known = known.withColumn("__plain", is_plain)
    other = known.withColumn("__parsed", _parse_udf(F.when(~F.col("__plain"), F.col("format")), F.when(~F.col("__plain"), F.col("content"))))
    return other.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        F.when(F.col("__plain"), F.col("format")).otherwise(F.col("__parsed.format")).alias("format"),
        F.when(F.col("__plain"), block).otherwise(F.col("__parsed.blocks")).alias("blocks"),
        F.coalesce("reject_code", "__parsed.code").alias("reject_code"),
        _message().alias("reject_message"),
    )


def exploded_blocks(extracted: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row for each block, numbered from 0 within its document."""
    # The outer form: Catalyst would evaluate the parse again for a filter on the size of a plain one.
    rows = extracted.select(id_col, *(keep or []), "format", F.posexplode_outer("blocks").alias("block_no", "b")).where("block_no IS NOT NULL")
    return rows.select(id_col, *(keep or []), "format", "block_no", "b.*")


def rejects(extracted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return extracted.where("reject_code IS NOT NULL").select(id_col, F.col("reject_code").alias("code"), F.col("reject_message").alias("message"))


def shape_of(format_col: str = "format"):
    """prose, sheets or slides, by format."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair]), F.col(format_col))
