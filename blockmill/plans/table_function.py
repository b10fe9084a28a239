"""SQL access: SELECT ... FROM documents, LATERAL parse_document(content, filename)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from blockmill.operators.detect import EXTENSIONS, archive_format, hint_of
from blockmill.operators.extract import blocks_of

COLUMNS = "block_no int, kind string, block_level int, text string, cells array<string>, row_no int, slide int, sheet string"


def format_of(data: bytes, filename: str | None) -> str:
    """What detect_format finds, for one document."""
    if data.startswith(b"PK\x03\x04"):
        return archive_format(data)
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if not data or data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
        return "REJECTED: "
    head = data[:1024].lower()
    sniffed = "html" if any(mark in head for mark in (b"<!doctype html", b"<html", b"<body")) else "txt"
    return EXTENSIONS.get(hint_of(filename, None), sniffed)


class ParseDocument:
    """The blocks of one document; none for one that is rejected."""

    def eval(self, content: bytes, filename: str):
        data = bytes(content or b"")
        kind = format_of(data, filename)
        for n, b in enumerate((blocks_of(kind, data)[0] or []) if ": " not in kind else []):
            yield n, b.kind, b.level, b.text, b.cells, b.row, b.slide, b.sheet


def register(spark: SparkSession, name: str = "parse_document") -> None:
    spark.udtf.register(name, udtf(ParseDocument, returnType=COLUMNS))
