"""Formats told from content, with the name and the declared type as hints among kinds of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.sources.archives import Archive, Rejected

# Signatures, declared types and extensions.
OLE2 = "D0CF11E0A1B11AE1"
ZIP = "504B0304"
RTF = "7B5C727466"
MIME_TYPES = {
    "application/epub+zip": "epub",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
}
OFFICE_FOLDERS = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".html": "html", ".htm": "html", ".xhtml": "html", ".eml": "eml", ".rtf": "rtf", ".txt": "txt", ".log": "txt"}
TYPE_HINTS = {"csv": ".csv", "tab-separated": ".tsv", "html": ".html", "rfc822": ".eml", "rtf": ".rtf"}


def archive_format(data: bytes) -> str:
    """The format of a zip, or its rejection as 'CODE: message'."""
    try:
        archive = Archive(data, bounded=False)
    except Rejected as e:
        return f"{e.code}: {e.message}"
    if "mimetype" in archive and (kind := MIME_TYPES.get(archive.head("mimetype", 256).strip())):
        return kind
    if "[Content_Types].xml" in archive:
        for folder, kind in OFFICE_FOLDERS.items():
            if any(n.startswith(folder) for n in archive.members):
                return kind
    return "epub" if "META-INF/container.xml" in archive else "UNSUPPORTED: an archive of no known kind of document"


@F.pandas_udf(T.StringType())
def _archive_formats(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if c is None else archive_format(bytes(c)))


def hint(filename: Column, content_type: Column) -> Column:
    """The extension of the file name in lower case, or what the declared type says if there is none."""
    last = F.regexp_extract(F.coalesce(filename, F.lit("")), "([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(last, "(\\.[^.]*)$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    # The types are looked for in order; the first that is named decides.
    said = F.coalesce(*[F.when(F.contains(kind, F.lit(part)), F.lit(suffix)) for part, suffix in TYPE_HINTS.items()], F.lit(""))
    return F.coalesce(F.nullif(extension, F.lit("")), said)


def detect_format(df: DataFrame, *, content_col: str = "content", filename_col: str = "filename", type_col: str = "content_type", open_archives: bool = True) -> DataFrame:
    """`df` with `format`, `reject_code` and `reject_message`: a format, or the reason there is none.

    Only rows that start as a zip go to Python; without `open_archives` they stay 'zip' for a later stage to tell. A null
    content counts as empty and is INVALID.
    """
    content = F.col(content_col)
    starts = lambda code: F.startswith(content, F.unhex(F.lit(code)))
    is_html = F.lower(F.substring(content, 1, 1024).cast("string")).rlike("<!doctype html|<html|<body")
    # One look-up, not a branch for each extension: Catalyst would repeat the hint in every branch.
    named = F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), hint(F.col(filename_col), F.col(type_col)))
    kind = F.coalesce(named, F.when(is_html, "html").otherwise("txt"))
    found = (
        F.when(content.isNull() | (F.octet_length(content) == 0), "INVALID: no content")
        .when(starts(OLE2), "UNSUPPORTED: a compound binary file, as old or encrypted office files are")
        .when(starts(ZIP), F.col("__archive") if open_archives else F.lit("zip"))
        .when(starts(RTF), "rtf")
        .otherwise(kind)
    )
    out = df.withColumn("__archive", _archive_formats(F.when(starts(ZIP), content))) if open_archives else df
    # The generator keeps Catalyst from repeating the whole decision wherever one of its columns is used.
    out = out.select(*df.columns, F.inline(F.array(F.struct(found.alias("__found")))))
    bad = F.contains(F.col("__found"), F.lit(": "))
    return out.withColumns(
        {
            "format": F.when(~bad, F.col("__found")),
            "reject_code": F.when(bad, F.substring_index("__found", ": ", 1)),
            "reject_message": F.when(bad, F.expr("substring(__found, instr(__found, ': ') + 2)")),
        }
    ).drop("__found")


def hint_of(filename: str | None, content_type: str | None) -> str:
    """hint() in plain Python."""
    name = (filename or "").rpartition("/")[2]
    extension = "." + name.rpartition(".")[2].lower() if "." in name else ""
    if extension:
        return extension
    kind = (content_type or "").lower()
    return next((suffix for part, suffix in TYPE_HINTS.items() if part in kind), "")

