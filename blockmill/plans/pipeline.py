"""Whole pipelines: documents in, chunks and rejects out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.sizing import resolved_max, resolved_overlap, resolved_target
from blockmill.operators.chunk import exploded_chunks
from blockmill.operators.extract import chunk_documents, rejects


class Parsed(NamedTuple):
    chunks: DataFrame
    rejects: DataFrame


def with_sizes(df: DataFrame, target: str = "target_chars", overlap: str = "overlap_chars", maximum: str = "max_chars") -> DataFrame:
    """`df` with the sizes in force as target, overlap and maximum."""
    t, o, m = F.col(target), F.col(overlap), F.col(maximum)
    return df.withColumns({"target": resolved_target(t), "overlap": resolved_overlap(t, o), "maximum": resolved_max(t, m)})


def parse_documents(raw: DataFrame, id_col: str = "doc_id") -> Parsed:
    """Chunks and rejects of (id_col, content, filename, content_type, target_chars, overlap_chars, max_chars).

    Each is one scan and one Python stage without a shuffle. To run that once for both, write chunk_documents first and take both from
    there (see streaming/ingest.py).
    """
    return parsed_of(chunk_documents(with_sizes(raw), id_col=id_col), id_col)


def parsed_of(documents: DataFrame, id_col: str = "doc_id") -> Parsed:
    """Chunks and rejects of what chunk_documents gave."""
    return Parsed(exploded_chunks(documents, [id_col, "format"]), rejects(documents, id_col))
