"""Uploads that arrive in frames, and folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = ["filename", "content_type", "target_chars", "overlap_chars", "max_chars"]


def assemble_frames(frames: DataFrame) -> DataFrame:
    """(upload_id, content, options...): the payloads of (upload_id, frame_no, payload, options...) put together in order.

    A frame is a piece of the content or, with a null payload, the options of the upload; of several the last holds. An
    upload without options has null ones. An upload is bounded by what a reader of documents takes (150 MiB).
    """
    is_options = F.col("payload").isNull()
    last = F.max(F.when(is_options, F.struct("frame_no", *OPTIONS))).alias("__options")
    parts = F.sort_array(F.collect_list(F.when(~is_options, F.struct("frame_no", "payload")))).alias("__parts")
    rows = frames.groupBy("upload_id").agg(parts, last)
    # Concatenated as hexadecimal text: an array of binary has no join.
    content = F.unhex(F.array_join(F.transform("__parts", lambda p: F.hex(p["payload"])), ""))
    return rows.select("upload_id", content.alias("content"), *[F.col(f"__options.{c}").alias(c) for c in OPTIONS])


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (doc_id, filename, content_type, content, size options); documents beyond the bounds are
    rejected by extract_documents. Spark itself passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return as_documents(files)


def as_documents(files: DataFrame) -> DataFrame:
    none = {c: F.lit(None).cast("int") for c in OPTIONS[2:]}
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "content").withColumns(none)
