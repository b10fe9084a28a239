"""Folders watched for new files: each micro-batch is parsed like a table of documents.

Extraction and chunking keep no state between documents, so no watermark is needed; a file is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from blockmill.operators.extract import chunk_documents
from blockmill.plans.pipeline import parsed_of, with_sizes
from blockmill.sources.frames import as_documents


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of documents, one row for each new file."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return as_documents(files)


def write_chunks(documents: DataFrame, chunks_path: str, rejects_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query that writes the chunks and rejects of every micro-batch as Parquet, in a folder named by the batch, so a
    batch that is run again after a failure replaces its own files."""

    def run(batch: DataFrame, number: int) -> None:
        # Written once, so that a document is parsed once for chunks and rejects, and a lost executor loses nothing of it.
        staged = f"{chunks_path.rstrip('/')}_staged/batch={number}"
        chunk_documents(with_sizes(batch)).write.mode("overwrite").parquet(staged)
        parsed = parsed_of(batch.sparkSession.read.parquet(staged))
        parsed.chunks.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        parsed.rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
