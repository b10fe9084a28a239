"""Parquet tables, re-sent rows and shared checkpoint storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, keys: list[str], order_col: str, keep: list[str]) -> DataFrame:
    """One row per key, the one with the greatest `order_col` (nulls count as oldest); ties go to the
    greatest values of `keep`, so the result does not depend on the order of rows.

    A partial aggregate: a key sent any number of times is combined before the shuffle. Rows whose
    keys are all null count as one key.
    """
    rest = [c for c in keep if c not in keys]
    best = F.max(F.struct(F.col(order_col).alias("__order"), *[F.col(c) for c in rest]))
    out = df.groupBy(*keys).agg(best.alias("__best"))
    return out.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def local_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of this machine, for a session that runs on it alone; on a cluster there is no place that all executors share."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"blockmill-{purpose}-")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Makes sure checkpoint() has a directory: the one in spark.checkpoint.dir, and one of this machine only where that setting
    is absent and the session is local (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark) or local_folder(spark, "checkpoint"))
    return spark


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet to the folder of checkpoints and read from there: lineage is cut, and later steps read the columns
    they need."""
    spark = with_checkpoints(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where its files are too few and too small to give every core a partition.

    For stages that cost far more than moving their input. Files are counted as the scan will cut them; a frame that reads
    no files, or enough of them, stays as it is, and nothing is run to find out.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    parts = 0
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(name)
        parts += max(1, -(-path.getFileSystem(conf).getFileStatus(path).getLen() // most))
    return df.repartition(cores) if parts < cores else df
