"""Parquet tables and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_read(df: DataFrame) -> list[str]:
    """Names of the driver tables whose files a table is read from, sorted."""
    return sorted({found[1] for file in df.inputFiles() if (found := re.search(r"/([a-z]+)\.parquet(?=/|$)", file))})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path, with its scheme, under ``spark.checkpoint.dir``; removed when the JVM ends.

    Only in a local session (one JVM) that leaves the setting unset a temporary folder takes its place; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skyledger-"))
        base = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    file_system = path.getFileSystem(context._jsc.hadoopConfiguration())
    file_system.deleteOnExit(path)
    return file_system.makeQualified(path).toString()  # for readers that do not know the default scheme


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back; cuts lineage and fixes what is not repeatable."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The rows written once, and marked for broadcast only if they were counted to be at most so many."""
    kept = stored(df, "small")
    return F.broadcast(kept) if kept.count() <= rows else kept


#: Bytes of input per core below which rows are dealt out anew before much work on each.
SMALL_SHARE = 64 << 20


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as there are cores, if the input is fewer and small files, which Spark may read in one task; else as they are."""
    context, files = df.sparkSession.sparkContext, df.inputFiles()
    cores = context.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    path = context._jvm.org.apache.hadoop.fs.Path
    size = sum(path(f).getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(cores) if size < cores * SMALL_SHARE else df
