"""Helpers that the training-data operators share: staged tables, per-batch mapping, hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources.tables import dealt_out as dealt_out
from skyledger.sources.tables import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver's JVM ends."""
    return scratch(spark, name)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks that read the files again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, keeps: bool = False, at_once: int = 4096) -> DataFrame:
    """Apply ``rows`` (record batch -> column name to values) to every Arrow batch of ``df``.

    Batches over `at_once` rows are cut so that the Python side holds what comes of few whole texts at once. Only functions that say so (keeps) find what
    an earlier job kept in the worker; for others it is let go first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                yield pa.RecordBatch.from_pydict(rows(whole.slice(start, at_once)))

    return df.mapInArrow(run, schema)


#: Bytes of the Arrow batches that go to workers while `small_batches` holds.
SMALL_BATCH = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send rows to Python in batches of few bytes: whole texts, ten thousand at once, take tens of MB in the JVM and as many again in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SMALL_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key is hot if it has over this many rows and over one in HOT_SHARE of all; so there are never over HOT_SHARE hot keys. SALTS: ways it is spread to.
HOT_ROWS, HOT_SHARE, SALTS = 2048, 100_000, 64


def hot_keys(rows: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """The hot keys (at most HOT_SHARE of them) of rows, or of counts of rows per key in the column `n`."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if n is None else rows.select(key, F.col(n).alias("_n"))
    if n is not None and counts.where(F.col("_n") > HOT_ROWS).isEmpty():
        return rows.sparkSession.createDataFrame([], counts.select(key).schema)
    many = staged(counts.where(F.col("_n") > HOT_ROWS), "hot-keys")
    total = (rows.count() if n is None else rows.agg(F.sum(n)).first()[0]) or 0
    return many.where(F.col("_n") > total // HOT_SHARE).select(key)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with at most one row per key. Rows of hot keys (a table of keys, broadcast) are spread by a hash of `spread`."""
    if hot.isEmpty():
        return many.join(one, key)
    marks = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = many.join(marks, key, "left").withColumn("_salt", salt).drop("_hot")
    right = one.join(marks, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id, written as text, leaves 2 modulo 4 (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


_kept: dict[str, object] = {}


def let_go() -> None:
    """Frees what earlier jobs kept in this worker, and gives the memory back that their batches took."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def kept_in_worker(key: str, build: Callable[[], object]) -> object:
    """The worker's object of this key, built once; only the latest is held, so that jobs in turn do not add up in memory."""
    if key not in _kept:
        let_go()
        _kept[key] = build()
    return _kept[key]
