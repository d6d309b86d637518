"""A change log committed to a keyed state, in micro-batches or when a quiet gap has passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.operators.records import latest
from skyledger.sources.tables import scratch
from skyledger.streaming.state import StateFolder


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> None:
    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def merged_stream(changes: DataFrame, keys: list[str], reduce: Callable[[DataFrame], DataFrame], path: str | None = None, buckets: int = 16) -> StateFolder:
    """Run a streaming DataFrame of changes to its end; each micro-batch goes into the state by `reduce`. A batch that is replayed changes nothing."""
    path = path or scratch(changes.sparkSession, "stream-state")
    state = StateFolder(changes.sparkSession, f"{path}/state", keys, StructType(changes.schema.fields), reduce, buckets)
    _run(changes, state.merge, f"{path}/progress")
    return state


def commit_stream(changes: DataFrame, keys: list[str], order: list[str], values: list[str], path: str | None = None, buckets: int = 16) -> DataFrame:
    """The last change of each key after a streaming DataFrame of changes has run to its end.

    Each micro-batch is reduced to its last changes and merged into the state. Late changes lose to newer ones, as the order columns decide and not
    arrival. Returns the state.
    """
    kept = [*values, *(c for c in order if c not in values)]
    state = merged_stream(changes.select(*keys, *kept), keys, lambda rows: latest(rows, keys, order, kept), path, buckets)
    return state.read().select(*keys, *values)


def quiet_commits(changes: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str], gap: str, late: str) -> DataFrame:
    """Of a stream's changes to a key that follow each other within `gap`, the last one: keys, values, first and last instant, and how many they were.

    A change waits until none has come for the gap; only then the last is committed. Changes may arrive up to `late` behind the latest seen; later ones
    are lost, as soon as a batch has told so (those in time may join two sessions). Works on tables, too.
    """
    if changes.isStreaming:
        changes = changes.withWatermark(ts, late)
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    closed = changes.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(last, F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("changes"))
    return closed.select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values), "first_at", "last_at", "changes")


#: An instant after all others, at which the flush of a stream stands.
END = "9999-01-01 00:00:00"


def flushed_stream(changes: DataFrame, commits: Callable[[DataFrame], DataFrame], ts: str, path: str | None = None) -> DataFrame:
    """Run a stream of changes through `commits` (see `quiet_commits`) to its end and flush what still waits, as when a page is left. Returns all commits.

    The flush is a row of a second source, without any key and at END, so that every waiting change is closed; it comes only after all changes were taken,
    and the stream is over with it. A batch that is replayed writes its commits again.
    """
    spark: SparkSession = changes.sparkSession
    path = path or scratch(spark, "quiet-commits")
    ticks = spark.createDataFrame([], changes.schema)
    ticks.write.mode("ignore").parquet(f"{path}/ticks")
    schema = StructType(changes.schema.fields)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/commits/batch={number}")

    def run() -> None:
        _run(commits(changes.unionByName(spark.readStream.schema(schema).parquet(f"{path}/ticks"))), keep, f"{path}/progress")

    run()
    end = spark.range(1).select(*(F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema.fields))
    end.coalesce(1).write.mode("append").parquet(f"{path}/ticks")
    run()
    return spark.read.parquet(f"{path}/commits").drop("batch")


def changes_of(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream of its rows."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and kind; works on streams (with a watermark) and on tables."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
