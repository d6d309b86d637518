"""Global positions and balanced chunks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyledger.sources.tables import small, stored


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows dealt out by ranges of the columns and sorted within tasks, written once: with the task's number (_part, ascending) and the place in it (_in)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("*", F.monotonically_increasing_id().alias("_at")), "ranged")
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def tasks_before() -> WindowSpec:
    """All tasks before a row's; for tables of one row per task."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Adds the row's place (from 0) in the total order of the columns (descending where they say so).

    Rows are dealt out by ranges and sorted within tasks; a row's place is its place in the task plus the rows of all tasks before. The ranges
    are written once, as they may fall differently when made again. Rows that tie in all columns get places next to each other.
    """
    placed = ranged(df, *order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(tasks_before()), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def chunk_of(pos: Column, total: Column, chunks: int | Column) -> Column:
    """Chunk 1 to `chunks` of a place: sizes differ by one at most, larger ones first."""
    small = F.floor(total / chunks)
    large = total % chunks
    cut = large * (small + 1)
    return F.when(pos < cut, F.floor(pos / (small + 1)) + 1).otherwise(large + F.floor((pos - cut) / F.greatest(small, F.lit(1))) + 1).cast("int")


def balanced_chunks(df: DataFrame, order: list[str], chunks: int, name: str = "slot") -> DataFrame:
    """Adds the chunk of every row when all rows, in order, are cut into so many chunks."""
    placed = with_position(df, *order)
    total = placed.agg(F.count("*").alias("_total"))
    return placed.crossJoin(F.broadcast(total)).withColumn(name, chunk_of(F.col("pos"), F.col("_total"), chunks)).drop("_total")


def with_position_in(df: DataFrame, part: list[str], order: list[str], name: str = "pos", size: str = "n") -> DataFrame:
    """Adds the row's place (from 0) among the rows of its part, and their number. One global order serves all parts, so no part is held by one task."""
    placed = with_position(df, *part, *order, name="_pos")
    first = placed.groupBy(*part).agg(F.min("_pos").alias("_first"), F.count("*").alias(size))
    renamed = small(first.select(*(F.col(c).alias(f"_p_{c}") for c in part), "_first", size))
    same = None
    for c in part:
        equal = placed[c].eqNullSafe(renamed[f"_p_{c}"])
        same = equal if same is None else same & equal
    joined = placed.join(renamed, same)
    return joined.withColumn(name, F.col("_pos") - F.col("_first")).drop("_pos", "_first", *(f"_p_{c}" for c in part))
