"""Folded full-text search with ranked, capped results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fold import contains_folded, fold, snippet

#: Shortest query, hits kept in scan order, results returned.
MIN_QUERY, SCAN_CAP, RESULTS = 2, 240, 60


def source(df: DataFrame, group: str, rank: int, order: list[Column], title: Column, text: Column) -> DataFrame:
    """A searched source in the shape that all sources share. `order` is the scan order within the source."""
    return df.select(
        F.lit(group).alias("group"), F.lit(rank).alias("group_rank"), *(c.alias(f"o{i}") for i, c in enumerate([*order, *[F.lit(None).cast("long")] * (2 - len(order))])),
        title.cast("string").alias("title"), text.alias("text"),
    )


def hits(sources: list[DataFrame], query: str) -> DataFrame:
    """All rows of the sources whose folded text holds the query; sources are scanned in the order given (column scan)."""
    numbered = [s.withColumn("scan", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, numbered)
    if len(query.strip()) < MIN_QUERY:
        return every.where(F.lit(False))
    return every.where(contains_folded(F.col("text"), query.strip()))


def ranked(found: DataFrame, query: str, cap: int = SCAN_CAP, results: int = RESULTS) -> DataFrame:
    """The first `cap` hits in scan order, then by group rank; ties keep scan order. Both steps are top-k, not full sorts."""
    scan = ["scan", "o0", "o1"]
    first = found.orderBy(*scan).limit(cap)
    return first.orderBy("group_rank", *scan).limit(results).select("group", "title", snippet(F.col("text"), query).alias("snippet"))


def counts(found: DataFrame) -> DataFrame:
    """Uncapped hits per group, and the total in a row of its own."""
    return found.rollup("group").agg(F.count("*").alias("hits")).select(F.coalesce("group", F.lit("total")).alias("group"), "hits")


def prefix_first(df: DataFrame, name_col: str, prefix: str, part: str, order_col: str, limit: int) -> DataFrame:
    """Rows whose folded name holds `part`: those that start with `prefix` first, then by `order_col`; the first `limit`."""
    name = fold(F.col(name_col))
    return df.where(F.contains(name, F.lit(part))).withColumn("prefix", F.startswith(name, F.lit(prefix))).orderBy(F.desc("prefix"), order_col).limit(limit)
