"""Interval, circular and pair joins that become equi-joins where the sides can be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.sky import ASPECTS, aspect_of, separation


def unwrapped(intervals: DataFrame, lo: str, hi: str, first: int, last: int) -> DataFrame:
    """Intervals on a circle of whole numbers as plain ones: one that wraps (lo > hi) becomes two."""
    plain = intervals.where(F.col(lo) <= F.col(hi))
    wraps = intervals.where(F.col(lo) > F.col(hi))
    return plain.unionByName(wraps.withColumn(hi, F.lit(last))).unionByName(wraps.withColumn(lo, F.lit(first)))


def in_interval(rows: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with the interval that holds their value. Intervals are few and bounded (at most a year's 366 days), so they are spread and broadcast."""
    each = intervals.withColumn(value, F.explode(F.sequence(lo, hi)))
    return rows.join(F.broadcast(each), value)


def angle_pairs(points: DataFrame, part: str, name: str, angle: str, aspects: list[tuple] = ASPECTS) -> DataFrame:
    """Pairs of points of the same part (name a < b) whose circular distance is within an aspect's orb: the first aspect, orb and exactness.

    Parts are the points of one chart, a handful each.
    """
    left = points.select(part, F.col(name).alias("a"), F.col(angle).alias("_x"))
    right = points.select(part, F.col(name).alias("b"), F.col(angle).alias("_y"))
    pairs = left.join(right, part).where("a < b").withColumn("sep", separation(F.col("_x"), F.col("_y")))
    return pairs.withColumn("_hit", aspect_of(F.col("sep"), aspects)).where("_hit IS NOT NULL").select(part, "a", "b", "_hit.aspect", "_hit.kind", "_hit.orb", "_hit.exactness")


def sign_distance(a: Column, b: Column) -> Column:
    """Steps between two of twelve signs, 0 to 6."""
    apart = F.abs(a - b)
    return F.least(apart, 12 - apart)
