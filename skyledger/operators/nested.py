"""Nested text corpora to one row per verse or block: six shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chapters_of_verses(df: DataFrame, keys: list[str], chapters: str) -> DataFrame:
    """array<array<string>> -> keys, chapter, verse, text."""
    outer = df.select(*keys, F.posexplode(chapters).alias("c", "_v"))
    return outer.select(*keys, (F.col("c") + 1).alias("chapter"), F.posexplode("_v").alias("v", "text")).select(*keys, "chapter", (F.col("v") + 1).alias("verse"), "text")


def hymns(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """array<struct<h, v: array<string>>> -> keys, hymn, verse, text; a hymn without verses keeps one row of nulls."""
    outer = df.select(*keys, F.explode(column).alias("_h"))
    inner = outer.select(*keys, F.col("_h.h").alias("hymn"), F.posexplode_outer("_h.v").alias("v", "text"))
    return inner.select(*keys, "hymn", (F.col("v") + 1).alias("verse"), "text")


def labelled(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """array<array<string>> of (label, text) -> keys, label, text."""
    return df.select(*keys, F.explode(column).alias("_p")).select(*keys, F.get("_p", F.lit(0)).alias("label"), F.get("_p", F.lit(1)).alias("text"))


def blocks(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """array<struct<n, b: array<array<string>>>> -> keys, n, text: lines and blocks joined by spaces."""
    return df.select(*keys, F.explode(column).alias("_c")).select(*keys, F.col("_c.n").alias("n"), F.array_join(F.flatten("_c.b"), " ").alias("text"))


def spread_angles(angles: Column, least: float = 7.0, passes: int = 40) -> Column:
    """Angles pushed apart in ascending order, a quarter of what is missing at a time, until neighbours are `least` apart or passes end; each at
    its original place in the array. Equal angles are in the order they came in.

    One pass goes over the neighbours in turn, so it is a fold over positions inside a fold over passes.
    """
    n = F.size(angles)

    def push(pos: Column, k: Column) -> Column:
        b = F.pmod(k + 1, n)
        gap = F.get(pos, b) - F.get(pos, k) + F.when(b == 0, 360.0).otherwise(0.0)
        by = F.when(gap < least, (least - gap) / 4).otherwise(0.0)
        return F.transform(pos, lambda x, i: x - F.when(i == k, by).otherwise(0.0) + F.when(i == b, by).otherwise(0.0))

    one_pass = lambda pos, _: F.aggregate(F.sequence(F.lit(0), n - 1), pos, push)
    ranked = F.array_sort(F.transform(angles, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def back(state: Column) -> Column:
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.transform(state["r"], lambda p: p["x"]), one_pass)
        return F.transform(F.array(F.struct(moved.alias("p"), F.transform(state["r"], lambda p: p["i"]).alias("at"))), lambda m: F.transform(m["at"], lambda _, i: F.get(m["p"], F.array_position(m["at"], i).cast("int") - 1)))[0]

    return F.when(n < 2, angles).otherwise(F.transform(F.array(F.struct(ranked.alias("r"))), back)[0])


def timeline_position(elapsed: Column, names: list[str], seconds: list[float]) -> tuple[Column, Column, Column]:
    """Cycle number, phase name and seconds left of a repeating timeline."""
    total = sum(seconds)
    t = F.pmod(elapsed, F.lit(float(total)))
    name, end = F.lit(names[-1]), F.lit(float(total))
    for i in range(len(names) - 2, -1, -1):
        stop = float(sum(seconds[: i + 1]))
        name, end = F.when(t < stop, names[i]).otherwise(name), F.when(t < stop, stop).otherwise(end)
    return F.floor(elapsed / total), name, end - t
