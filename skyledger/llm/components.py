"""Connected components of an edge table by alternating star contractions; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.shared import HOT_ROWS, hot_keys, salted_join, staged


def _with_least(rows: DataFrame, spread: bool) -> DataFrame:
    """Rows (a, b) with the smallest b of their a as m; the rows of an a with many of them are spread over tasks."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if not spread:
        return rows.join(least.drop("n"), "a")
    least = staged(least, "least")
    return salted_join(rows, least.drop("n"), "a", "b", hot_keys(least, "a", "n"))


def _starred(edges: DataFrame, spread: bool) -> DataFrame:
    """One large-star and one small-star step. edges: (a, b) with a > b. Hubs meet only their minimum, map-side first. spread: whether a node may have many edges."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _with_least(both, spread).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))  # larger neighbours to the minimum
    large = near.where("a > b").distinct()
    large = staged(large, "large-star") if spread else large
    low = _with_least(large, spread)
    small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return small.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node with an edge, roots included; root is the component's smallest node.

    edges: two long columns a, b in any order; repeated edges and loops do no harm.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark, n = None, now.count()
    for _ in range(rounds):
        after = staged(_starred(now, n > HOT_ROWS), "stars")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, n = after, seen[0]
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    linked = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return linked.unionByName(now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
