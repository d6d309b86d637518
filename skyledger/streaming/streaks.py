"""Runs of consecutive days as a running state: each user's islands are kept, and new days, late ones too, extend or join them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.sources.tables import scratch
from skyledger.streaming.state import StateFolder


def with_day(starts: list[int], ends: list[int], day: int) -> None:
    """Put a day (a number) into islands in order, in place: it lies in one, extends one, joins two, or begins one."""
    at = bisect_left(starts, day + 1)  # the first island that begins after the day
    before = at > 0 and ends[at - 1] >= day - 1
    after = at < len(starts) and starts[at] == day + 1
    if before and day <= ends[at - 1]:
        return
    if before and after:
        ends[at - 1] = ends[at]
        del starts[at], ends[at]
    elif before:
        ends[at - 1] = day
    elif after:
        starts[at] = day
    else:
        starts.insert(at, day)
        ends.insert(at, day)


def running_islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """Of a stream of (key, day): key, starts and ends of its islands (days since 1970) and a version that grows, each time the key has new days. Null days are passed over."""
    kind = days.schema[key].dataType.simpleString()

    def update(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, version = ([*state.get[0]], [*state.get[1]], state.get[2]) if state.exists else ([], [], 0)
        for part in parts:
            for n in part["_day"].dropna().unique().tolist():
                with_day(starts, ends, int(n))
        state.update((starts, ends, version + 1))
        yield pd.DataFrame({key: [own[0]], "starts": [starts], "ends": [ends], "version": [version + 1]})

    numbered = days.where(F.col(day).isNotNull()).select(key, F.unix_date(day).alias("_day"))
    out = f"{key} {kind}, starts array<int>, ends array<int>, version long"
    return numbered.groupBy(key).applyInPandasWithState(update, out, "starts array<int>, ends array<int>, version long", "update", GroupStateTimeout.NoTimeout)


def streaks_of(islands: DataFrame, key: str, today: Column) -> DataFrame:
    """key, streak (the run that ends today or yesterday, of days up to today) and longest of rows with starts and ends."""
    now = F.unix_date(today)
    runs = F.arrays_zip("starts", "ends")
    longest = F.array_max(F.transform(runs, lambda r: r["ends"] - r["starts"] + 1))
    seen = F.transform(F.filter(runs, lambda r: r["starts"] <= now), lambda r: F.struct(r["starts"].alias("a"), F.least(r["ends"], now).alias("b")))
    alive = F.filter(seen, lambda r: r["b"] >= now - 1)
    streak = F.coalesce(F.array_max(F.transform(alive, lambda r: r["b"] - r["a"] + 1)), F.lit(0))
    return islands.select(key, streak.cast("long").alias("streak"), longest.cast("long").alias("longest"))


def run_streaks(days: DataFrame, key: str, day: str, path: str | None = None) -> StateFolder:
    """Run a stream of days to its end; the islands of each key are in the state returned (key, starts, ends, version)."""
    spark = days.sparkSession
    path = path or scratch(spark, "streaks")
    rows = running_islands(days, key, day)
    reduce = lambda x: x.groupBy(key).agg(F.max_by(F.struct("starts", "ends", "version"), "version").alias("_l")).select(key, "_l.*")
    state = StateFolder(spark, f"{path}/state", [key], rows.schema, reduce)
    rows.writeStream.foreachBatch(state.merge).outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return state
