"""Personal activity records: streaks, toggles, upserts, merges, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.order import ranged, tasks_before, with_position, with_position_in
from skyledger.sources.tables import small, stored


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive dates: key, first_day, last_day, length. Repeated dates count once, null dates not at all."""
    once = days.where(F.col(day).isNotNull()).select(key, day).distinct()
    ordered = Window.partitionBy(key).orderBy(day)
    run = once.withColumn("_run", F.date_sub(F.col(day), F.row_number().over(ordered)))
    return run.groupBy(key, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("_run")


def current_streak(days: DataFrame, key: str, day: str, today: Column) -> DataFrame:
    """Length of the run that ends today, or yesterday if today has no mark yet; else 0."""
    alive = F.col("last_day").between(F.date_sub(today, 1), today)
    past = days.where(F.col(day) <= today)
    return islands(past, key, day).groupBy(key).agg(F.coalesce(F.max(F.when(alive, F.col("length"))), F.lit(0)).alias("streak"))


def longest_streak(days: DataFrame, key: str, day: str) -> DataFrame:
    return islands(days, key, day).groupBy(key).agg(F.max("length").alias("longest"))


def latest(changes: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The values of the last change of every key, by the order columns; aggregated map-side."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))


def toggled(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are present after every row has turned membership over."""
    return changes.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("_in")).where("_in").drop("_in")


def upserted(changes: DataFrame, key: str, text: str, order: list[str], first: list[str]) -> DataFrame:
    """A journal: the last text of each key stands with the `first` columns of its first entry; a blank last text deletes the key."""
    return entries_of(journal_state(journal_changes(changes, key, text, order, first), key, order, first), key)


def journal_changes(changes: DataFrame, key: str, text: str, order: list[str], first: list[str]) -> DataFrame:
    """Changes as rows of a journal's state: key, text, first_... (each change's own) and last_... (its order)."""
    return changes.select(key, F.col(text).alias("text"), *(F.col(c).alias(f"first_{c}") for c in first), *(F.col(c).alias(f"last_{c}") for c in order))


def journal_state(rows: DataFrame, key: str, order: list[str], first: list[str]) -> DataFrame:
    """One row per key of a journal's state; states reduce like changes, in any order and number of steps. Deleted keys stay, with their blank text."""
    last, begun = [f"last_{c}" for c in order], [f"first_{c}" for c in first]
    ends = rows.groupBy(key).agg(F.max_by(F.struct("text", *last), F.struct(*last)).alias("_b"), F.min(F.struct(*begun)).alias("_a"))
    return ends.select(key, "_b.text", *(F.col(f"_a.{c}") for c in begun), *(F.col(f"_b.{c}") for c in last))


def entries_of(state: DataFrame, key: str) -> DataFrame:
    """The journal's entries: keys whose text is not blank."""
    return state.where(F.coalesce(F.regexp_like("text", F.lit("(?U)\\S")), F.lit(False)))


def insert_absent(mine: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """My rows and the incoming rows whose key I lack (one per key, the least row), with column added."""
    fresh = incoming.join(mine.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*[c for c in incoming.columns if c not in keys])).alias("_v"))
    fresh = fresh.select(*keys, "_v.*").select(*mine.columns)
    return mine.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def merged_texts(mine: DataFrame, theirs: DataFrame, key: str, text: str) -> DataFrame:
    """The longer text of each key; of equal lengths mine."""
    both = mine.select(key, text, F.lit(1).alias("_mine")).unionByName(theirs.select(key, text, F.lit(0).alias("_mine")))
    best = F.max_by(text, F.struct(F.length(F.coalesce(text, F.lit(""))), "_mine"))
    return both.groupBy(key).agg(best.alias(text))


def merged_plans(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Earliest start that is known and the union of done slots. Columns: key, start, done (array)."""
    both = mine.unionByName(theirs)
    return both.groupBy(key).agg(F.min("start").alias("start"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("done")))).alias("done"))


def progress(done: Column, total: int = 366) -> Column:
    """Per cent of a plan, halves up."""
    return F.floor(done / total * 100 + 0.5).cast("int")


def first_appearance(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The rows with their group's place by first appearance (nth_group, from 1), its first order value and their own place in the group (from 1)."""
    placed = with_position_in(rows, [group], [order], size="in_group")
    firsts = rows.groupBy(group).agg(F.min(order).alias("first"))
    ranked = with_position(firsts, "first", group, name="_rank").select(F.col(group).alias("_group"), "first", (F.col("_rank") + 1).alias("nth_group"))
    joined = placed.join(small(ranked), placed[group].eqNullSafe(F.col("_group")))
    return joined.withColumn("nth", F.col("pos") + 1).drop("pos", "_group", "in_group")


def runs(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Groups of consecutive rows with the same value: part, run (from 1), value, n, first order. Nulls are equal to each other.

    All rows have one global order and are dealt to tasks by its ranges, so a part of any size is spread. A row is compared with the one before it in its task, a
    task's first with the last of the task before, from a table of one row per task; runs that cross tasks are ended in the same way.
    """
    placed = ranged(rows.select(part, order, value), part, order)
    in_task, own = Window.partitionBy("_part").orderBy("_in"), F.struct(F.col(part).alias("p"), F.col(value).alias("v"))
    tasks = stored(placed.groupBy("_part").agg(F.count("*").alias("_n"), F.max_by(own, "_in").alias("_end")), "run-tasks")
    total = tasks.agg(F.sum("_n")).first()[0] or 0
    edges = tasks.select("_part", F.coalesce(F.sum("_n").over(tasks_before()), F.lit(0)).alias("_offset"), F.lag("_end").over(Window.orderBy("_part")).alias("_end_before"))
    marked = placed.withColumn("_prior", F.lag(own).over(in_task)).join(F.broadcast(edges), "_part")
    before = F.coalesce("_prior", "_end_before")
    same = before.isNotNull() & before["p"].eqNullSafe(F.col(part)) & before["v"].eqNullSafe(F.col(value))
    begins = stored(marked.where(~same).select("_part", part, order, value, (F.col("_offset") + F.col("_in")).alias("_pos")), "run-begins")

    counts = begins.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))  # one row per task
    ends = counts.select("_part", F.coalesce(F.sum("_n").over(tasks_before()), F.lit(0)).alias("_k"), F.lead("_first").over(Window.orderBy("_part")).alias("_then"))
    in_order = Window.partitionBy("_part").orderBy("_pos")
    numbered = begins.withColumns({"_next": F.lead("_pos").over(in_order), "_i": F.row_number().over(in_order)}).join(F.broadcast(ends), "_part")
    starts = numbered.select(part, order, value, (F.coalesce("_next", "_then", F.lit(total)) - F.col("_pos")).alias("n"), (F.col("_k") + F.col("_i")).alias("_run"))
    first = small(starts.groupBy(part).agg(F.min("_run").alias("_one")).withColumnRenamed(part, "_of"))
    joined = starts.join(first, starts[part].eqNullSafe(F.col("_of")))
    return joined.select(part, (F.col("_run") - F.col("_one") + 1).alias("run"), value, "n", F.col(order).alias("start"))
