"""Reading plans: units, balanced days, composite books, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.order import chunk_of, with_position_in
from skyledger.sources.tables import small


def chapter_units(books: DataFrame, book: str, chapters: str) -> DataFrame:
    """One row per chapter of every book, chapters numbered from 1; books without chapters give none."""
    return books.where(F.col(chapters) > 0).select(F.col(book).alias("book"), F.explode(F.sequence(F.lit(1), F.col(chapters).cast("int"))).alias("chapter"))


def varied_days(units: DataFrame, section: str, order: str, many: Column, days_many: int, days_few: int) -> DataFrame:
    """Cuts every section into days_many days where `many` holds and into days_few elsewhere; slots run on over sections.

    A row's day follows from its place in the section and the section's size, so no section is held by one task.
    """
    placed = with_position_in(units.withColumn("_many", many), [section], [order], name="_place", size="_n")
    days = F.when(F.col("_many"), days_many).otherwise(days_few)
    sections = units.select(F.col(section).alias("_section"), many.alias("_many")).groupBy("_section").agg(F.bool_or("_many").alias("_many")).withColumn("_days", days)
    before = Window.orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)  # one row per section
    starts = small(sections.select("_section", F.coalesce(F.sum("_days").over(before), F.lit(0)).alias("_before")))
    joined = placed.withColumn("_days", days).join(starts, F.col(section).eqNullSafe(F.col("_section")))
    slot = (F.col("_before") + chunk_of(F.col("_place"), F.col("_n"), F.col("_days"))).cast("int")
    return joined.withColumn("slot", slot).drop("_many", "_place", "_n", "_days", "_section", "_before")


def day_labels(units: DataFrame) -> DataFrame:
    """A label per slot from its first and last (book, chapter), by column pos."""
    ends = units.groupBy("slot").agg(F.min_by(F.struct("book", "chapter"), "pos").alias("a"), F.max_by(F.struct("book", "chapter"), "pos").alias("b"))
    text = lambda c: c.cast("string")
    one = F.concat(text(F.col("a.book")), F.lit(" "), F.when(F.col("a.chapter") == F.col("b.chapter"), text(F.col("a.chapter"))).otherwise(F.concat(text(F.col("a.chapter")), F.lit("–"), text(F.col("b.chapter")))))
    two = F.concat(text(F.col("a.book")), F.lit(" "), text(F.col("a.chapter")), F.lit(" – "), text(F.col("b.book")), F.lit(" "), text(F.col("b.chapter")))
    return ends.select("slot", F.when(F.col("a.book") == F.col("b.book"), one).otherwise(two).alias("label"))


def resolve_composite(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """(composite, chapter) to (book, local chapter) by running chapter counts of the composite's parts; past all parts as it came.

    parts: composite, ord, book, chapters. Its rows are spread to one per chapter, so the join is on equality.
    """
    running = Window.partitionBy("composite").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumn("before", F.coalesce(F.sum("chapters").over(running), F.lit(0)))
    each = spread.select("composite", "book", F.explode(F.sequence(F.lit(1), F.col("chapters"))).alias("local"), "before").select("composite", "book", "local", (F.col("before") + F.col("local")).cast("int").alias("chapter"))
    found = refs.join(each, ["composite", "chapter"], "left")
    return found.select("composite", "chapter", F.coalesce("book", "composite").alias("book"), F.coalesce("local", "chapter").alias("local"))


def passages_of_days(plan: DataFrame, spans: DataFrame) -> DataFrame:
    """Paragraphs (lo to hi) that hold a verse of a slot, each once per slot. plan: slot, verse. spans: lo, hi and more columns.

    A span is spread to its verses, so the join is on equality and no pair is tried in vain.
    """
    verses = spans.withColumn("verse", F.explode(F.sequence("lo", "hi")))
    return plan.join(verses, "verse").drop("verse").dropDuplicates(["slot", "lo", "hi"])


def span_bounds(label: Column) -> tuple[Column, Column]:
    """lo and hi of '58' or '58–59' (en dash)."""
    part = F.split(label, "–")
    lo = part[0].cast("int")
    return lo, F.coalesce(F.get(part, F.lit(1)).cast("int"), lo)


def first_end_at_least(values: DataFrame, value: str, chapters: DataFrame, end: str) -> DataFrame:
    """The chapter whose range (end before, end] holds the value. chapters: chapter and ascending whole-number ends.

    Ranges are joined on buckets of equal width plus the exact condition.
    """
    width = 16
    prior = Window.orderBy(end)  # one row per chapter
    ranges = chapters.withColumn("_from", F.coalesce(F.lag(end).over(prior), F.lit(0)) + 1)
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col(end) / width))))
    return values.withColumn("_bucket", F.floor(F.col(value) / width)).join(dealt, "_bucket").where(F.col(value).between(F.col("_from"), F.col(end))).drop("_bucket", "_from")
