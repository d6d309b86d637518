"""Reading plans over part, conversations, documents and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.dates import slot_spine
from skyledger.catalog.longitudes import SUN_MOON_SQL
from skyledger.functions.ephemeris import with_longitudes
from skyledger.operators.order import balanced_chunks, chunk_of, with_position_in
from skyledger.plans import reading
from skyledger.registry import query
from skyledger.sources.tables import dealt_out, read


@query("w1_balanced_chunks", "SELECT doc_id, CAST(ntile(366) OVER (ORDER BY doc_id) AS INTEGER) AS slot FROM documents")
def w1(spark, sf_dir):
    return balanced_chunks(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 366).select("doc_id", "slot")


UNITS_SQL = "u AS (SELECT p_partkey AS book, CAST(c AS INTEGER) AS chapter FROM part, unnest(range(1, p_size + 1)) t(c))"


def units(spark, sf_dir):
    return reading.chapter_units(read(spark, sf_dir, "part"), "p_partkey", "p_size")


@query("e7_chapter_units", f"WITH {UNITS_SQL} SELECT * FROM u")
def e7(spark, sf_dir):
    return units(spark, sf_dir)


PLAN_SQL = f"{UNITS_SQL}, plan AS (SELECT *, CAST(ntile(366) OVER (ORDER BY book, chapter) AS INTEGER) AS slot, row_number() OVER (ORDER BY book, chapter) - 1 AS pos FROM u)"


def plan(spark, sf_dir):
    """All chapters in 366 days."""
    return balanced_chunks(units(spark, sf_dir), ["book", "chapter"], 366)


LABEL_SQL = """l AS (SELECT slot, arg_min(book, pos) AS ab, arg_min(chapter, pos) AS ac, arg_max(book, pos) AS bb, arg_max(chapter, pos) AS bc FROM plan GROUP BY slot),
labels AS (SELECT slot, CASE WHEN ab = bb THEN ab || ' ' || (CASE WHEN ac = bc THEN CAST(ac AS VARCHAR) ELSE ac || '–' || bc END) ELSE ab || ' ' || ac || ' – ' || bb || ' ' || bc END AS label FROM l)"""


@query("w12_day_labels", f"WITH {PLAN_SQL}, {LABEL_SQL} SELECT slot, label FROM labels")
def w12(spark, sf_dir):
    return reading.day_labels(plan(spark, sf_dir))


@query(
    "w2_varied_days",
    """WITH x AS (SELECT p_partkey, p_size, CAST(CASE WHEN p_size <= 6 THEN ntile(13) OVER w ELSE ntile(12) OVER w END AS INTEGER) AS day FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)),
    d AS (SELECT p_size, coalesce(sum(CASE WHEN p_size <= 6 THEN 13 ELSE 12 END) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT DISTINCT p_size FROM part))
    SELECT p_partkey, p_size, CAST(b + day AS INTEGER) AS slot FROM x JOIN d USING (p_size)""",
)
def w2(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return reading.varied_days(parts, "p_size", "p_partkey", F.col("p_size") <= 6, 13, 12).select("p_partkey", "p_size", "slot")


@query("w9_ordinals", "SELECT doc_id, CAST(i AS INTEGER) AS line, length(string_split(text, chr(10))[i]) AS chars FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)")
def w9(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), F.length("t").cast("long").alias("chars"))


VERSES_SQL = "v AS (SELECT n_nationkey AS chapter, CAST(a AS INTEGER) AS verse, row_number() OVER (ORDER BY n_nationkey, a) AS ord FROM nation, unnest(range(1, n_nationkey % 7 + 4)) t(a))"
STARTS_SQL = "s AS (SELECT r_regionkey AS section, min(ord) AS start FROM region JOIN v ON v.chapter = r_regionkey * 5 + 1 AND v.verse = 2 GROUP BY 1)"


@query("e8_cross_boundary_ranges", f"WITH {VERSES_SQL}, {STARTS_SQL} SELECT section, chapter, verse FROM (SELECT section, start, coalesce(lead(start) OVER (ORDER BY start), 1000000) AS stop FROM s) JOIN v ON ord >= start AND ord < stop")
def e8(spark, sf_dir):
    """All verses from each section's start (inclusive) to the next one's (exclusive); the last runs to the end."""
    from pyspark.sql import Window

    nation = read(spark, sf_dir, "nation")  # a dimension of 25 rows
    verses = nation.select(F.col("n_nationkey").alias("chapter"), F.explode(F.sequence(F.lit(1), F.col("n_nationkey") % 7 + 3)).alias("verse"))
    starts = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("section"), (F.col("r_regionkey") * 5 + 1).alias("chapter"), F.lit(2).alias("verse"))
    upto = Window.orderBy("chapter", "verse").rowsBetween(Window.unboundedPreceding, 0)
    marked = verses.join(F.broadcast(starts), ["chapter", "verse"], "left").withColumn("section", F.last("section", ignorenulls=True).over(upto))
    return marked.where("section IS NOT NULL").select("section", "chapter", "verse")


@query("e9_sequences", "SELECT 0 AS book, CAST(v AS INTEGER) AS item FROM range(1, 424) t(v) UNION ALL SELECT n_nationkey + 1, CAST(h AS INTEGER) FROM nation, unnest(range(1, n_nationkey + 2)) t(h)")
def e9(spark, sf_dir):
    verses = spark.range(1, 424).select(F.lit(0).alias("book"), F.col("id").cast("int").alias("item"))
    hymns = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("book"), F.explode(F.sequence(F.lit(1), F.col("n_nationkey") + 1)).alias("item"))
    return verses.unionByName(hymns)


SPANS_SQL = "p AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN CAST(item_id * 3 + 1 AS VARCHAR) ELSE (item_id * 3 + 1) || '–' || (item_id * 3 + 1 + item_id % 3) END AS label FROM benchmark), q AS (SELECT item_id, CAST(split_part(label, '–', 1) AS INTEGER) AS lo, CAST(CASE WHEN contains(label, '–') THEN split_part(label, '–', 2) ELSE label END AS INTEGER) AS hi FROM p)"


def spans(spark, sf_dir):
    i = F.col("item_id")
    lo = (i * 3 + 1).cast("string")
    label = F.when(i % 3 == 0, lo).otherwise(F.concat(lo, F.lit("–"), (i * 3 + 1 + i % 3).cast("string")))
    low, high = reading.span_bounds(F.col("label"))
    return read(spark, sf_dir, "benchmark").select("item_id", label.alias("label")).select("item_id", low.alias("lo"), high.alias("hi"))


@query("e11_span_parse", f"WITH {SPANS_SQL} SELECT item_id, lo, hi FROM q")
def e11(spark, sf_dir):
    return spans(spark, sf_dir)


@query("j6_span_join", f"WITH {SPANS_SQL}, d AS (SELECT CAST(s AS INTEGER) AS slot, CAST(v AS INTEGER) AS verse FROM range(1, 61) a(s), unnest(range(s * 5 - 4, s * 5 + 1)) b(v)) SELECT DISTINCT slot, item_id, lo, hi FROM d JOIN q ON verse BETWEEN lo AND hi")
def j6(spark, sf_dir):
    days = spark.range(1, 61).select(F.col("id").cast("int").alias("slot")).withColumn("verse", F.explode(F.sequence(F.col("slot") * 5 - 4, F.col("slot") * 5)))
    return reading.passages_of_days(days, spans(spark, sf_dir)).select("slot", "item_id", "lo", "hi")


TALK_SQL = "t AS (SELECT conv_id, turn, text, CAST(ntile(30) OVER (ORDER BY conv_id, turn) AS INTEGER) AS slot FROM conversations)"


@query("j4_plan_day_text", f"WITH {TALK_SQL} SELECT t.slot, t.conv_id, t.turn, length(c.text) AS chars FROM t JOIN conversations c USING (conv_id, turn)")
def j4(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations")
    days = balanced_chunks(talk.select("conv_id", "turn"), ["conv_id", "turn"], 30).select("conv_id", "turn", "slot")
    return days.join(talk, ["conv_id", "turn"]).select("slot", "conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("j5_grouped_units", "WITH u AS (SELECT DISTINCT conv_id, CAST(a AS BIGINT) AS turn FROM conversations, range(0, 8) r(a)) SELECT u.conv_id, count(c.conv_id) AS found, CAST(sum(length(coalesce(c.text, ''))) AS BIGINT) AS chars, string_agg(left(coalesce(c.text, ''), 3), '|' ORDER BY u.turn) AS heads FROM u LEFT JOIN conversations c ON u.conv_id = c.conv_id AND u.turn = c.turn GROUP BY u.conv_id")
def j5(spark, sf_dir):
    """Units of a chapter with their texts, an absent one empty."""
    talk = read(spark, sf_dir, "conversations")
    wanted = talk.select("conv_id").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    texts = wanted.join(talk.withColumn("hit", F.lit(1)), ["conv_id", "turn"], "left").withColumn("body", F.coalesce("text", F.lit("")))
    heads = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring("body", 1, 3).alias("h")))), lambda x: x["h"]), "|")
    return texts.groupBy("conv_id").agg(F.count("hit").alias("found"), F.sum(F.length("body")).alias("chars"), heads.alias("heads"))


@query("j7_hymn_or_note", "WITH h AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS v FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(CASE WHEN v IS NULL THEN NULL ELSE i END AS INTEGER) AS verse, CASE WHEN v IS NULL THEN 'not given here' ELSE left(v[i], 12) END AS line FROM h, unnest(range(1, greatest(coalesce(len(v), 0), 1) + 1)) t(i)")
def j7(spark, sf_dir):
    """Verses of a hymn in order; a hymn without verses gives its note."""
    verses = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(verses.alias("v")).select("conv_id", F.posexplode_outer("v").alias("i", "x"))
    return rows.select("conv_id", (F.col("i") + 1).alias("verse"), F.when(F.col("i").isNull(), "not given here").otherwise(F.substring("x.text", 1, 12)).alias("line"))


@query(
    "j8_composite_books",
    """WITH p AS (SELECT n_regionkey AS composite, n_nationkey AS book, n_nationkey % 4 + 2 AS chapters, coalesce(sum(n_nationkey % 4 + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM nation),
    r AS (SELECT r_regionkey AS composite, CAST(c AS INTEGER) AS chapter FROM region, range(1, 31) t(c))
    SELECT r.composite, r.chapter, coalesce(p.book, r.composite) AS book, CAST(coalesce(r.chapter - p.lo, r.chapter) AS INTEGER) AS local FROM r LEFT JOIN p ON r.composite = p.composite AND r.chapter > p.lo AND r.chapter <= p.lo + p.chapters""",
)
def j8(spark, sf_dir):
    parts = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("composite"), F.col("n_nationkey").alias("ord"), F.col("n_nationkey").alias("book"), (F.col("n_nationkey") % 4 + 2).alias("chapters"))
    refs = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("composite"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("chapter"))
    return reading.resolve_composite(refs, parts)


@query("j11_forward_asof", "WITH c AS (SELECT n_nationkey AS chapter, CAST(sum(n_nationkey % 9 + 8) OVER (ORDER BY n_nationkey) AS BIGINT) AS stop FROM nation), v AS (SELECT p_partkey, p_partkey % 290 + 1 AS verse FROM part) SELECT p_partkey, verse, (SELECT min(chapter) FROM c WHERE stop >= verse) AS chapter FROM v WHERE verse <= (SELECT max(stop) FROM c)")
def j11(spark, sf_dir):
    from pyspark.sql import Window

    upto = Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)  # 25 rows
    chapters = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chapter"), F.sum(F.col("n_nationkey") % 9 + 8).over(upto).alias("stop"))
    verses = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 290 + 1).alias("verse"))
    return reading.first_end_at_least(verses, "verse", chapters, "stop").select("p_partkey", "verse", "chapter")


HELD_SQL = "parts AS (SELECT p_partkey FROM part WHERE p_retailprice < 1500), here AS (SELECT slot, bool_and(p_partkey IS NOT NULL) AS held FROM (SELECT DISTINCT slot, book FROM plan) LEFT JOIN parts ON book = p_partkey GROUP BY slot)"


def held_days(spark, sf_dir):
    """Whether all parts that a day needs are held."""
    parts = read(spark, sf_dir, "part").where("p_retailprice < 1500").select(F.col("p_partkey").alias("book"), F.lit(True).alias("held"))
    need = plan(spark, sf_dir).select("slot", "book").distinct()
    return need.join(parts, "book", "left").groupBy("slot").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held"))


@query("j21_month_of_plan", f"WITH {PLAN_SQL}, {LABEL_SQL}, {HELD_SQL}, s AS (SELECT CAST(x AS INTEGER) AS slot, CAST(day(DATE '2000-01-01' + CAST(x - 1 AS INTEGER)) AS INTEGER) AS d FROM range(1, 367) t(x) WHERE month(DATE '2000-01-01' + CAST(x - 1 AS INTEGER)) = 2), done AS (SELECT DISTINCT CAST(o_custkey % 366 + 1 AS INTEGER) AS slot FROM orders WHERE o_orderstatus = 'P') SELECT s.slot, d, label, held, done.slot IS NOT NULL AS done, s.slot = 60 AS skipped FROM s JOIN labels USING (slot) JOIN here USING (slot) LEFT JOIN done ON done.slot = s.slot")
def j21(spark, sf_dir):
    """A month's slots with label, held, done and skipped flags."""
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 366 + 1).cast("int").alias("slot")).distinct().withColumn("hit", F.lit(1))
    days = slot_spine(spark, 1999).where("m = 2").join(reading.day_labels(plan(spark, sf_dir)), "slot").join(held_days(spark, sf_dir), "slot")
    return days.join(done, "slot", "left").select("slot", "d", "label", "held", F.col("hit").isNotNull().alias("done"), "skipped")


PLANS_SQL = "a AS (SELECT role, conv_id, turn, CAST(ntile(40) OVER (PARTITION BY role ORDER BY conv_id, turn) AS INTEGER) AS slot FROM conversations)"


@query("j22_slot_across_plans", f"WITH {PLANS_SQL} SELECT role, min(conv_id * 1000 + turn) AS first, max(conv_id * 1000 + turn) AS last, count(*) AS n FROM a WHERE slot = 7 GROUP BY role")
def j22(spark, sf_dir):
    """The same slot of every plan, whatever plans there are: one global order serves them all."""
    placed = with_position_in(read(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), ["role"], ["conv_id", "turn"])
    key = F.col("conv_id") * 1000 + F.col("turn")
    day = placed.where(chunk_of(F.col("pos"), F.col("n"), 40) == 7)
    return day.groupBy("role").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


@query("p9_parts_of_a_day", f"WITH {PLAN_SQL} SELECT DISTINCT slot, p_brand AS work, book FROM plan JOIN part ON book = p_partkey")
def p9(spark, sf_dir):
    """Works and parts that each day of a plan needs."""
    days = plan(spark, sf_dir).select("slot", "book")
    return days.join(read(spark, sf_dir, "part"), F.col("book") == F.col("p_partkey")).select("slot", F.col("p_brand").alias("work"), "book").distinct()


@query("p10_all_parts_local", f"WITH {PLAN_SQL}, {HELD_SQL} SELECT slot, held AS is_local FROM here")
def p10(spark, sf_dir):
    return held_days(spark, sf_dir).select("slot", F.col("held").alias("is_local"))


@query(
    "e12_ticks_and_sectors",
    f"""WITH {SUN_MOON_SQL}, c AS (SELECT CAST(floor(moon) AS INTEGER) AS tick, count(*) AS events FROM sky GROUP BY 1)
    SELECT CAST(d AS INTEGER) AS tick, CAST(d // 30 AS INTEGER) AS sector, d % 30 = 0 AS cusp, coalesce(events, 0) AS events FROM range(0, 360) t(d) LEFT JOIN c ON tick = d""",
)
def e12(spark, sf_dir):
    """A tick for each degree of a wheel with its sector of 30 and the events with the Moon in that degree."""
    moon = with_longitudes(dealt_out(read(spark, sf_dir, "events").select("ts")), F.col("ts"), ["Moon"], ahead=False)
    counts = moon.groupBy(F.floor("lon_Moon").cast("int").alias("tick")).agg(F.count("*").alias("events"))  # 360 at most
    d = F.col("tick")
    ticks = spark.range(360).select(F.col("id").cast("int").alias("tick")).join(F.broadcast(counts), "tick", "left")
    return ticks.select("tick", F.floor(d / 30).cast("int").alias("sector"), (d % 30 == 0).alias("cusp"), F.coalesce("events", F.lit(0)).alias("events"))
