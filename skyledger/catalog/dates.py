"""Date, time and zone functions over orders, events and customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.functions import calendar as cal
from skyledger.registry import query
from skyledger.sources.tables import read

BEFORE_SQL = "[" + ", ".join(str(sum(cal.MONTH_DAYS[:i])) for i in range(12)) + "]"


def slot_sql(date: str) -> str:
    return f"CAST({BEFORE_SQL}[month({date})] + day({date}) AS INTEGER)"


#: Latitude and longitude of a nation, made from its key: a stand-in for a table of places.
LAT, LON = "CAST((n_nationkey * 37) % 121 - 60 AS DOUBLE)", "CAST((n_nationkey * 73) % 361 - 180 AS DOUBLE)"
LEAP_SQL = "({0} % 4 = 0 AND {0} % 100 <> 0 OR {0} % 400 = 0)"
ZONE = "America/New_York"


def places(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    return nation.select("n_nationkey", ((F.col("n_nationkey") * 37) % 121 - 60).cast("double").alias("lat"), ((F.col("n_nationkey") * 73) % 361 - 180).cast("double").alias("lon"))


@query("f15_local_date_key", f"SELECT event_id, strftime(CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d') AS day_key FROM events")
def f15(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", cal.date_key(F.col("ts"), ZONE).alias("day_key"))


@query("f16_slot_of_date", f"SELECT o_orderkey, {slot_sql('o_orderdate')} AS slot FROM orders")
def f16(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.slot_of_date(F.col("o_orderdate")).alias("slot"))


@query(
    "f17_date_of_slot",
    f"WITH x AS (SELECT o_orderkey, {slot_sql('o_orderdate')} AS slot FROM orders) SELECT o_orderkey, slot, CAST(month(DATE '2000-01-01' + (slot - 1)) AS INTEGER) AS m, CAST(day(DATE '2000-01-01' + (slot - 1)) AS INTEGER) AS d FROM x",
)
def f17(spark, sf_dir):
    """Month and day again from every order's slot."""
    m, d = cal.month_day_of_slot(F.col("slot"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.slot_of_date(F.col("o_orderdate")).alias("slot")).select("o_orderkey", "slot", m.alias("m"), d.alias("d"))


@query("f18_leap_year", f"WITH x AS (SELECT o_orderkey, CAST(year(o_orderdate) + o_orderkey % 401 - 200 AS INTEGER) AS y FROM orders) SELECT o_orderkey, y, {LEAP_SQL.format('y')} AS leap FROM x")
def f18(spark, sf_dir):
    """Whether a year is a leap year: every order's, moved by up to two centuries."""
    y = (F.year("o_orderdate") + F.col("o_orderkey") % 401 - 200).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", y.alias("y")).select("o_orderkey", "y", cal.is_leap(F.col("y")).alias("leap"))


@query("f19_day_of_year", "SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year FROM orders")
def f19(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("day_of_year"))


@query(
    "f20_long_date",
    """WITH k AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'soon' WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE strftime(o_orderdate, '%Y-%m-') || '31' END AS key FROM orders),
    p AS (SELECT *, string_split(key, '-') AS p FROM k)
    SELECT o_orderkey, CASE WHEN coalesce(key, '') = '' THEN '' WHEN len(p) <> 3 THEN key
      ELSE strftime(make_date(CAST(p[1] AS INTEGER), CAST(p[2] AS INTEGER), 1) + CAST(CAST(p[3] AS INTEGER) - 1 AS INTEGER), '%A, %B %-d, %Y') END AS long_date FROM p""",
)
def f20(spark, sf_dir):
    """Date keys told in words: padded or not, past the month's end, of two parts, no date at all, empty, absent."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    key = F.when(kind == 1, "").when(kind == 2, "soon").when(kind == 3, F.date_format(d, "yyyy-MM")).when(kind == 4, F.date_format(d, "yyyy-M-d")).when(kind == 5, F.concat(F.date_format(d, "yyyy-MM-"), F.lit("31")))
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.long_date_of_key(key).alias("long_date"))


@query("f21_zone_offset", f"SELECT o_orderkey, CAST(epoch((CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}') - CAST(o_orderdate AS TIMESTAMP)) / 60 AS INTEGER) AS minutes FROM orders")
def f21(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.zone_offset_minutes(F.col("o_orderdate"), ZONE).alias("minutes"))


@query("f22_local_to_utc", f"SELECT o_orderkey, CAST(epoch_ms((CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE '{ZONE}') AS BIGINT) AS utc_ms FROM orders")
def f22(spark, sf_dir):
    noon = F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.millis(cal.utc_of_local(noon, ZONE)).alias("utc_ms"))


@query(
    "f23_offset_override",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + 12 * 3600000 - CAST((o_orderkey % 23 - 11) * 1800000 AS BIGINT)
      ELSE epoch_ms((CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE '{ZONE}') END AS utc_ms FROM orders""",
)
def f23(spark, sf_dir):
    noon = F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")
    offset = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 23 - 11) / 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.millis(cal.utc_of_local(noon, ZONE, offset)).alias("utc_ms"))


@query("f24_minutes_to_instant", "SELECT event_id, epoch_ms(date_trunc('day', CAST(ts AS TIMESTAMP))) + CAST(floor(value * 60000 + 0.5) AS BIGINT) AS at_ms FROM events")
def f24(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", cal.millis(cal.minutes_after(F.col("ts"), F.col("value"))).alias("at_ms"))


@query(
    "f25_season",
    f"""SELECT o_orderkey, (CASE WHEN {LAT} < 0 THEN ['autumn', 'winter', 'spring', 'summer'] ELSE ['spring', 'summer', 'autumn', 'winter'] END)[CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 1 WHEN month(o_orderdate) IN (6, 7, 8) THEN 2 WHEN month(o_orderdate) IN (9, 10, 11) THEN 3 ELSE 4 END] AS season
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def f25(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.select("o_orderkey", cal.season(F.month("o_orderdate"), F.col("lat")).alias("season"))


@query("f33_location_default", f"SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 40.0::DOUBLE ELSE {LAT} END AS lat, CASE WHEN n_nationkey % 4 = 0 THEN CAST(15 * (n_nationkey % 24 - 12) AS DOUBLE) ELSE {LON} END AS lon FROM nation")
def f33(spark, sf_dir):
    """A stored place, or latitude 40 and the zone offset times 15 degrees."""
    known = F.col("n_nationkey") % 4 != 0
    offset_hours = F.col("n_nationkey") % 24 - 12
    return places(spark, sf_dir).select("n_nationkey", F.coalesce(F.when(known, F.col("lat")), F.lit(40.0)).alias("lat"), F.coalesce(F.when(known, F.col("lon")), (offset_hours * 15).cast("double")).alias("lon"))


@query("w5_prefix_sum", f"SELECT o_orderkey, CAST({BEFORE_SQL}[month(o_orderdate)] AS BIGINT) AS days_before, CAST({BEFORE_SQL}[month(o_orderdate)] + day(o_orderdate) AS BIGINT) AS day_of_slots FROM orders")
def w5(spark, sf_dir):
    """Days before every order's month, by a running sum of the months' lengths, and its place in the year of slots."""
    before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    starts = months(spark).select("m", F.coalesce(F.sum("days").over(before), F.lit(0)).cast("long").alias("days_before"))  # twelve rows
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("day"))
    return orders.join(F.broadcast(starts), "m").select("o_orderkey", "days_before", (F.col("days_before") + F.col("day")).alias("day_of_slots"))


def months(spark):
    """The months with their lengths in the year of slots."""
    return spark.createDataFrame(list(enumerate(cal.MONTH_DAYS, 1)), "m int, days int")


@query(
    "w6_cyclic_day",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {slot_sql("DATE '1998-07-01'")} ELSE CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-07-01'), 0) % 366 + 1 AS INTEGER) END AS plan_day FROM orders""",
)
def w6(spark, sf_dir):
    start = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.cyclic_day(F.lit("1998-07-01").cast("date"), start).alias("plan_day"))


@query(
    "w13_skipped_slot",
    f"WITH x AS (SELECT o_orderkey, {slot_sql('o_orderdate')} AS slot, CAST(year(o_orderdate) + o_orderkey % 8 AS INTEGER) AS y FROM orders) SELECT o_orderkey, y, slot, slot = 60 AND NOT {LEAP_SQL.format('y')} AS skipped FROM x",
)
def w13(spark, sf_dir):
    """Whether the slot of an order is left out in one of the following years."""
    y = (F.year("o_orderdate") + F.col("o_orderkey") % 8).cast("int")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", y.alias("y"), cal.slot_of_date(F.col("o_orderdate")).alias("slot"))
    return rows.select("o_orderkey", "y", "slot", cal.slot_skipped(F.col("slot"), F.col("y")).alias("skipped"))


@query(
    "p12_rotations",
    """SELECT o_orderkey, ['a', 'b', 'c', 'd', 'e', 'f', 'g'][dayofyear(o_orderdate) % 7 + 1] AS reflection, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, CAST((day(o_orderdate) - 1) % 31 AS INTEGER) AS verse FROM orders""",
)
def p12(spark, sf_dir):
    reflections = F.array(*map(F.lit, "abcdefg"))
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get(reflections, F.dayofyear(d) % F.size(reflections)).alias("reflection"), cal.weekday(d).alias("weekday"), F.pmod(F.dayofmonth(d) - 1, F.lit(31)).alias("verse"))


@query(
    "e10_slot_spine",
    f"""SELECT CAST(s AS INTEGER) AS slot, strftime(DATE '2000-01-01' + CAST(s - 1 AS INTEGER), '%m-%d') AS md, s = 60 AS skipped, count(o_orderkey) AS orders
    FROM range(1, 367) t(s) LEFT JOIN orders ON {slot_sql('o_orderdate')} = s GROUP BY s""",
)
def e10(spark, sf_dir):
    """All 366 slots of a common year with the orders of each, none included."""
    counts = read(spark, sf_dir, "orders").groupBy(cal.slot_of_date(F.col("o_orderdate")).alias("slot")).agg(F.count("*").alias("orders"))
    md = F.concat_ws("-", F.lpad(F.col("m").cast("string"), 2, "0"), F.lpad(F.col("d").cast("string"), 2, "0"))
    spine = slot_spine(spark, 1999).select("slot", md.alias("md"), "skipped")
    return spine.join(F.broadcast(counts), "slot", "left").select("slot", "md", "skipped", F.coalesce("orders", F.lit(0)).alias("orders"))  # 366 counts at most


def slot_spine(spark, year: int):
    """The 366 slots with month, day and whether the year skips the slot."""
    m, d = cal.month_day_of_slot(F.col("slot"))
    spine = spark.range(1, cal.SLOTS + 1).select(F.col("id").cast("int").alias("slot"))
    return spine.select("slot", m.alias("m"), d.alias("d"), cal.slot_skipped(F.col("slot"), F.lit(year)).alias("skipped"))
