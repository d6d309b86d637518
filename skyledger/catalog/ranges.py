"""Lookups, dimension joins, interval and pair joins over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.longitudes import longitudes_sql
from skyledger.functions.ephemeris import with_longitudes
from skyledger.operators import ranges
from skyledger.operators.order import with_position
from skyledger.registry import query
from skyledger.sources.tables import read


@query("p1_point_lookup", "SELECT o_orderkey, coalesce(o_orderpriority, '') AS note FROM orders WHERE month(o_orderdate) = 3 AND day(o_orderdate) = 15")
def p1(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").where((F.month(d) == 3) & (F.dayofmonth(d) == 15)).select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("note"))


@query("p2_month_slice", "SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders WHERE month(o_orderdate) = 7 ORDER BY d, o_orderkey")
def p2(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.month("o_orderdate") == 7).select("o_orderkey", F.dayofmonth("o_orderdate").alias("d")).orderBy("d", "o_orderkey")


@query("p4_id_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def p4(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_custkey = 77").select("c_custkey", "c_name").limit(1)


@query("p5_array_membership", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING list_contains(list(n_nationkey), 7)")
def p5(spark, sf_dir):
    works = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("works"))
    return works.where(F.array_contains("works", 7)).select("n_regionkey")


@query("p7_flag_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def p7(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey", "l_linenumber")


@query("p8_present_and_pending", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer")
def p8(spark, sf_dir):
    works, library = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    present = works.join(library, "c_custkey", "left_semi").withColumn("present", F.lit(True))
    return present.unionByName(works.join(library, "c_custkey", "left_anti").withColumn("present", F.lit(False)))


@query("p13_mode_choice", "SELECT event_id, coalesce(CASE WHEN event_id % 11 = 0 THEN 'forced' END, CASE WHEN event_type = 'view' THEN 'page' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'guided' END) AS mode FROM events")
def p13(spark, sf_dir):
    saved = F.when(F.col("event_type") == "view", "page").when(F.hour("ts") >= 18, "evening").otherwise("guided")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 11 == 0, "forced"), saved).alias("mode"))


@query("p14_route_parse", "WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS route FROM pages) SELECT page_id, CASE WHEN split_part(route, '/', 1) IN ('en', 'de') THEN split_part(route, '/', 1) ELSE 'today' END AS view, CASE WHEN contains(route, '/') THEN substr(route, instr(route, '/') + 1) ELSE '' END AS rest FROM x".replace("AS view", 'AS "view"'))
def p14(spark, sf_dir):
    """First segment as the view (unknown ones lead to today), the rest with its slashes."""
    route = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    first = F.split(route, "/")[0]
    rest = F.when(F.contains(route, F.lit("/")), F.regexp_replace(route, "^[^/]*/", "")).otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", F.when(first.isin("en", "de"), first).otherwise("today").alias("view"), rest.alias("rest"))


@query("j1_lookup_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j2_left_lookup", "SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS place FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def j2(spark, sf_dir):
    known = read(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return read(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("place"))


@query("j3_positional_join", "SELECT c_custkey, ['UTC', 'Europe/Paris', 'America/New_York', 'Asia/Tokyo'][c_nationkey % 4 + 1] AS zone FROM customer")
def j3(spark, sf_dir):
    zones = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("UTC", "Europe/Paris", "America/New_York", "Asia/Tokyo")))).alias("i", "zone"))
    return read(spark, sf_dir, "customer").join(F.broadcast(zones), F.col("c_nationkey") % 4 == F.col("i")).select("c_custkey", "zone")


#: Where the twelve signs begin, as month * 100 + day, in the order of the year; the tenth wraps over the year's end.
SIGN_STARTS = [321, 420, 521, 621, 723, 823, 923, 1023, 1122, 1222, 120, 219]
#: The day before the next sign begins; none begins on the first of a month.
SIGN_ENDS = [start - 1 for start in [*SIGN_STARTS[1:], SIGN_STARTS[0]]]
SIGNS_SQL = "g(i, lo, hi) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(SIGN_STARTS, SIGN_ENDS, strict=True))) + ")"


def signs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(SIGN_STARTS, SIGN_ENDS, strict=True))], "i int, lo int, hi int")


@query("j14_wrapping_intervals", f"WITH {SIGNS_SQL}, o AS (SELECT o_orderkey, CAST(month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS md FROM orders) SELECT o_orderkey, md, CAST(i AS INTEGER) AS sign FROM o JOIN g ON CASE WHEN lo <= hi THEN md BETWEEN lo AND hi ELSE md >= lo OR md <= hi END")
def j14(spark, sf_dir):
    dated = read(spark, sf_dir, "orders").select("o_orderkey", (F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).cast("int").alias("md"))
    return ranges.in_interval(dated, "md", ranges.unwrapped(signs(spark), "lo", "hi", 101, 1231), "lo", "hi").select("o_orderkey", "md", F.col("i").alias("sign"))


#: Points of a chart: each kind of event is a body, where it stands at the kind's last event.
CHART_BODIES = {"click": "Moon", "error": "Mars", "purchase": "Venus", "signup": "Sun", "view": "Mercury"}
_body_sql = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, b in CHART_BODIES.items()) + " END"
POINTS_SQL = f"z AS (SELECT user_id % 40 AS chart, event_type AS name, {_body_sql} AS body, max(CAST(ts AS TIMESTAMP)) AS moment FROM events GROUP BY ALL), inst AS (SELECT DISTINCT moment FROM z), {longitudes_sql('inst')}, " + "p AS (SELECT chart, name, lon FROM z JOIN lon USING (moment, body)), s AS (SELECT a.chart, a.name AS a, b.name AS b, CASE WHEN abs(a.lon - b.lon) > 180 THEN 360 - abs(a.lon - b.lon) ELSE abs(a.lon - b.lon) END AS sep FROM p a JOIN p b ON a.chart = b.chart AND a.name < b.name), k(aspect, angle, o, kind) AS (VALUES ('Conjunction', 0, 8, 'major'), ('Opposition', 180, 8, 'major'), ('Trine', 120, 7, 'soft'), ('Square', 90, 7, 'hard'), ('Sextile', 60, 5, 'soft')), h AS (SELECT chart, a, b, aspect, kind, round(abs(sep - angle), 6) AS orb, round(1 - abs(sep - angle) / o, 6) AS exactness FROM s JOIN k ON abs(sep - angle) <= o)"


def aspects(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("chart"), F.col("event_type").alias("name")).agg(F.max("ts").alias("ts"))
    placed = with_longitudes(last, F.col("ts"), list(CHART_BODIES.values()), ahead=False)
    points = placed.select("chart", "name", F.coalesce(*(F.when(F.col("name") == k, F.col(f"lon_{b}")) for k, b in CHART_BODIES.items())).alias("lon"))
    return ranges.angle_pairs(points, "chart", "name", "lon").withColumns({c: F.round(c, 6) for c in ("orb", "exactness")})


@query("j16_aspect_pairs", f"WITH {POINTS_SQL} SELECT * FROM h")
def j16(spark, sf_dir):
    return aspects(spark, sf_dir)


@query("o5_sort_by_closeness", f"WITH {POINTS_SQL} SELECT chart, a, b, orb, row_number() OVER (ORDER BY orb, chart, a, b) AS place FROM h")
def o5(spark, sf_dir):
    """All aspects with their place, the closest first."""
    return with_position(aspects(spark, sf_dir).select("chart", "a", "b", "orb"), "orb", "chart", "a", "b").withColumn("place", F.col("pos") + 1).drop("pos")


RELATIONS = ["conjunct", "semi-sextile", "sextile", "square", "trine", "quincunx", "opposition"]


@query("j17_circular_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, [" + ", ".join(f"'{r}'" for r in RELATIONS) + "][least(abs(a.n_nationkey - b.n_nationkey), 12 - abs(a.n_nationkey - b.n_nationkey)) + 1] AS relation, a.n_nationkey % 4 = b.n_nationkey % 4 AS same_element, a.n_nationkey % 3 = b.n_nationkey % 3 AS same_mode FROM nation a, nation b WHERE a.n_nationkey < 12 AND b.n_nationkey < 12")
def j17(spark, sf_dir):
    """All pairs of twelve signs with their relation: a dimension of 144 rows."""
    sign = read(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("a"))
    named = spark.createDataFrame(list(enumerate(RELATIONS)), "steps int, relation string")
    pairs = sign.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("steps", ranges.sign_distance(F.col("a"), F.col("b")).cast("int"))
    return pairs.join(F.broadcast(named), "steps").select("a", "b", "relation", (F.col("a") % 4 == F.col("b") % 4).alias("same_element"), (F.col("a") % 3 == F.col("b") % 3).alias("same_mode"))


@query("j18_works_in_library", "SELECT r_name, count(*) AS works, CAST(sum(n_nationkey) AS BIGINT) AS total FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def j18(spark, sf_dir):
    shelf = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("works"))
    each = read(spark, sf_dir, "region").join(shelf, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.explode("works").alias("w"))
    return each.join(read(spark, sf_dir, "nation"), F.col("w") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("works"), F.sum("w").alias("total"))


@query("a6_shelf_totals", "SELECT coalesce(CAST(c_nationkey AS VARCHAR), 'all') AS shelf, count(*) FILTER (o_custkey IS NOT NULL) AS present, count(*) FILTER (o_custkey IS NULL) AS pending, CAST(sum(length(c_name)) FILTER (o_custkey IS NOT NULL) AS BIGINT) AS bytes FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY ROLLUP (c_nationkey)")
def a6(spark, sf_dir):
    """Works present and pending and bytes per shelf, and over all in a row of its own."""
    held = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("hit")).distinct()
    works = read(spark, sf_dir, "customer").join(held, "c_custkey", "left")
    sums = works.rollup("c_nationkey").agg(F.count("hit").alias("present"), (F.count("*") - F.count("hit")).alias("pending"), F.sum(F.when(F.col("hit").isNotNull(), F.length("c_name"))).alias("bytes"))
    return sums.select(F.coalesce(F.col("c_nationkey").cast("string"), F.lit("all")).alias("shelf"), "present", "pending", "bytes")
