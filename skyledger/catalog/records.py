"""Activity records over events, conversations, customer and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.dates import slot_sql, slot_spine
from skyledger.functions import calendar as cal
from skyledger.functions.fold import is_blank
from skyledger.operators import records, stored
from skyledger.operators.order import with_position
from skyledger.registry import query
from skyledger.sources.tables import read, scratch
from skyledger.sources.tables import stored as written
from skyledger.streaming.commit import changes_of, merged_stream
from skyledger.streaming.streaks import run_streaks, streaks_of

TODAY = "DATE '2024-01-28'"
DAYS_SQL = "d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)"
ISLANDS_SQL = f"{DAYS_SQL}, g AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS k FROM d), i AS (SELECT user_id, k, min(d) AS a, max(d) AS b, count(*) AS n FROM g GROUP BY user_id, k)"


def days(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"))


def today():
    return F.lit("2024-01-28").cast("date")


@query("w3_current_streak", f"WITH {ISLANDS_SQL.replace('FROM events', f'FROM events WHERE CAST(ts AS DATE) <= {TODAY}')} SELECT user_id, coalesce(max(n) FILTER (b BETWEEN {TODAY} - 1 AND {TODAY}), 0) AS streak FROM i GROUP BY user_id")
def w3(spark, sf_dir):
    return records.current_streak(days(spark, sf_dir), "user_id", "d", today())


@query("w4_longest_streak", f"WITH {ISLANDS_SQL} SELECT user_id, max(n) AS longest FROM i GROUP BY user_id")
def w4(spark, sf_dir):
    return records.longest_streak(days(spark, sf_dir), "user_id", "d")


@query("w3_running_streaks", f"WITH {ISLANDS_SQL} SELECT user_id, coalesce(max(CASE WHEN a <= {TODAY} AND b >= {TODAY} - 1 THEN date_diff('day', a, least(b, {TODAY})) + 1 END), 0) AS streak, max(n) AS longest FROM i GROUP BY user_id")
def w3_running(spark, sf_dir):
    """Both streaks of every user from islands that a stream of days keeps up to date, whatever the order in which days come."""
    marked = changes_of(spark, f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("d"))
    return streaks_of(run_streaks(marked, "user_id", "d").read(), "user_id", today())


@query("a4_distinct_days", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id")
def a4(spark, sf_dir):
    return days(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("d").alias("days"))


DONE_SQL = "x AS (SELECT o_custkey, count(DISTINCT " + slot_sql("o_orderdate") + ") AS done FROM orders GROUP BY o_custkey)"


@query("a5_progress", f"WITH {DONE_SQL} SELECT o_custkey, done, CAST(366 AS INTEGER) AS total, CAST(floor(done / 366 * 100 + 0.5) AS INTEGER) AS percent FROM x")
def a5(spark, sf_dir):
    done = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(cal.slot_of_date(F.col("o_orderdate"))).alias("done"))
    return done.select("o_custkey", "done", F.lit(cal.SLOTS).alias("total"), records.progress(F.col("done")).alias("percent"))


MARKS_SQL = f"""m AS (SELECT DISTINCT {slot_sql('ts')} AS slot, event_type FROM events),
p AS (SELECT slot, count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')) AS marks FROM m GROUP BY slot)"""


@query("j9_heatmap_spine", f"WITH {MARKS_SQL} SELECT CAST(s AS INTEGER) AS slot, s = 60 AS skipped, CAST(coalesce(marks, 0) AS INTEGER) AS marks FROM range(1, 367) t(s) LEFT JOIN p ON p.slot = s")
def j9(spark, sf_dir):
    """The 366 slots with 0 to 4 marks: one for each kind of event that happened on the slot's day."""
    kinds = ("view", "click", "purchase", "signup")
    marks = sum((F.bool_or(F.col("event_type") == k).cast("int") for k in kinds), F.lit(0)).alias("marks")
    per_slot = read(spark, sf_dir, "events").groupBy(cal.slot_of_date(F.col("ts")).alias("slot")).agg(marks)
    return slot_spine(spark, 1999).select("slot", "skipped").join(per_slot, "slot", "left").select("slot", "skipped", F.coalesce("marks", F.lit(0)).alias("marks"))


@query("a9_capped_level", "SELECT user_id, CAST(CAST(ts AS DATE) AS DATE) AS d, count(*) AS marks, least(count(*), 4) AS level FROM events GROUP BY ALL")
def a9(spark, sf_dir):
    per_day = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("marks"))
    return per_day.withColumn("level", F.least("marks", F.lit(4).cast("long")))


#: Two records of the same kind: conversations with even and with odd numbers share references.
TEXTS_SQL = "mine AS (SELECT conv_id // 2 * 100 + turn AS ref, text FROM conversations WHERE conv_id % 2 = 0), theirs AS (SELECT conv_id // 2 * 100 + turn AS ref, text FROM conversations WHERE conv_id % 2 = 1)"


def two_records(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations")
    ref = (F.floor(F.col("conv_id") / 2) * 100 + F.col("turn")).alias("ref")
    return talk.where("conv_id % 2 = 0").select(ref, "text"), talk.where("conv_id % 2 = 1").select(ref, "text")


@query("a11_longest_text_merge", f"WITH {TEXTS_SQL} SELECT coalesce(m.ref, t.ref) AS ref, CASE WHEN m.ref IS NULL THEN t.text WHEN t.ref IS NULL THEN m.text WHEN length(coalesce(t.text, '')) > length(coalesce(m.text, '')) THEN t.text ELSE m.text END AS text FROM mine m FULL JOIN theirs t ON m.ref = t.ref")
def a11(spark, sf_dir):
    return records.merged_texts(*two_records(spark, sf_dir), "ref", "text")


PLANS_SQL = f"mine AS (SELECT o_custkey AS id, min(o_orderdate) AS start, list(DISTINCT {slot_sql('o_orderdate')}) AS done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), theirs AS (SELECT o_custkey, min(CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END), list(DISTINCT {slot_sql('o_orderdate')}) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT * FROM mine UNION ALL SELECT * FROM theirs)"


@query("a11_plan_merge", f"WITH {PLANS_SQL} SELECT id, CAST(min(start) AS DATE) AS start, array_to_string(list_sort(list_distinct(flatten(list(done)))), ',') AS done FROM b GROUP BY id")
def a11_plans(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("slot", cal.slot_of_date(F.col("o_orderdate"))).withColumn("day", F.to_date("o_orderdate"))

    def side(rows, start):
        return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.min(start).alias("start"), F.collect_set("slot").alias("done"))

    mine = side(orders.where("o_orderstatus = 'F'"), F.col("day"))
    theirs = side(orders.where("o_orderstatus <> 'F'"), F.when(F.col("o_custkey") % 3 > 0, F.col("day")))
    return records.merged_plans(mine, theirs, "id").select("id", "start", F.array_join(F.col("done").cast("array<string>"), ",").alias("done"))


@query("a13_bucket_totals", "SELECT event_type AS bucket, count(*) AS n FROM events GROUP BY event_type")
def a13(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))


@query("a14_any_answer", "SELECT conv_id, bool_or(regexp_matches(coalesce(text, ''), '\\S')) AS answered FROM conversations WHERE role = 'user' GROUP BY conv_id")
def a14(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.bool_or(~is_blank(F.col("text"))).alias("answered"))


ABSENT_SQL = "mine AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), inc AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


@query("j10_insert_if_absent", f"WITH {ABSENT_SQL} SELECT k, v, false AS added FROM mine UNION ALL SELECT k, v, true FROM inc WHERE k NOT IN (SELECT k FROM mine)")
def j10(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    side = lambda status: orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return records.insert_absent(side("F"), side("O"), ["k"])


@query("j19_goals_checked", "SELECT c_custkey, 'g-' || c_nationkey || '-' || (c_custkey % 7) AS goal, o_custkey IS NOT NULL AS checked FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def j19(spark, sf_dir):
    checks = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    goal = F.concat_ws("-", F.lit("g"), F.col("c_nationkey"), F.col("c_custkey") % 7)
    return read(spark, sf_dir, "customer").join(checks, "c_custkey", "left").select("c_custkey", goal.alias("goal"), F.col("hit").isNotNull().alias("checked"))


@query("j20_kept_flag", f"WITH k AS (SELECT DISTINCT {slot_sql('ts')} AS slot FROM events WHERE event_type = 'purchase') SELECT CAST(s AS INTEGER) AS slot, k.slot IS NOT NULL AS kept FROM range(1, 367) t(s) LEFT JOIN k ON k.slot = s")
def j20(spark, sf_dir):
    kept = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(cal.slot_of_date(F.col("ts")).alias("slot"), F.lit(True).alias("hit")).distinct()
    return slot_spine(spark, 1999).join(kept, "slot", "left").select("slot", F.col("hit").isNotNull().alias("kept"))


@query("o1_two_key_sort", "SELECT event_id, row_number() OVER (ORDER BY CAST(ts AS DATE) DESC, value DESC, event_id) AS place FROM events")
def o1(spark, sf_dir):
    """Every entry with its place, date then value descending."""
    entries = read(spark, sf_dir, "events").select("event_id", "value", F.to_date("ts").alias("d"))
    return with_position(entries, F.desc("d"), F.desc("value"), F.asc("event_id")).select("event_id", (F.col("pos") + 1).alias("place"))


@query("o2_slot_sort", f"SELECT user_id, list_aggregate(list_sort(list(DISTINCT {slot_sql('ts')})), 'string_agg', ',') AS slots FROM events GROUP BY user_id")
def o2(spark, sf_dir):
    kept = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(cal.slot_of_date(F.col("ts")))).alias("s"))
    return kept.select("user_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("slots"))


@query("o6_date_key_sort", "SELECT user_id, string_agg(DISTINCT strftime(ts, '%m-%d'), ' ' ORDER BY strftime(ts, '%m-%d')) AS days FROM events GROUP BY user_id")
def o6(spark, sf_dir):
    keys = F.array_sort(F.collect_set(F.date_format("ts", "MM-dd")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(keys, " ").alias("days"))


@query("p6_prefix_filter", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, left(o_orderpriority, 1) || '-U') OR starts_with(o_orderpriority, '2')")
def p6(spark, sf_dir):
    """Keys that start with '<track>-U' or with a fixed prefix (the latter reaches the scan)."""
    key = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").where(F.startswith(key, F.concat(F.left(key, F.lit(1)), F.lit("-U"))) | key.startswith("2")).select("o_orderkey")


@query("p15_lookup_with_default", "SELECT k, coalesce(c.text, '') AS text FROM (SELECT DISTINCT conv_id AS k FROM conversations) LEFT JOIN conversations c ON c.conv_id = k AND c.turn = 3")
def p15(spark, sf_dir):
    entries = read(spark, sf_dir, "conversations").where("turn = 3").select(F.col("conv_id").alias("k"), "text")
    keys = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k")).distinct()
    return keys.join(entries, "k", "left").select("k", F.coalesce("text", F.lit("")).alias("text"))


@query("p16_state_or_default", f"WITH {DONE_SQL} SELECT c_custkey, coalesce(done, 0) AS done, done IS NULL AS fresh FROM customer LEFT JOIN x ON c_custkey = o_custkey")
def p16(spark, sf_dir):
    state = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct(cal.slot_of_date(F.col("o_orderdate"))).alias("done"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(state, "c_custkey", "left").select("c_custkey", F.coalesce("done", F.lit(0)).alias("done"), F.col("done").isNull().alias("fresh"))


@query("p17_chosen_theme", "WITH s AS (SELECT user_id, arg_max(event_type, ts) FILTER (event_type <> 'view') AS session, arg_max(event_type, ts) AS stored FROM events GROUP BY user_id), t(name, note) AS (VALUES ('click', 'press'), ('purchase', 'give'), ('view', 'look')) SELECT user_id, coalesce(session, stored) AS chosen, note FROM s LEFT JOIN t ON name = coalesce(session, stored)")
def p17(spark, sf_dir):
    themes = spark.createDataFrame([("click", "press"), ("purchase", "give"), ("view", "look")], "name string, note string")
    seen = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("event_type") != "view", F.col("ts"))).alias("session"), F.max_by("event_type", "ts").alias("stored"))
    return seen.withColumn("chosen", F.coalesce("session", "stored")).join(F.broadcast(themes), F.col("chosen") == F.col("name"), "left").select("user_id", "chosen", "note")


#: Stored records as text: plain; with a theme and a name that this version does not know; cut off; no record at all; lists and objects in the wrong
#: places; in the right ones, with nulls and a nested unknown; a list as the whole; empty.
BLOBS = [
    "props", """'{"k": ' || event_id || ', "novel": "n' || event_id || '", "theme": "dark"}'""", """'{"k": ' || event_id""", """'"' || event_type || '"'""",
    """'{"days": {"a": 1}, "k": [' || event_id || '], "prefs": 3, "theme": {"b": "c"}}'""",
    """'{"days": ["2024-01-0' || event_id % 9 || '"], "deep": {"a": [' || event_id || ', {"b": true}]}, "prefs": {"size": ' || event_id || '}, "theme": null}'""",
    """'[10, {"k": ' || event_id || '}]'""", """CASE WHEN event_id % 16 < 8 THEN '' END""",
]
BLOB_SQL = "b AS (SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(BLOBS)) + " END AS blob FROM events)"
RECORD_DEFAULTS = {"k": 0, "theme": "auto", "days": [], "prefs": {}}
_defaults_sql = """d(name, plain, fits) AS (VALUES ('k', '0', NULL), ('theme', '"auto"', NULL), ('days', '[]', ['ARRAY']), ('prefs', '{}', ['OBJECT', 'ARRAY']))"""


@query(
    "s9_schema_merge",
    f"""WITH {BLOB_SQL}, {_defaults_sql}, r AS (SELECT event_id, nullif(blob, '') AS blob, json_valid(nullif(blob, '')) AS sound FROM b),
    o AS (SELECT event_id, CAST(blob AS JSON) AS j, json_type(CAST(blob AS JSON)) AS kind FROM r WHERE sound),
    e AS (SELECT event_id, unnest(json_keys(j)) AS name, j FROM o WHERE kind = 'OBJECT'),
    m AS (SELECT event_id, name, j -> ('$."' || name || '"') AS v FROM e UNION ALL SELECT event_id, CAST(i AS VARCHAR), j -> CAST(i AS INTEGER) FROM (SELECT *, unnest(range(0, CAST(json_array_length(j) AS BIGINT))) AS i FROM o WHERE kind = 'ARRAY')),
    good AS (SELECT m.event_id, m.name, m.v FROM m JOIN o USING (event_id) JOIN d USING (name) WHERE o.kind = 'OBJECT' AND (fits IS NULL OR list_contains(fits, json_type(v))))
    SELECT r.event_id, d.name, CAST(coalesce(good.v, d.plain) AS VARCHAR) AS value, CASE WHEN good.event_id IS NULL THEN 'default' ELSE 'adopted' END AS source FROM r CROSS JOIN d LEFT JOIN good ON good.event_id = r.event_id AND good.name = d.name
    UNION ALL SELECT event_id, name, CAST(v AS VARCHAR), 'carried' FROM m WHERE name NOT IN (SELECT name FROM d)
    UNION ALL SELECT event_id, NULL, CAST(to_json(blob) AS VARCHAR), 'aside' FROM r WHERE NOT sound""",
)
def s9(spark, sf_dir):
    """Every stored record's entries: known names by shape over their defaults, unknown ones carried along; the text of an unreadable record is kept aside."""
    blobs = [F.expr(x) for x in BLOBS]
    kind = F.col("event_id") % 8
    blob = F.coalesce(*(F.when(kind == i, x) for i, x in enumerate(blobs)))
    found = stored.adopted(read(spark, sf_dir, "events").select("event_id", blob.alias("blob")), "event_id", "blob", RECORD_DEFAULTS)
    return found.select("event_id", "name", F.to_json("value").alias("value"), "source")


#: Old records of every customer by orders: `kept` of the days with an order (m-d), `checks` by day and priority, `days` without padding and one entry that is no day.
#: Every eleventh customer's `kept` is cut off. The state has entries by the orders that are not finished, some of them 0. Every tenth customer was migrated before.
LEGACY_SQL = """o AS (SELECT o_custkey AS id, o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
md AS (SELECT *, month(d) || '-' || day(d) AS short, strftime(d, '%Y-%m-%d') AS long_ FROM o),
old AS (SELECT id, 'kept' AS bucket, 'sages:' || short AS k FROM md WHERE s = 'F' AND id % 11 > 0
  UNION SELECT id, 'checks', long_ || ':' || p FROM md WHERE s = 'F' UNION SELECT id, 'days', long_ FROM md WHERE s = 'F'),
state AS (SELECT id, 'kept' AS bucket, 'sages:' || short AS k, CASE WHEN min(o_orderkey) % 3 = 0 THEN '0' ELSE '1' END AS v FROM md WHERE s <> 'F' GROUP BY ALL
  UNION ALL SELECT DISTINCT id, 'days', long_, '0' FROM md WHERE s <> 'F')"""


def legacy_tables(spark, sf_dir):
    """(state, legacy, ledger) as told above."""
    d = F.to_date("o_orderdate")
    short, long_ = F.concat_ws("-", F.month(d), F.dayofmonth(d)), F.date_format(d, "yyyy-MM-dd")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), short.alias("short"), long_.alias("long"), F.concat_ws("-", F.year(d), "short").alias("unpadded"))
    old = orders.where("s = 'F'").groupBy("id")
    marks = lambda c: F.to_json(F.map_from_entries(F.collect_set(F.struct(c, F.lit(1)))))
    made = old.agg(marks(F.col("short")).alias("kept"), marks(F.concat_ws(":", "long", "p")).alias("checks"), F.to_json(F.array_append(F.collect_set("unpadded"), F.lit("someday"))).alias("days"))
    cut = F.when(F.col("id") % 11 == 0, F.substring("kept", 1, 6)).otherwise(F.col("kept"))
    blobs = F.array(*(F.struct(F.lit(n).alias("name"), b.alias("blob")) for n, b in (("kept", cut), ("checks", F.col("checks")), ("days", F.col("days")))))
    legacy = made.select("id", F.explode(blobs).alias("x")).select("id", "x.*")
    open_ = orders.where("s <> 'F'")
    kept = open_.groupBy("id", F.lit("kept").alias("bucket"), F.concat(F.lit("sages:"), "short").alias("k")).agg(F.when(F.min("o_orderkey") % 3 == 0, "0").otherwise("1").alias("v"))
    state = kept.unionByName(open_.select("id", F.lit("days").alias("bucket"), F.col("long").alias("k"), F.lit("0").alias("v")).distinct())
    return state, legacy, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).where("id % 10 = 0").distinct()


@query(
    "s10_legacy_migration",
    f"""WITH {LEGACY_SQL}, added AS (SELECT old.* FROM old LEFT JOIN state USING (id, bucket, k) WHERE old.id % 10 > 0 AND (state.id IS NULL OR old.bucket <> 'days' AND state.v = '0'))
    SELECT id, bucket, k, '1' AS v, 1 AS run FROM added UNION ALL SELECT id, bucket, k, v, 0 FROM state WHERE (id, bucket, k) NOT IN (SELECT (id, bucket, k) FROM added)""",
)
def s10(spark, sf_dir):
    """The state after the migration was run twice: which run put an entry in (0: it was there). The second finds every owner in the ledger and adds nothing."""
    state, legacy, ledger = legacy_tables(spark, sf_dir)
    legacy = written(legacy, "legacy")
    state = state.withColumn("run", F.lit(0))
    for number in (1, 2):
        added, done = stored.migration(state, legacy, ledger, "id", "sages:")
        state, ledger = written(stored.with_entries(state, added.withColumn("run", F.lit(number)), ["id", "bucket", "k"]), "migrated"), written(ledger.unionByName(done), "ledger")
    return state


EXPORTED = "2024-01-28T07:00:00.000Z"


@query("s11_export_json", f"""SELECT conv_id, '{{"app":"skyledger","schema":1,"exported":"{EXPORTED}","record":{{"turns":[' || string_agg('{{"turn":' || turn || ',"role":"' || role || '"}}', ',' ORDER BY turn) || ']}}}}' AS record FROM conversations GROUP BY conv_id""")
def s11(spark, sf_dir):
    """A record in its envelope: who wrote it, in which version, when."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    envelope = F.struct(F.lit("skyledger").alias("app"), F.lit(1).alias("schema"), F.lit(EXPORTED).alias("exported"), F.struct("turns").alias("record"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(envelope).alias("record"))


#: Two whole records as rows (bucket, k, v): this device's (mine) and the file's. Events give the buckets of marks and the days, conversations
#: the journal, orders the examen and the plans.
RECORDS_SQL = f"""{ABSENT_SQL.replace('mine AS', 'xm AS').replace('inc AS', 'xt AS')}, {TEXTS_SQL.replace('mine AS', 'jm AS').replace('theirs AS', 'jt AS')},
marks AS (SELECT user_id % 2 = 0 AS is_mine, CASE event_type WHEN 'view' THEN 'kept' WHEN 'click' THEN 'checks' WHEN 'purchase' THEN 'practice' WHEN 'signup' THEN 'intents' ELSE 'prefs' END AS bucket, strftime(ts, '%m-%d %H') AS k, CASE min(event_id) % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE CAST(min(event_id) AS VARCHAR) END AS v FROM events GROUP BY ALL),
days AS (SELECT DISTINCT user_id % 2 = 0 AS is_mine, 'days' AS bucket, CAST(CAST(ts AS DATE) AS VARCHAR) AS k, '1' AS v FROM events),
whole AS (SELECT * FROM marks UNION ALL SELECT * FROM days
  UNION ALL SELECT true, 'examen', CAST(k AS VARCHAR), CAST(v AS VARCHAR) FROM xm UNION ALL SELECT false, 'examen', CAST(k AS VARCHAR), CAST(v AS VARCHAR) FROM xt
  UNION ALL SELECT true, 'journal', CAST(ref AS VARCHAR), text FROM jm UNION ALL SELECT false, 'journal', CAST(ref AS VARCHAR), text FROM jt),
met AS (SELECT coalesce(m.bucket, t.bucket) AS bucket, coalesce(m.k, t.k) AS k, m.v AS mine, t.v AS theirs, m.k IS NOT NULL AS has_mine, t.k IS NOT NULL AS has_theirs,
  m.k IS NOT NULL AND (m.bucket IN ('journal', 'days', 'prefs') OR coalesce(m.v NOT IN ('', '0', 'null', 'false'), false)) AS keeps
  FROM (SELECT * FROM whole WHERE is_mine) m FULL JOIN (SELECT * FROM whole WHERE NOT is_mine) t ON m.bucket = t.bucket AND m.k = t.k),
pairs AS (SELECT bucket, k, has_theirs AND NOT keeps AS added,
  CASE WHEN bucket = 'journal' AND has_mine AND has_theirs THEN CASE WHEN length(coalesce(theirs, '')) > length(coalesce(mine, '')) THEN theirs ELSE mine END
    WHEN keeps OR NOT has_theirs THEN mine ELSE theirs END AS v FROM met)"""


def whole_records(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("is_mine", F.col("user_id") % 2 == 0)
    kind = F.col("event_type")
    bucket = F.when(kind == "view", "kept").when(kind == "click", "checks").when(kind == "purchase", "practice").when(kind == "signup", "intents").otherwise("prefs")
    marks = events.groupBy("is_mine", bucket.alias("bucket"), F.date_format("ts", "MM-dd HH").alias("k")).agg(F.min("event_id").alias("e"))
    value = F.when(F.col("e") % 5 == 0, "0").when(F.col("e") % 5 > 1, F.col("e").cast("string"))  # some are 0 or null
    marks = marks.withColumn("v", value).drop("e")
    own_days = events.select("is_mine", F.lit("days").alias("bucket"), F.to_date("ts").cast("string").alias("k"), F.lit("1").alias("v")).distinct()
    orders = read(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
    examen = orders.groupBy((F.col("o_orderstatus") == "F").alias("is_mine"), F.col("o_custkey").cast("string").alias("k")).agg(F.min("o_orderkey").cast("string").alias("v")).withColumn("bucket", F.lit("examen"))
    talk = [side.select(F.lit(own).alias("is_mine"), F.lit("journal").alias("bucket"), F.col("ref").cast("string").alias("k"), F.col("text").alias("v")) for own, side in zip((True, False), two_records(spark, sf_dir), strict=True)]
    whole = marks.unionByName(own_days).unionByName(examen).unionByName(talk[0]).unionByName(talk[1])
    return stored.imported(whole.where("is_mine"), whole.where("NOT is_mine"), ["journal"], ["days", "prefs"])


@query("s12_import_counts", f"WITH {RECORDS_SQL} SELECT bucket, count(*) FILTER (added) AS added FROM pairs WHERE bucket IN ('kept', 'checks', 'days', 'journal', 'examen', 'practice') GROUP BY bucket")
def s12(spark, sf_dir):
    """How many entries of the file were new, for each of the six buckets that are told."""
    told = whole_records(spark, sf_dir).where(F.col("bucket").isin("kept", "checks", "days", "journal", "examen", "practice"))
    return told.groupBy("bucket").agg(F.count_if("added").alias("added"))


@query("s12_import_merge", f"WITH {RECORDS_SQL} SELECT bucket, k, v, added FROM pairs UNION ALL SELECT 'canon', CAST(id AS VARCHAR), coalesce(CAST(start AS VARCHAR), '-') || ' ' || done, NOT own FROM (WITH {PLANS_SQL.replace('b AS (SELECT * FROM mine UNION ALL SELECT * FROM theirs)', 'b AS (SELECT *, true AS own FROM mine UNION ALL SELECT *, false FROM theirs)')} SELECT id, CAST(min(start) AS DATE) AS start, array_to_string(list_sort(list_distinct(flatten(list(done)))), ',') AS done, bool_or(own) AS own FROM b GROUP BY id)")
def s12_merge(spark, sf_dir):
    """The merged record: every entry of both, plans with the earliest known start and all days done."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("own"))
    plans = a11_plans(spark, sf_dir).join(orders, "id")
    canon = plans.select(F.lit("canon").alias("bucket"), F.col("id").cast("string").alias("k"), F.concat_ws(" ", F.coalesce(F.col("start").cast("string"), F.lit("-")), "done").alias("v"), (~F.col("own")).alias("added"))
    return whole_records(spark, sf_dir).select("bucket", "k", "v", "added").unionByName(canon)


@query("s13_file_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s13(spark, sf_dir):
    """Write as JSON files and read back with a schema."""
    path = scratch(spark, "export")
    nation = read(spark, sf_dir, "nation")
    nation.write.json(path)
    return spark.read.schema(nation.schema).json(path)


@query("s14_journal_upsert", "WITH c AS (SELECT user_id AS ref, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text, ts, event_id FROM events), l AS (SELECT ref, arg_max(text, event_id) AS text, min(event_id) AS first_event_id, max(event_id) AS last_event_id FROM c GROUP BY ref) SELECT * FROM l WHERE trim(text) <> ''")
def s14(spark, sf_dir):
    """The journal's changes as a stream, merged into its state; the entries that are left."""
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    changes = changes_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("ref"), text.alias("body"), "event_id")
    rows = records.journal_changes(changes, "ref", "body", ["event_id"], ["event_id"])
    state = merged_stream(rows, ["ref"], lambda x: records.journal_state(x, "ref", ["event_id"], ["event_id"]))
    return records.entries_of(state.read(), "ref")


@query("u1_union_distinct", "SELECT CAST(ts AS DATE) AS d FROM events WHERE user_id % 2 = 0 UNION SELECT CAST(ts AS DATE) FROM events WHERE user_id % 2 = 1")
def u1(spark, sf_dir):
    d = days(spark, sf_dir)
    return d.where("user_id % 2 = 0").select("d").union(d.where("user_id % 2 = 1").select("d")).distinct()


@query("u2_first_writer_wins", f"WITH {TEXTS_SQL}, b AS (SELECT ref, text, 0 AS p FROM mine UNION ALL SELECT ref, text, 1 FROM theirs) SELECT ref, length(arg_min(text, p)) AS chars FROM b GROUP BY ref")
def u2(spark, sf_dir):
    mine, theirs = two_records(spark, sf_dir)
    both = mine.withColumn("p", F.lit(0)).unionByName(theirs.withColumn("p", F.lit(1)))
    return both.groupBy("ref").agg(F.length(F.min_by("text", "p")).cast("long").alias("chars"))


@query("u4_toggle", "SELECT user_id, CAST(ts AS DATE) AS d FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def u4(spark, sf_dir):
    return records.toggled(days(spark, sf_dir), ["user_id", "d"])


@query("u5_distinct_parts", "SELECT DISTINCT lang, source FROM documents")
def u5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("u6_idempotent_insert", f"WITH {DAYS_SQL}, u AS (SELECT DISTINCT user_id FROM d) SELECT user_id, count(*) AS days, bool_or(is_new) AS is_new FROM (SELECT user_id, d, false AS is_new FROM d UNION ALL SELECT user_id, {TODAY}, true FROM u WHERE (user_id, {TODAY}) NOT IN (SELECT user_id, d FROM d)) GROUP BY user_id")
def u6(spark, sf_dir):
    """Mark today once for every user; report whether it was new."""
    held = days(spark, sf_dir).distinct()
    mark = held.select("user_id").distinct().withColumn("d", today())
    fresh = mark.join(held, ["user_id", "d"], "left_anti").withColumn("is_new", F.lit(True))
    return held.withColumn("is_new", F.lit(False)).unionByName(fresh).groupBy("user_id").agg(F.count("*").alias("days"), F.bool_or("is_new").alias("is_new"))


LAST_SQL = "l AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, event_id) AS intent FROM events GROUP BY ALL)"


@query("u7_exclusive_value", f"WITH {LAST_SQL} SELECT user_id, d, intent FROM l WHERE intent <> 'error'")
def u7(spark, sf_dir):
    """One value per day: the last choice stands, an 'error' takes it back."""
    changes = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_id", F.col("event_type").alias("intent"))
    return records.latest(changes, ["user_id", "d"], ["event_id"], ["intent"]).where("intent <> 'error'")


@query(
    "u8_plan_start",
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE event_type IN ('signup', 'error'))
    SELECT user_id, CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END AS start FROM last WHERE back = 1""",
)
def u8(spark, sf_dir):
    """Last plan event: a signup starts the plan on its day, an error sends it back to the calendar (null)."""
    changes = read(spark, sf_dir, "events").where("event_type IN ('signup', 'error')").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.to_date("ts")).alias("start"))
    return records.latest(changes, ["user_id"], ["event_id"], ["start"])


@query("f46_json_round_trip", "SELECT event_id, props AS again FROM events")
def f46(spark, sf_dir):
    parsed = F.from_json("props", "map<string,int>")
    return read(spark, sf_dir, "events").select("event_id", F.regexp_replace(F.regexp_replace(F.to_json(parsed), ":", ": "), ",", ", ").alias("again"))


@query("f47_map_as_set", "SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n, bool_or(event_type = 'signup') AS has_signup, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id")
def f47(spark, sf_dir):
    pairs = F.map_from_entries(F.collect_set(F.struct("event_type", F.lit(1).alias("one"))))
    held = read(spark, sf_dir, "events").groupBy("user_id").agg(pairs.alias("m"))
    return held.select("user_id", F.size("m").alias("n"), F.map_contains_key("m", "signup").alias("has_signup"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))
