"""Text parts, key-value state and streamed commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.dates import months
from skyledger.operators.records import latest
from skyledger.registry import query
from skyledger.sources.parts import PartStore, residency
from skyledger.sources.tables import read, scratch, tables_read
from skyledger.streaming.commit import changes_of, commit_stream, flushed_stream, quiet_commits


_stores: dict[tuple[str, str], PartStore] = {}


def store(spark, sf_dir) -> PartStore:
    """The documents as parts (language, source), written once in a session and read by all queries that change nothing."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        kept = PartStore(spark, scratch(spark, "parts"))
        kept.register(read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("work"), F.col("source").alias("part")))
        _stores[key] = kept
    return _stores[key]


def own_store(spark, sf_dir) -> PartStore:
    """A store of the same parts that a query may change; it holds ids alone."""
    kept = PartStore(spark, scratch(spark, "own-parts"))
    kept.register(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("work"), F.col("source").alias("part")))
    return kept


def damaged_store(spark, sf_dir) -> PartStore:
    """A store of the documents in which one part has a file without rows, one a file that is no Parquet, and one no file any more."""
    kept = PartStore(spark, scratch(spark, "damaged-parts"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"), F.col("lang").alias("work"), F.col("source").alias("part"))
    kept.register(rows.where("NOT (work = 'de' AND part = 'src3') OR work IS NULL OR part IS NULL"))
    rows.select("doc_id", "size").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{kept.path}/work=fr/part=src1")
    spark.createDataFrame([("an error page",)], "line string").coalesce(1).write.mode("overwrite").text(f"{kept.path}/work=de/part=src2")
    return kept


@query("s1_part_scan", "SELECT doc_id, length(text) AS chars FROM documents WHERE lang = 'fr' AND source = 'src3'")
def s1(spark, sf_dir):
    return store(spark, sf_dir).load("fr", "src3").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("s2_part_registration", "SELECT lang AS work, source AS part, count(*) AS n FROM documents GROUP BY ALL")
def s2(spark, sf_dir):
    return store(spark, sf_dir).table().groupBy("work", "part").agg(F.count("*").alias("n"))


WANTED_SQL = "w AS (SELECT l AS work, 'src' || i AS part FROM (VALUES ('fr'), ('de'), ('xx')) a(l), range(0, 4) b(i)), have AS (SELECT DISTINCT lang AS work, source AS part FROM documents)"


def wanted(spark):
    return spark.createDataFrame([("fr",), ("de",), ("xx",)], "work string").withColumn("part", F.explode(F.array(*(F.lit(f"src{i}") for i in range(4)))))


@query("s3_part_exists", f"WITH {WANTED_SQL} SELECT work, part FROM w JOIN have USING (work, part)")
def s3(spark, sf_dir):
    return wanted(spark).join(store(spark, sf_dir).present(), ["work", "part"], "left_semi")


#: Statuses in the damaged store.
STATUS_SQL = """CASE WHEN work = 'fr' AND part = 'src1' OR work = 'de' AND part = 'src2' THEN 'loaded-but-empty' WHEN n IS NULL OR work = 'de' AND part = 'src3' THEN 'offline-or-missing' ELSE 'loaded' END"""


@query(
    "s4_bulk_load_status",
    f"""WITH {WANTED_SQL}, n AS (SELECT lang AS work, source AS part, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT w.work, w.part, n, {STATUS_SQL.replace('work', 'w.work').replace('part', 'w.part')} AS status FROM w LEFT JOIN n USING (work, part))
    SELECT work, part, status, CASE WHEN status = 'loaded' THEN n ELSE 0 END AS rows FROM t""",
)
def s4(spark, sf_dir):
    """What became of each wanted part: an empty, a broken and a missing one do not keep the others from being read."""
    return damaged_store(spark, sf_dir).load_many(wanted(spark))[1].select("work", "part", "status", "rows")


@query(
    "s4_bulk_load_rows",
    f"""WITH {WANTED_SQL}, t AS (SELECT doc_id, lang AS work, source AS part, strlen(text) AS size, 1 AS n FROM documents) SELECT doc_id, work, part, CAST(size AS INTEGER) AS size FROM t JOIN w USING (work, part) WHERE {STATUS_SQL} = 'loaded'""",
)
def s4_rows(spark, sf_dir):
    """The rows of the wanted parts that could be read."""
    return damaged_store(spark, sf_dir).load_many(wanted(spark))[0].select("doc_id", "work", "part", "size")


@query(
    "s1_part_status",
    f"""WITH t AS (SELECT lang AS work, source AS part, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), u AS (SELECT work, part, n FROM t UNION ALL SELECT 'xx', 'src0', NULL)
    SELECT work, part, {STATUS_SQL} AS status FROM u""",
)
def s1_status(spark, sf_dir):
    """The status of every part that the documents name, and of one that nobody has."""
    named = read(spark, sf_dir, "documents").select(F.col("lang").alias("work"), F.col("source").alias("part")).where("work IS NOT NULL AND part IS NOT NULL").distinct()
    asked = named.unionByName(spark.createDataFrame([("xx", "src0")], "work string, part string"))
    return damaged_store(spark, sf_dir).status(asked).select("work", "part", "status")


@query("s5_inventory", "SELECT lang AS work, count(DISTINCT coalesce(source, '')) AS have, true AS held FROM documents GROUP BY lang")
def s5(spark, sf_dir):
    """Parts held of each work, from the files that are there, and whether they have bytes."""
    return store(spark, sf_dir).inventory().select("work", "have", (F.col("held_bytes") > 0).alias("held"))


@query("s6_evict", "SELECT lang AS work, count(DISTINCT source) AS have, (SELECT count(DISTINCT source) FROM documents WHERE lang = 'de') AS evicted FROM documents WHERE lang <> 'de' GROUP BY lang")
def s6(spark, sf_dir):
    kept = own_store(spark, sf_dir)
    gone = kept.forget("de")
    return kept.inventory().select("work", "have", F.lit(gone).cast("long").alias("evicted"))


@query("s7_key_value_state", "SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def s7(spark, sf_dir):
    """Writes of a key in order; a read gives the last one."""
    return latest(read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.col("event_type").alias("v")), ["k"], ["event_id"], ["v"])


@query("s8_streamed_commit", "SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def s8(spark, sf_dir):
    """The events table as a stream, committed in micro-batches."""
    changes = changes_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("last_id"))
    return commit_stream(changes, ["user_id", "event_type"], ["event_id"], ["last_id", "value"])


@query(
    "s8_quiet_gap",
    """WITH c AS (SELECT user_id, event_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events), g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS changes FROM s GROUP BY user_id, session""",
)
def s8_quiet(spark, sf_dir):
    """Of a user's changes no more than six hours apart the last one, committed by the stream once the gap has passed; the rest is flushed at the end."""
    changes = changes_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    done = flushed_stream(changes, lambda rows: quiet_commits(rows, ["user_id"], "ts", ["ts", "event_id"], ["event_id", "event_type"], "6 hours", "40 days"), "ts")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query(
    "s15_static_dimension",
    "SELECT CAST(m AS INTEGER) AS m, CAST([31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m] AS INTEGER) AS days, count(o_orderkey) AS orders FROM range(1, 13) t(m) LEFT JOIN orders ON month(o_orderdate) = m GROUP BY m",
)
def s15(spark, sf_dir):
    """A table of constants, the months' lengths, joined with the orders of each month."""
    counts = read(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("orders"))
    return months(spark).join(F.broadcast(counts), "m", "left").select("m", "days", F.coalesce("orders", F.lit(0)).alias("orders"))  # twelve rows


LIBRARY_SQL = "l AS (SELECT lang AS work, count(DISTINCT source) AS total, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang)"


@query("s21_residency", f"WITH {LIBRARY_SQL}, h AS (SELECT lang AS work, count(DISTINCT source) AS have FROM documents WHERE lang <> 'de' GROUP BY lang) SELECT work, coalesce(have, 0) AS have, total, bytes, coalesce(have, 0) >= total AS whole, have IS NOT NULL AS held FROM l LEFT JOIN h USING (work)")
def s21(spark, sf_dir):
    library = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("work")).agg(F.count_distinct("source").alias("total"), F.sum(F.octet_length("text")).alias("bytes"))
    kept = own_store(spark, sf_dir)
    kept.forget("de")
    return residency(kept, library).withColumn("held", F.col("held_bytes") > 0).drop("held_bytes")


@query("s22_save_whole_work", "SELECT source AS part, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE lang = 'es' GROUP BY source")
def s22(spark, sf_dir):
    kept = store(spark, sf_dir)
    rows, _ = kept.load_many(kept.present().where("work = 'es'"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("s16_lazy_dimension", "SELECT r_name, n_name, 'nation,region' AS held_after FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, 'region' FROM region")
def s16(spark, sf_dir):
    """Regions alone and regions with their nations; Spark reads a dimension when a plan needs it, and each plan tells which ones it reads."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    alone = region.select("r_name", F.lit(None).cast("string").alias("n_name"))
    return both.withColumn("held_after", F.lit(",".join(tables_read(both)))).unionByName(alone.withColumn("held_after", F.lit(",".join(tables_read(alone)))))


@query("p18_work_of_plan", "WITH m(plan, work) AS (VALUES ('bible', 'en'), ('hymns', 'fr'), ('lost', 'xx')) SELECT plan, work, work IN (SELECT lang FROM documents) AS ready FROM m")
def p18(spark, sf_dir):
    plans = spark.createDataFrame([("bible", "en"), ("hymns", "fr"), ("lost", "xx")], "plan string, work string")
    works = read(spark, sf_dir, "documents").select(F.col("lang").alias("work"), F.lit(True).alias("_there")).distinct()
    return plans.join(works, "work", "left").select("plan", "work", F.col("_there").isNotNull().alias("ready"))
