"""Nested shapes built from conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import nested, records
from skyledger.registry import query
from skyledger.sources.tables import read


def lines_of(spark, sf_dir):
    """documents as chapters (lines) of verses (words): doc_id, ch."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return read(spark, sf_dir, "documents").select("doc_id", lines.alias("ch"))


@query("e1_chapters_of_verses", "WITH c AS (SELECT doc_id, i AS chapter, string_split(string_split(text, chr(10))[i], ' ') AS w FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)) SELECT doc_id, CAST(chapter AS INTEGER) AS chapter, CAST(j AS INTEGER) AS verse, w[j] AS text FROM c, unnest(range(1, len(w) + 1)) u(j)")
def e1(spark, sf_dir):
    return nested.chapters_of_verses(lines_of(spark, sf_dir), ["doc_id"], "ch")


TALK_SQL = "t AS (SELECT conv_id, role, list(text ORDER BY turn) FILTER (role <> 'system') AS v FROM conversations GROUP BY conv_id, role)"


def talk(spark, sf_dir):
    """Hymns: one per role, with its texts; some have none."""
    texts = F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "text"))))
    by_role = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.transform(texts, lambda x: x["text"]).alias("v"))
    return by_role.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("h"), "v")).alias("hymns"))


@query("e2_hymns", f"WITH {TALK_SQL} SELECT conv_id, role AS hymn, CAST(CASE WHEN v IS NOT NULL THEN i END AS INTEGER) AS verse, v[i] AS text FROM t, unnest(range(1, greatest(coalesce(len(v), 0), 1) + 1)) u(i)")
def e2(spark, sf_dir):
    return nested.hymns(talk(spark, sf_dir), ["conv_id"], "hymns")


@query("e3_numbered_verses", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ayah, text FROM conversations")
def e3(spark, sf_dir):
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    surahs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("v"))
    return surahs.select("conv_id", F.posexplode("v").alias("i", "text")).select("conv_id", (F.col("i") + 1).alias("ayah"), "text")


@query("e4_labelled_pairs", "SELECT conv_id, CASE WHEN turn % 4 = 1 THEN turn || '–' || (turn + 1) ELSE CAST(turn AS VARCHAR) END AS label, text FROM conversations")
def e4(spark, sf_dir):
    label = F.when(F.col("turn") % 4 == 1, F.concat_ws("–", F.col("turn"), F.col("turn") + 1)).otherwise(F.col("turn").cast("string"))
    pairs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.array(label, F.col("text"))).alias("v"))
    return nested.labelled(pairs, ["conv_id"], "v")


@query("e5_blocks_of_lines", "SELECT doc_id, CAST(i AS INTEGER) AS n, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)")
def e5(spark, sf_dir):
    chapters = F.transform(F.col("ch"), lambda words, i: F.struct((i + 1).alias("n"), F.array(words).alias("b")))
    return nested.blocks(lines_of(spark, sf_dir).select("doc_id", chapters.alias("c")), ["doc_id"], "c")


@query("e6_sections", "SELECT doc_id, CAST(1 AS INTEGER) AS n, replace(text, chr(10), ' ') AS text FROM documents")
def e6(spark, sf_dir):
    sections = F.array(F.struct(F.lit(1).alias("n"), F.col("ch").alias("b")))
    return nested.blocks(lines_of(spark, sf_dir).select("doc_id", sections.alias("c")), ["doc_id"], "c")


@query("a7_first_appearance", "WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) SELECT d.doc_id, d.source, f.first, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS nth, dense_rank() OVER (ORDER BY f.first) AS nth_group FROM documents d JOIN f ON d.source IS NOT DISTINCT FROM f.source")
def a7(spark, sf_dir):
    """Groups in the order of their first rows, rows in their own order within."""
    return records.first_appearance(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "first", "nth", "nth_group")


@query("a8_consecutive_runs", "WITH m AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'look' ELSE event_type END AS kind FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, kind, count(*) AS n, min(event_id) AS start FROM r GROUP BY ALL")
def a8(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "look").otherwise(F.col("event_type"))
    return records.runs(read(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


PHASES = [("in", 4.0), ("hold", 7.0), ("out", 8.0)]


@query("a12_ordered_sum", "SELECT n_nationkey, CAST(n_nationkey * 3 + 19 AS DOUBLE) AS seconds FROM nation")
def a12(spark, sf_dir):
    """Total of a pattern's phases, a fold over an array of structs."""
    phases = F.array(*(F.struct(F.lit(n).alias("n"), (F.lit(s) + F.col("n_nationkey")).alias("s")) for n, s in PHASES))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.aggregate(phases, F.lit(0.0), lambda acc, p: acc + p["s"]).alias("seconds"))


@query("w11_timeline_position", "WITH x AS (SELECT event_id, value, value % 19 AS t FROM events) SELECT event_id, CAST(floor(value / 19) AS BIGINT) AS cycle, CASE WHEN t < 4 THEN 'in' WHEN t < 11 THEN 'hold' ELSE 'out' END AS phase, round(CASE WHEN t < 4 THEN 4 WHEN t < 11 THEN 11 ELSE 19 END - t, 6) AS seconds_left FROM x")
def w11(spark, sf_dir):
    cycle, name, left = nested.timeline_position(F.col("value"), [n for n, _ in PHASES], [s for _, s in PHASES])
    return read(spark, sf_dir, "events").select("event_id", cycle.alias("cycle"), name.alias("phase"), F.round(left, 6).alias("seconds_left"))


@query("f48_array_slices", "SELECT conv_id, CAST(sum(turn) AS BIGINT) AS total, array_to_string(list_slice(list(turn ORDER BY turn), 2, 4), ',') AS middle FROM conversations GROUP BY conv_id")
def f48(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return turns.select("conv_id", total.alias("total"), F.array_join(F.slice("t", 2, 3).cast("array<string>"), ",").alias("middle"))


@query("f49_index_or_default", "SELECT doc_id, coalesce(string_split(text, ' ')[4], '-') AS fourth FROM documents")
def f49(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(F.split("text", " "), F.lit(3)), F.lit("-")).alias("fourth"))


@query(
    "o7_spread_angles",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, CAST(max(event_id) * 137 % 360 AS DOUBLE) AS x FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x, event_type) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
    s AS (SELECT user_id, any_value(n) AS n, list(x ORDER BY i) AS p, 0 AS step FROM r GROUP BY user_id
      UNION ALL SELECT user_id, n, list_transform(range(1, n + 1), lambda i: p[i] - CASE WHEN i = step % n + 1 THEN push ELSE 0 END + CASE WHEN i = (step + 1) % n + 1 THEN push ELSE 0 END), step + 1
        FROM (SELECT *, CASE WHEN gap < 7 THEN (7 - gap) / 4 ELSE 0 END AS push FROM (SELECT *, p[(step + 1) % n + 1] - p[step % n + 1] + CASE WHEN (step + 1) % n = 0 THEN 360 ELSE 0 END AS gap FROM s WHERE n > 1 AND step < 40 * n)))
    SELECT r.user_id, event_type, x, round(s.p[i], 6) AS shown FROM r JOIN s ON r.user_id = s.user_id AND step = CASE WHEN r.n > 1 THEN 40 * r.n ELSE 0 END""",
)
def o7(spark, sf_dir):
    """Display angles of each user's points (the last event of each type) pushed apart, told beside the angles that they came from."""
    points = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.max("event_id") * 137 % 360).cast("double").alias("x"))
    wheel = points.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "x"))).alias("p"))  # one row per event type
    shown = wheel.withColumn("y", nested.spread_angles(F.col("p.x")))
    return shown.select("user_id", F.explode(F.arrays_zip("p", "y")).alias("z")).select("user_id", "z.p.event_type", "z.p.x", F.round("z.y", 6).alias("shown"))
