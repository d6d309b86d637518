"""String functions over the driver tables (F1 to F14) and counts of words and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import fold as t
from skyledger.functions import sky
from skyledger.registry import query
from skyledger.sources.tables import read

FOLDED = "replace(replace(strip_accents(lower(coalesce({0}, ''))), '’', ''''), '‘', '''')"


@query("f1_fold", f"SELECT doc_id, {FOLDED.format('text')} AS folded FROM documents")
def f1(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.fold(F.col("text")).alias("folded"))


@query(
    "f2_snippet",
    f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, CAST(instr({FOLDED.format('text')}, 'reth') AS INTEGER) - 1 AS pos FROM documents),
    y AS (SELECT *, greatest(0, pos - 36) AS s, least(length(text), greatest(0, pos - 36) + 110) AS e FROM x WHERE pos >= 0)
    SELECT doc_id, (CASE WHEN s > 0 THEN '…' ELSE '' END) || trim(substr(text, s + 1, e - s), ' ') || (CASE WHEN e < length(text) THEN '…' ELSE '' END) AS snippet FROM y""",
)
def f2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.where(t.contains_folded(F.col("text"), "reth")).select("doc_id", t.snippet(F.col("text"), "reth").alias("snippet"))


@query(
    "f3_highlight",
    f"""WITH x AS (SELECT item_id, text, CAST(instr({FOLDED.format('text')}, 'the') AS INTEGER) AS pos FROM benchmark)
    SELECT item_id, CASE WHEN pos > 0 THEN substr(text, 1, pos - 1) || '<mark>' || substr(text, pos, 3) || '</mark>' || substr(text, pos + 3) ELSE text END AS marked FROM x""",
)
def f3(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", t.highlight(F.col("text"), "the").alias("marked"))


@query(
    "f4_escape_html",
    """SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
)
def f4(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.escape_html(F.col("html")).alias("escaped"))


@query("f5_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def f5(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.strip_tags(F.col("html")).alias("plain"))


@query(
    "f6_byte_size",
    """WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * 20) AS BIGINT) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB'
      ELSE CAST(CAST(floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR) || ' MB' END AS size FROM x""",
)
def f6(spark, sf_dir):
    n = F.floor(F.col("o_totalprice") * 20)
    return read(spark, sf_dir, "orders").select("o_orderkey", t.byte_size(n).alias("size"))


REFS_SQL = """WITH r AS (SELECT event_id, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'day:' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'examen:' || strftime(ts, '%Y-%m-%d') || ':well'
  WHEN 2 THEN 'voice:' || event_type || ':' || month(ts) || '-' || day(ts) WHEN 3 THEN 'passage:' || event_type || ':' || day(ts) ELSE 'note' END AS ref FROM events)"""


def _refs(spark, sf_dir):
    """References of all kinds from the events table."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_id") % 5
    ref = (
        F.when(kind == 0, t.build_reference("day", day)).when(kind == 1, t.build_reference("examen", day, F.lit("well")))
        .when(kind == 2, t.build_reference("voice", F.col("event_type"), F.concat_ws("-", F.month("ts"), F.dayofmonth("ts"))))
        .when(kind == 3, t.build_reference("passage", F.col("event_type"), F.dayofmonth("ts"))).otherwise("note")
    )
    return read(spark, sf_dir, "events").select("event_id", ref.alias("ref"))


@query(
    "f7_reference_label",
    REFS_SQL + """ SELECT event_id, ref, CASE split_part(ref, ':', 1)
      WHEN 'day' THEN 'Morning, ' || strftime(CAST(split_part(ref, ':', 2) AS DATE), '%A, %B %-d, %Y')
      WHEN 'examen' THEN 'Evening, ' || strftime(CAST(split_part(ref, ':', 2) AS DATE), '%A, %B %-d, %Y')
      WHEN 'voice' THEN 'Voice of ' || strftime(make_date(2000, CAST(split_part(split_part(ref, ':', 3), '-', 1) AS INTEGER), 1), '%B') || ' ' || split_part(split_part(ref, ':', 3), '-', 2)
      WHEN 'passage' THEN 'Passage: ' || split_part(ref, ':', 2) || ', ' || split_part(ref, ':', 3) ELSE 'Some note' END AS label,
      CASE split_part(ref, ':', 1) WHEN 'passage' THEN '/plans/' || split_part(ref, ':', 2) WHEN 'voice' THEN '/kept' ELSE '/day' END AS link FROM r""",
)
def f7(spark, sf_dir):
    return _refs(spark, sf_dir).select("event_id", "ref", t.reference_label(F.col("ref")).alias("label"), t.reference_link(F.col("ref")).alias("link"))


@query("f8_reference_build", REFS_SQL + " SELECT event_id, ref FROM r")
def f8(spark, sf_dir):
    return _refs(spark, sf_dir)


@query("f9_zero_pad", "SELECT o_orderkey, year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS day_key FROM orders")
def f9(spark, sf_dir):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.concat_ws("-", F.year("o_orderdate"), pad(F.month("o_orderdate")), pad(F.dayofmonth("o_orderdate")))
    return read(spark, sf_dir, "orders").select("o_orderkey", key.alias("day_key"))


SIGN_LIST = "[" + ", ".join(f"'{s}'" for s in sky.SIGNS) + "]"


@query(
    "f10_longitude_label",
    f"""WITH x AS (SELECT o_orderkey, (floor(o_totalprice * 16) / 16) % 360 AS lon FROM orders), y AS (SELECT o_orderkey, CAST(floor(lon / 30) AS INTEGER) AS s, lon - floor(lon / 30) * 30 AS w FROM x)
    SELECT o_orderkey, CAST(floor(w) AS INTEGER) || '° ' || {SIGN_LIST}[s + 1] || ' ' || lpad(CAST(CAST(floor((w - floor(w)) * 60) AS INTEGER) AS VARCHAR), 2, '0') || '′' AS label FROM y""",
)
def f10(spark, sf_dir):
    lon = F.floor(F.col("o_totalprice") * 16) / 16
    return read(spark, sf_dir, "orders").select("o_orderkey", sky.longitude_label(lon).alias("label"))


@query(
    "f11_number_word",
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 12 THEN [" + ", ".join(f"'{w}'" for w in t.NUMBER_WORDS) + "][p_size + 1] ELSE CAST(p_size AS VARCHAR) END AS size_word FROM part",
)
def f11(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.number_word(F.col("p_size")).alias("size_word"))


@query("f12_truncate", "SELECT doc_id, CASE WHEN length(text) > 190 THEN substr(text, 1, 190) || '…' ELSE text END AS short FROM documents")
def f12(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.truncated(F.col("text")).alias("short"))


@query("f13_blank", "SELECT conv_id, turn, NOT regexp_matches(coalesce(text, ''), '\\S') AS blank FROM conversations")
def f13(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.is_blank(F.col("text")).alias("blank"))


@query(
    "f14_list_label",
    """WITH m AS (SELECT DISTINCT c_nationkey AS k, month(o_orderdate) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT k, string_agg(strftime(make_date(2000, CAST(m AS INTEGER), 1), '%B') || CASE WHEN n < 10 THEN ' (' || n || ' of 10)' ELSE '' END, ' · ' ORDER BY m) || ' — of twelve' AS label FROM m GROUP BY k""",
)
def f14(spark, sf_dir):
    by_month = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), F.month("o_orderdate").alias("m")).count()
    named = F.transform(F.array_sort(F.collect_list(F.struct("m", "count"))), lambda x: F.concat(F.date_format(F.make_date(F.lit(2000), x["m"], F.lit(1)), "MMMM"), F.when(x["count"] < 10, F.concat(F.lit(" ("), x["count"].cast("string"), F.lit(" of 10)"))).otherwise("")))
    return by_month.groupBy("k").agg(F.concat(F.array_join(named, " · "), F.lit(" — of twelve")).alias("label"))


@query("a2_entry_count", "SELECT role, count(*) AS entries FROM conversations GROUP BY role")
def a2(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("entries"))


@query("a3_word_count", "SELECT role, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS BIGINT) AS words FROM conversations GROUP BY role")
def a3(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(t.word_count(F.col("text"))).alias("words"))


@query(
    "a10_verse_or_prose",
    """WITH b AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS l FROM documents)
    SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, round(list_sum(l) / len(l), 6) AS mean_length, len(l) > 1 AND list_sum(l) / len(l) < 62 AS verse FROM b""",
)
def a10(spark, sf_dir):
    """Lines and their mean length of every text; a null one is an empty line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    mean = t.mean_line_length(lines)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("lines"), F.round(mean, 6).alias("mean_length"), ((F.size(lines) > 1) & (mean < 62)).alias("verse"))


@query("a15_string_aggregate", "SELECT n_regionkey, string_agg(n_name, ' · ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a15(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " · ").alias("names"))


@query("o4_prefix_first", """WITH f AS (SELECT c_custkey, lower(c_name) AS n FROM customer WHERE contains(lower(c_name), '#0000000'))
    SELECT c_custkey, starts_with(n, 'customer#00000001') AS prefix FROM f ORDER BY prefix DESC, c_custkey LIMIT 8""")
def o4(spark, sf_dir):
    from skyledger.operators.search import prefix_first

    found = prefix_first(read(spark, sf_dir, "customer"), "c_name", "customer#00000001", "#0000000", "c_custkey", 8)
    return found.select("c_custkey", "prefix")
