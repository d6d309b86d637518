"""Folded search over documents, benchmark items, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.text import FOLDED
from skyledger.operators import search
from skyledger.operators.gramindex import GramIndex
from skyledger.registry import query
from skyledger.sources.parts import PartStore
from skyledger.sources.tables import read, scratch

TERM = "onth"


def sources(spark, sf_dir):
    """The searched corpora in scan order; conversations rank first in results though they are scanned last."""
    docs, bench, talk = (read(spark, sf_dir, n) for n in ("documents", "benchmark", "conversations"))
    return [
        search.source(docs, "document", 2, [F.col("doc_id")], F.col("source"), F.col("text")),
        search.source(bench, "benchmark", 3, [F.col("item_id")], F.col("item_id"), F.col("text")),
        search.source(talk, "conversation", 1, [F.col("conv_id"), F.col("turn")], F.col("role"), F.col("text")),
    ]


HITS_SQL = f"""WITH s AS (
  SELECT 0 AS scan, 'document' AS "group", 2 AS group_rank, doc_id AS o0, CAST(NULL AS BIGINT) AS o1, source AS title, text FROM documents UNION ALL
  SELECT 1, 'benchmark', 3, item_id, NULL, CAST(item_id AS VARCHAR), text FROM benchmark UNION ALL
  SELECT 2, 'conversation', 1, conv_id, turn, role, text FROM conversations),
h AS (SELECT *, {FOLDED.format('text')} AS folded FROM s), f AS (SELECT * FROM h WHERE contains(folded, '{TERM}'))"""

SNIPPET_SQL = f"""(CASE WHEN greatest(0, instr(folded, '{TERM}') - 37) > 0 THEN '…' ELSE '' END) ||
  trim(substr(text, greatest(0, instr(folded, '{TERM}') - 37) + 1, least(length(text), greatest(0, instr(folded, '{TERM}') - 37) + 110) - greatest(0, instr(folded, '{TERM}') - 37)), ' ') ||
  (CASE WHEN greatest(0, instr(folded, '{TERM}') - 37) + 110 < length(text) THEN '…' ELSE '' END)"""


@query("p3_folded_search", HITS_SQL + f""", c AS (SELECT * FROM f ORDER BY scan, o0, o1 LIMIT 240)
  SELECT "group", title, {SNIPPET_SQL} AS snippet FROM c ORDER BY group_rank, scan, o0, o1 LIMIT 60""")
def p3(spark, sf_dir):
    return search.ranked(search.hits(sources(spark, sf_dir), TERM), TERM)


#: Asked of the index: a common run, a rare one, one with an accent and capitals, one that nothing holds, and one too short for it.
ASKED = ["onth", "lanterns", "É LA", "zzyzx", "qu"]
_asked_sql = " UNION ALL ".join(f"SELECT '{q}' AS asked, doc_id FROM f WHERE contains(folded, '{q.lower().replace('é', 'e')}')" for q in ASKED)


@query("p3_indexed_search", f"WITH f AS (SELECT doc_id, {FOLDED.format('text')} AS folded FROM documents) {_asked_sql}")
def p3_indexed(spark, sf_dir):
    """All documents that hold each of the runs, by an index of trigrams over the parts; French parts come later, and one is added again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("work"), F.col("source").alias("part"))
    store, index = PartStore(spark, scratch(spark, "searched-parts")), GramIndex(spark, scratch(spark, "grams"))
    store.register(docs)
    rows = store.table().select("work", "part", F.col("doc_id").alias("id"), "text")
    for number, part in enumerate(("work IS NULL OR work <> 'fr'", "work = 'fr'", "work = 'en' AND part = 'src1'")):
        index.add(rows.where(part), number)
    found = [index.search(store, q, "doc_id").select(F.lit(q).alias("asked"), "doc_id") for q in ASKED]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


@query("p3_short_query", HITS_SQL.replace(f"'{TERM}'", "'o'") + """ SELECT "group", title FROM f WHERE false""")
def p3_short(spark, sf_dir):
    return search.hits(sources(spark, sf_dir), "o").select("group", "title")


@query("u3_union_of_sources", HITS_SQL + """ SELECT "group", count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM s GROUP BY "group" """)
def u3(spark, sf_dir):
    every = sources(spark, sf_dir)
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("o3_capped_group_rank", HITS_SQL + """, c AS (SELECT * FROM f ORDER BY scan, o0, o1 LIMIT 240), r AS (SELECT * FROM c ORDER BY group_rank, scan, o0, o1 LIMIT 60)
  SELECT "group", count(*) AS kept FROM r GROUP BY "group" """)
def o3(spark, sf_dir):
    return search.ranked(search.hits(sources(spark, sf_dir), TERM), TERM).groupBy("group").agg(F.count("*").alias("kept"))


@query("a1_group_counts", HITS_SQL + """ SELECT "group", count(*) AS hits FROM f GROUP BY "group" UNION ALL SELECT 'total', count(*) FROM f""")
def a1(spark, sf_dir):
    return search.counts(search.hits(sources(spark, sf_dir), TERM))


@query(
    "p11_search_scope",
    """SELECT string_agg(DISTINCT lang, ', ' ORDER BY lang) AS loaded, (SELECT string_agg(DISTINCT lang, ', ' ORDER BY lang) FROM documents) AS every FROM documents WHERE source IN ('src1', 'src2')""",
)
def p11(spark, sf_dir):
    """Works with at least one loaded part, and all works."""
    parts = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    loaded = parts.where(F.col("source").isin("src1", "src2")).select("lang").distinct().withColumn("is_loaded", F.lit(True))
    joined = parts.select("lang").distinct().join(loaded, "lang", "left")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")
    return joined.agg(names(F.when(F.col("is_loaded"), F.col("lang"))).alias("loaded"), names(F.col("lang")).alias("every"))
