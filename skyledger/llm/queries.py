"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL.

Repeated rows, ties, long texts, empty tables and other columns: as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.bitsliced import top_k
from skyledger.llm.bpe import encode_documents
from skyledger.llm.exact_dedup import exact_groups
from skyledger.llm.langid import identify
from skyledger.llm.negatives import hard_negatives
from skyledger.llm.ngramjoin import ngram_links
from skyledger.llm.packing import pack
from skyledger.llm.resampling import resample
from skyledger.llm.shared import held_out, scratch_path, staged, table
from skyledger.llm.sharding import shard_documents
from skyledger.llm.simhash import simhash_groups
from skyledger.llm.token_files import read_token_files, write_token_files
from skyledger.llm.toxicity import toxicity
from skyledger.llm.urlfilter import judge_urls
from skyledger.llm.vocabularies import vocabulary


def op1_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the byte vocabulary and decoded again. Null and empty texts have no ids; the operator says what else holds."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's shard of sixteen and its place there, by law `bytes`. Null texts are empty; an empty table gives no rows."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op4_merge_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the row of an equal text that stays, that of the largest id. Null texts are empty."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op7_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with an end id in plane files, in order of the document ids, and what the files say of each document."""
    written = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), scratch_path(spark, "token-files"), end_id=2)
    return read_token_files(staged(written, "token-manifest"), keep_ids=False)


def op8_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components that links of two bits or fewer make. Texts without words have fingerprint zero."""
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=2)


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learnt from label rows that are not held out. Null and empty texts are scored like a text without words."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")), threshold=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learnt from rows that are not held out. Null texts and those without a letter are `und`."""
    found = identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of permitted lengths, told piece by piece. Null and empty texts are their end id.

    The workers have the executor's memory for themselves, so they keep more words than the operator does by itself.
    """
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False, cached_words=1_600_000)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the rules below or the character models. Null addresses have neither host nor path."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector. Vectors that are null or not finite take no part."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of four-word shingles, and the component that links at a Jaccard similarity of 0.85 or more make. Blank texts link with nothing."""
    return ngram_links(table(spark, sf_dir, "documents"), words=4, percent=85)


#: Equal sets are one class; classes that share a shingle are compared, and the smallest id walks along the links until nothing changes.
OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END)) AS g FROM w),
c AS (SELECT row_number() OVER () AS k, g, len(g) AS n, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT k, n, unnest(g) AS x FROM c),
pairs AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(k, other) AS (SELECT k, k FROM c UNION SELECT reached.k, links.b FROM reached JOIN links ON links.a = reached.other),
roots AS (SELECT reached.k, min(o.least) AS component_id FROM reached JOIN c o ON o.k = reached.other GROUP BY reached.k)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN roots USING (k)
"""


def op12_dense_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives within 80 to 100 per cent of each of five positives, for every hundredth vector; every seventh row's label goes up by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


def op13_tournament_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with twenty words or more, drawn towards the benchmark's word pairs; rank is null for the others."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS wanted, c.vec_id, c.label, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON len(a.x) = len(c.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
      FROM s WHERE vec_id <> anchor_id AND label = wanted QUALIFY place <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE s.label <> s.wanted AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: crc32 is worked out from its polynomial: first the table of 256 bytes, then byte by byte.
OP13_SQL = r"""
WITH RECURSIVE t(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
w AS (SELECT *, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM texts),
f AS (SELECT r, own, unnest(ws) AS f FROM w
      UNION ALL SELECT r, own, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
counted AS (SELECT r, own, f, count(*) AS n FROM f GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(1, CAST(octet_length(encode(f)) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i - 1, 2) AS BIGINT)) AS b
          FROM (SELECT DISTINCT f FROM counted)),
hashed AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bytes, crc),
c AS (SELECT r, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
met AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM c GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM met) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM met) + 10000) AS DOUBLE))) AS BIGINT) AS gain
         FROM met),
d AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM c JOIN gain USING (bucket) WHERE own GROUP BY r),
h AS (SELECT r, doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        CAST('0x' || left(sha256(concat('7:', doc_id)), 8) AS BIGINT) AS h
      FROM w LEFT JOIN d USING (r) WHERE own),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merge_automaton": op1_merge_automaton,
        "op2_variable_best_fit": op2_variable_best_fit,
        "op3_virtual_slots": op3_virtual_slots,
        "op4_merge_index_dedup": op4_merge_index_dedup,
        "op5_subword_toxicity": op5_subword_toxicity,
        "op6_url_language_model": op6_url_language_model,
        "op7_plane_files": op7_plane_files,
        "op8_simhash_blocks": op8_simhash_blocks,
        "op9_segmentation_langid": op9_segmentation_langid,
        "op10_bit_sliced_top_k": op10_bit_sliced_top_k,
        "op11_fragment_join": op11_fragment_join,
        "op12_dense_negatives": op12_dense_negatives,
        "op13_tournament_resampling": op13_tournament_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_merge_index_dedup": OP4_SQL, "op10_bit_sliced_top_k": OP10_SQL, "op11_fragment_join": OP11_SQL, "op12_dense_negatives": OP12_SQL, "op13_tournament_resampling": OP13_SQL}
