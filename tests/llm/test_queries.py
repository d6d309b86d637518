"""The registered queries: columns and rows as agreed, and DuckDB's rows where there is SQL."""

import os

import pytest

from skyledger.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_merge_automaton": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_virtual_slots": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_merge_index_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_subword_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_url_language_model": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_plane_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_simhash_blocks": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_segmentation_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_bit_sliced_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11_fragment_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op12_dense_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_tournament_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, DATA)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    if name == "op12_dense_negatives":  # as many rows as windows hold, which the SQL tells
        return
    source = {"op6_url_language_model": "pages", "op10_bit_sliced_top_k": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{DATA}/{source}.parquet")
    want = rows.where("vec_id % 50 = 0").count() * 5 if source == "embeddings" else rows.count()
    assert got.count() == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    mine = queries.queries()[name](spark, DATA).toArrow()
    theirs = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    assert sorted(map(repr, mine.select(columns).to_pylist())) == sorted(map(repr, theirs.select(columns).to_pylist()))


def test_held_out_rows_are_told_apart(spark):
    """Languages and toxic texts of rows that no model has learnt from."""
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = queries.op5_subword_toxicity(spark, big).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    ranks = scored["score"].rank()
    toxic = scored["toxic"] == 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    assert n1 >= 5 and (ranks[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.8  # 38 toxic texts to learn from


def test_url_parts_and_rules_are_those_of_sql(spark):
    """Host, path, rule and a rule's verdict of every page, against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in queries.URL_RULES)
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    rows = con.execute(f"""
        WITH rules(verdict, h, p) AS (VALUES {values}),
        r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL""").fetchall()
    got = queries.op6_url_language_model(spark, "/root/testdata/sf0.01").collect()
    want = {r[0]: r[1:] for r in rows}
    assert len(got) == len(want) and all((r.host, r.path, r.rule) == want[r.page_id][:3] and want[r.page_id][3] in (None, r.verdict) for r in got)
    assert sum(r.rule is not None for r in got) > 0
