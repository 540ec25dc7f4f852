"""Every registered text query over the smallest tables: its columns and its rows."""

import os

import duckdb
import pytest

from readroute.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_language": "doc_id held_out lang_pred score",
    "op3_line_dedup": "doc_id n_lines n_removed text_md5",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_decontamination": "doc_id item_id start end edits",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_token_counts": "doc_id n_words n_tokens",
    "op9_ngram_join": "doc_id n_shingles component_id",
    "op10_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_html_difference": "page_id url text n_chars",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_all_are_here():
    assert sorted(queries()) == sorted(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_rows_and_columns(spark, name):
    found = queries()[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    table, key = ("pages", "page_id") if name in ("op4_url_filter", "op13_html_difference") else ("documents", "doc_id")
    ids = [r[0] for r in found.select(key).collect()]
    every = [r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect()]
    if name in ("op5_decontamination", "op11_lexical_search"):
        assert set(ids) <= set(every)
    else:
        assert sorted(ids) == sorted(every)


@pytest.mark.parametrize("name", oracle_sql())
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    found = [tuple(r) for r in queries()[name](spark, DIR).select(*names).collect()]
    assert sorted(found, key=str) == sorted(want.fetchall(), key=str)
