"""The registered queries run on the small tables; those with SQL equal it."""

import os

import pytest

pytest.importorskip("public_tokenizers")

from quillon.llm import queries  # noqa: E402

COLUMNS = {
    "op1_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op2_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op3_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op4_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op5_token_counts": {"doc_id", "n_tokens"},
    "op6_html_extract": {"page_id", "url", "text", "n_chars"},
    "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_mixing": {"doc_id", "tokens", "p", "rate"},
    "op10_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op11_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op12_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}
TABLE = {"op3_url_filter": "pages", "op6_html_extract": "pages", "op7_warc": "pages", "op10_embedding_dedup": "embeddings"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_row(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert COLUMNS[name] <= set(df.columns)
    if name == "op13_prefix_trie":  # a row for each node; test_prefix_trie.py has them all
        assert rows
        return
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = pytest.importorskip("duckdb").connect()
        con.execute(f"create view pages as select * from '{os.path.join(sf_dir, 'pages.parquet')}'")
        res = con.execute(queries.ORACLE_SQL[name])
        order = [d[0] for d in res.description]
        assert sorted(tuple(r[c] for c in order) for r in rows) == sorted(res.fetchall())
