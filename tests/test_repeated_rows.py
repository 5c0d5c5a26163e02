"""Queries over tables with rows that repeat, nulls and odd texts, compared with their SQL."""

import pytest

from quillon.plans import registry


def differs(spark, tmp_path, name, table, schema, rows):
    """Rows of the query that its SQL lacks, and the other way round, each with its count."""
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = Counter(map(tuple, df.collect()))
    want = Counter(con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall())
    assert want
    return got - want, want - got


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double"


def test_outermost_blocks_of_equal_rows(spark, tmp_path):
    rows = [(1, 1, 10, 5.0)] * 2 + [(1, 2, 10, 5.0), (1, 3, 12, 1.0), (1, 4, 30, 2.0), (1, 4, 30, 2.0), (1, 4, 30, 4.0), (1, None, 30, 4.0)]
    rows += [(2, 7, 5, 1.5), (2, 6, 5, 1.0), (2, 5, 5, 1.4), (3, 1, 1, None), (3, 2, 1, 9.0), (3, 3, None, 2.0), (3, 3, None, 2.0), (None, 1, 4, 1.0), (None, 1, 4, 1.0), (None, 2, 4, 1.0)]
    assert differs(spark, tmp_path, "outermost_blocks", "lineitem", LINES, rows) == ({}, {})


TEXTS = [None, "", "  \nblank first", " " * 25 + "late\nx", " a line that is longer than twenty ", "Short\nline\nShort", "one\none\nabc", "<html><p>a page</p>", " <!DOCTYPE html>x", "%PDF-1.5 x", "\n\nb", "ab\r\nc", "a한\U0001d400 twenty characters here "]
DOCUMENTS = [(i, x) for i in range(5) for x in TEXTS] + [(i, "the same") for i in (1, 2, 3, 4, 5)] * 2 + [(None, "no id"), (None, None), (None, "no id")]


def test_mapped_ranges_of_odd_documents(spark, tmp_path):
    assert differs(spark, tmp_path, "mapped_ranges", "documents", "doc_id long, text string", DOCUMENTS) == ({}, {})


def test_prepared_packages_of_odd_documents(spark, tmp_path):
    assert differs(spark, tmp_path, "prepared_packages", "documents", "doc_id long, text string", DOCUMENTS) == ({}, {})
