"""Every registered query that states its result in SQL is compared with DuckDB on the same Parquet files."""

import math
import os

import pytest

from quillon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    res = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, res.fetchall())


def test_flagship_has_rows(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
