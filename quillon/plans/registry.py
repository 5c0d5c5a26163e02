"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function(tables) under its name; `tables` reads a table of the data folder by name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spelled(name: str, doc: str, pairs: list[tuple[str | None, str | None]], f) -> None:
    """Register a query that applies a string function to every part: each spells one of the inputs of `pairs` with its key for
    {k}, and SQL states what comes out of it. So all branches of a function run over the whole table."""

    def run(t):
        k = F.col("p_partkey")
        given = F.get(F.array(*[F.lit(a) for a, _ in pairs]), (k % len(pairs)).cast("int"))
        text = F.replace(given, F.lit("{k}"), k.cast("string"))
        return t("part").select("p_partkey", text.alias("given")).select("p_partkey", f(F.col("given")).cast("string").alias("out"))

    run.__name__, run.__doc__ = name, doc
    quoted = ", ".join("null" if b is None else "'" + b.replace("'", "''") + "'" for _, b in pairs)
    query(f"select p_partkey, replace(list_extract([{quoted}], p_partkey % {len(pairs)} + 1), '{{k}}', cast(p_partkey as varchar)) as out from part")(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of the mathematics in documents synthesised from orders: blocks by kind and delimiter."""
    return QUERIES["block_inventory"](spark, sf_dir)


from quillon.plans import document_queries, relational_queries  # noqa: E402,F401
