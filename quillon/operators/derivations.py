"""Derivations top-down: a graph of steps as the trees that a reader walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.tables import discard, durable


def top_down(edges: DataFrame, tops: DataFrame | None = None, max_depth: int | None = 8) -> DataFrame:
    """edges(doc, src, dst, ord): src builds on dst, its ord-th; tops(doc, node, ord) or, without them, the nodes on which none builds.
    -> (doc, path, parent, node, depth, ref), a row for each place in the trees; path orders them as they are walked.

    A step that is met again is a reference and not expanded there, and nothing is below max_depth. The first place of a step is
    the least of its paths in dictionary order, and the steps above it are at their first places there. So these are found in rounds, from
    what the last round holds, until one changes nothing: a row for each step, however many paths lead to it. A cycle is an error.
    """
    e = durable(edges.select("doc", "src", "dst", F.col("ord").cast("int").alias("ord")))
    if tops is None:
        free = e.select("doc", F.col("src").alias("node")).distinct().join(e.select("doc", F.col("dst").alias("node")), ["doc", "node"], "left_anti")
        tops = free.select("doc", "node", F.col("node").alias("ord"))
    start = durable(tops.select("doc", "node", F.array(F.struct(F.col("ord").cast("long").alias("o"), F.col("node").cast("string").alias("n"))).alias("path")))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("doc", "node", "path").cast("decimal(38,0)"))).first()
    now, seen, rounds, most = start, mark(start), 0, e.select("doc", "src").distinct().count() + 1
    while True:
        open_ = now if max_depth is None else now.where(F.size("path") <= max_depth)
        step = F.struct(F.col("ord").cast("long").alias("o"), F.col("dst").cast("string").alias("n"))
        below = e.join(open_.withColumnRenamed("node", "src"), ["doc", "src"]).select("doc", F.col("dst").alias("node"), F.concat("path", F.array(step)).alias("path"))
        last, now = now, durable(start.unionByName(below).groupBy("doc", "node").agg(F.min("path").alias("path")))
        if last is not start:
            discard(last)
        marked = mark(now)
        if marked == seen:
            break
        seen, rounds = marked, rounds + 1
        if rounds > most:
            raise ValueError("the graph has a cycle")
    open_ = now if max_depth is None else now.where(F.size("path") <= max_depth)
    step = F.struct(F.col("ord").cast("long").alias("o"), F.col("dst").cast("string").alias("n"))
    below = e.join(open_.withColumnRenamed("node", "src"), ["doc", "src"]).select("doc", F.col("src").alias("parent"), F.col("dst").alias("node"), F.concat("path", F.array(step)).alias("path"))
    places = below.unionByName(start, allowMissingColumns=True)
    rows = places.join(now.withColumnRenamed("path", "first"), ["doc", "node"])
    return rows.select("doc", F.transform("path", lambda x: x["o"]).alias("path"), "parent", "node", (F.size("path") - 1).alias("depth"), (F.col("path") != F.col("first")).alias("ref"))
