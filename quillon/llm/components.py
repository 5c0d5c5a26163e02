"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is two shuffles over the edges; each round's edges are written to the shared folder, so lineage
stays short and nothing about the graph reaches the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its strictly larger neighbours to the least node of its neighbourhood, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or is only the end of such edges: then the graph is its components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, component): component is the least node reachable.

    Only nodes with an edge to another node appear. Null ends and self-loops are dropped. An empty table gives an
    empty table. Converges in O(log n) rounds; not converging within max_rounds is an error, never a partial result.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        last, now = now, materialize(_small_star(_large_star(now)).distinct(), "edges")
        discard(last)
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
