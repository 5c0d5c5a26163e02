"""Near-duplicate embeddings by a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE vectors, least by hash): a node splits at the median of a random
projection, recursively, until the sample share of a leaf stands for about LEAF vectors of the whole table, or no more than
four of the sample. Near the median, a band of SPILL of the vectors goes to both sides. Every vector of the table is then
indexed in every tree. Where the sample cannot tell leaves of LEAF apart (beyond some 80 vectors of the table to one of the
sample), leaves are split further, as many levels as their own counts ask for: a level has one direction a tree, each leaf
has medians of its own, fitted on at most LEAF_SAMPLE of its vectors, and only projections are shuffled for it. Vectors of a leaf are compared: in single precision, and in double where that is too near the threshold
to tell. A split of a tree parts a pair of the threshold with a chance that does not fall with the depth, so trees are
TREES at least and as many as keep the expected recall at RECALL if a level keeps LEVEL of the pairs.

No pair is emitted: a linked pair is counted in the first (tree, leaf) that holds both, which a comparison of the two
vectors' leaf lists tells (made for close pairs only), so a leaf returns one row per member: how many links were counted,
and one member of the part of the leaf its links connect it to, the same for that whole part. Those rows are summed (links)
and joined by connected components (classes).

Equal directions are one representative with a weight, so copies are counted, not compared. A leaf larger than BLOCK
(neither sample could tell its vectors apart) is cut into blocks and every pair of blocks is compared, so no leaf
lands whole in one task and nothing is capped.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Rows with equal vec_id are
separate vectors; a null vec_id keeps its row and takes part, but is never a component's name. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import discard, materialize, sized
from quillon.llm.components import connected_components

TREES = 16
LEAF = 400
SPILL = 0.1
SAMPLE = 20_000
#: Vectors of a leaf that its further splits are fitted on: ten levels, so 1.7e9 vectors in leaves of LEAF.
LEAF_SAMPLE = 4096
BLOCK = 1024
#: Expected share of linked pairs found, and the share of them that one level of a tree keeps together.
RECALL = 0.999
LEVEL = 0.9


class Forest:
    """Per tree, nodes in breadth-first order: direction, lower and upper end of the spill band. Below them, `deeper` levels of one
    direction each, whose bands are fitted leaf by leaf (split_further)."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 11):
        rng = np.random.default_rng(seed)
        wanted = max(0, int(np.ceil(np.log2(max(total, 1) / leaf)))) if len(sample) > 1 else 0
        self.depth = min(wanted, max(0, int(np.log2(max(len(sample), 1) / 4))))
        self.deeper = min(wanted - self.depth, int(np.log2(LEAF_SAMPLE / 4))) if self.depth else 0
        levels = self.depth + self.deeper
        trees = max(trees, int(np.ceil(np.log(1 - RECALL) / np.log(1 - LEVEL**levels)))) if levels else 1
        width = sample.shape[1] if sample.ndim == 2 else 0
        inner = 2**self.depth - 1
        self.direction = rng.standard_normal((trees, inner, width)).astype(np.float32)
        self.low = np.zeros((trees, inner))
        self.high = np.zeros((trees, inner))
        for t in range(trees):
            members = {0: sample}
            for node in range(inner):
                own = members.pop(node)
                p = own @ self.direction[t, node].astype(np.float64)
                self.low[t, node], mid, self.high[t, node] = np.quantile(p, [0.5 - spill / 2, 0.5, 0.5 + spill / 2]) if len(p) else (0.0, 0.0, 0.0)
                members[2 * node + 1], members[2 * node + 2] = own[p <= mid], own[p > mid]
        self.further = rng.standard_normal((trees, self.deeper, width)).astype(np.float32)

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Of each row, its leaves over all trees, ascending; a row in a spill band goes both ways."""
        trees = len(self.direction)
        found: list[list[int]] = [[] for _ in range(len(x))]
        last = 2 ** (self.depth + 1)
        for t in range(trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], self.direction[t, node].astype(np.float64))
                left, right = p <= self.high[t, node], p >= self.low[t, node]
                right |= ~left
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            for r, n in zip(row.tolist(), node.tolist(), strict=True):
                found[r].append(t * last + n)
        return [sorted(f) for f in found]


def _unit(vectors: pd.Series) -> list[np.ndarray | None]:
    """Each vector over its norm in double precision, or None if it links with nothing."""
    out = []
    for v in vectors:
        x = None if v is None else np.array([np.nan if y is None else y for y in v], np.float64)
        norm = 0.0
        if x is not None and len(x) and np.isfinite(x).all():
            top = np.abs(x).max()
            norm = top * np.linalg.norm(x / top) if top else 0.0
        out.append(x / norm if norm and np.isfinite(norm) else None)
    return out


def _met_before(a: list, b: list, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Of the pairs a[i]-b[j] of leaf lists, whether they also share a leaf of a lower number than `leaf`."""
    sides = []
    for fill, lists in ((-1, a), (-2, b)):
        size = np.array([len(x) for x in lists])
        m = np.full((len(lists), max(int(size.max()), 1)), fill, np.int64)
        m[np.arange(m.shape[1]) < size[:, None]] = np.concatenate(lists)
        m[m >= leaf] = fill
        sides.append(m[:, : max(int((m >= 0).sum(1).max()), 1)])
    left, right = sides
    if len(i) < 16 * (len(a) + len(b)):  # few pairs: sort each pair's two lists together
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 20_000):
            both = np.sort(np.concatenate([left[i[k : k + 20_000]], right[j[k : k + 20_000]]], 1), 1)
            out[k : k + 20_000] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).any(1)
        return out
    number = np.unique(np.intersect1d(left[left >= 0], right[right >= 0]))
    on = []
    for m in sides:
        at = np.minimum(np.searchsorted(number, m), max(len(number) - 1, 0))
        row, col = np.nonzero(number[at] == m) if len(number) else (np.zeros(0, int), np.zeros(0, int))
        one = np.zeros((len(m), max(len(number), 1)), np.float32)
        one[row, at[row, col]] = 1
        on.append(one)
    return (on[0] @ on[1].T > 0)[i, j]


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """a @ b.T >= threshold: in single precision, and in double where its rounding could tell otherwise."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    margin = 1e-6 + 2.5e-7 * a.shape[1]
    close = near >= threshold
    i, j = np.nonzero(np.abs(near - threshold) <= margin)
    for k in range(0, len(i), 20_000):
        x, y = i[k : k + 20_000], j[k : k + 20_000]
        close[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return close


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of each of n members, the first member that the links i-j connect it to, over any number of steps."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _stack(col: pd.Series, kind: str) -> np.ndarray:
    """The vectors of a column of bytes, each over its norm, as rows in double precision."""
    x = np.stack([np.frombuffer(v, kind) for v in col]).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _compare(threshold: float, kind: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the group's two blocks (one block with itself, if p = q) that belong to this leaf."""
        p, q, leaf = int(group.p.iloc[0]), int(group.q.iloc[0]), int(group.leaf.iloc[0])
        rows, cols = group[group.block == p], group[group.block == q]
        if not len(rows) or not len(cols):
            return pd.DataFrame({"node": [], "n": [], "root": []}, dtype="int64")
        a = _stack(rows.vector, kind)
        b = a if p == q else _stack(cols.vector, kind)
        node_a, node_b = rows.node.to_numpy(), cols.node.to_numpy()
        close = _close(a, b, threshold)
        if p == q:
            close &= node_b > node_a[:, None]
        i, j = np.nonzero(close)
        if len(i):
            new = ~_met_before(rows.leaves.tolist(), cols.leaves.tolist(), i, j, leaf)
            i, j = i[new], j[new]
        links_a = np.bincount(i, cols.weight.to_numpy()[j], len(node_a)).astype(np.int64)
        links_b = np.bincount(j, rows.weight.to_numpy()[i], len(node_b)).astype(np.int64)
        node = np.concatenate([node_a, node_b])
        # of one block with itself, the columns are the rows
        root = _roots(i, j + len(node_a), len(node)) if p != q else np.tile(_roots(i, j, len(node_a)), 2)
        out = pd.DataFrame({"node": node, "n": np.concatenate([links_a, links_b]), "root": node[root]})
        return out[out.n > 0]

    return run


def _index(forest: Forest, kind: str):
    @F.pandas_udf("array<long>")
    def run(vector: pd.Series) -> pd.Series:
        return pd.Series(forest.leaves(_stack(vector, kind)) if len(vector) else [])

    return run


def _projections(forest: Forest, kind: str):
    last = 2 ** (forest.depth + 1)

    @F.pandas_udf("array<array<float>>")
    def run(vector: pd.Series, leaves: pd.Series) -> pd.Series:
        """Of each leaf of a vector, its projections on the further directions of the leaf's tree."""
        if not len(vector):
            return pd.Series([])
        at = np.einsum("ij,tlj->itl", _stack(vector, kind).astype(np.float32), forest.further, optimize=True)
        return pd.Series([list(at[i, np.asarray(own) // last]) for i, own in enumerate(leaves)])

    return run


def _bands(leaf: int, deeper: int, spill: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Spill bands of one leaf from its sample, nodes in breadth-first order; none if the leaf is small enough."""
        levels = min(deeper, max(0, int(np.ceil(np.log2(group["count"].iloc[0] / leaf)))))
        x = np.stack(group["at"].to_numpy())
        members, low, high = {0: x}, [], []
        for node in range(2**levels - 1):
            own = members.pop(node)
            p = own[:, (node + 1).bit_length() - 1]
            a, mid, b = np.quantile(p, [0.5 - spill / 2, 0.5, 0.5 + spill / 2]) if len(p) else (0.0, 0.0, 0.0)
            low.append(np.float32(a))
            high.append(np.float32(b))
            members[2 * node + 1], members[2 * node + 2] = own[p <= mid], own[p > mid]
        return pd.DataFrame({"leaf": group.leaf.iloc[:1], "low": [low], "high": [high]})

    return run


def split_further(indexed: DataFrame, forest: Forest, kind: str, leaf: int, spill: float = SPILL) -> DataFrame:
    """indexed(node, vector, leaves, ...) with leaves split until they hold about `leaf` vectors. Vectors stay where they are: a
    row of a few projections for each vector and leaf is shuffled, bands are joined to it by leaf."""
    narrow = indexed.select("node", F.explode(F.arrays_zip("leaves", _projections(forest, kind)("vector", "leaves").alias("at"))).alias("x"))
    at = materialize(narrow.select("node", F.col("x.leaves").alias("leaf"), F.col("x.at").alias("at")), "projections")
    first = Window.partitionBy("leaf").orderBy(F.xxhash64("node"), "node")
    sample = at.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= LEAF_SAMPLE).drop("rn")
    counts = materialize(at.groupBy("leaf").count(), "counts")
    sample = sample.join(sized(counts), "leaf").select("leaf", "at", "count")
    bands = materialize(sample.groupBy("leaf").applyInPandas(_bands(leaf, forest.deeper, spill), "leaf long, low array<float>, high array<float>"), "bands")

    def step(nodes, p):
        left = lambda n: p <= F.get("high", n)
        right = lambda n: (p >= F.get("low", n)) | ~left(n)
        return F.flatten(F.transform(nodes, lambda n: F.array_compact(F.array(F.when(left(n), 2 * n + 1), F.when(right(n), 2 * n + 2)))))

    walked = F.aggregate(F.slice("at", 1, F.floor(F.log2(F.size("low") + 1) + 0.5).cast("int")), F.array(F.lit(0)), step)
    ends = F.transform(walked, lambda n: F.col("leaf") * 2**forest.deeper + n - F.size("low"))
    lists = at.join(bands, "leaf").select("node", F.explode(ends).alias("leaf")).groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return indexed.drop("leaves").join(lists, "node")


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, n_links, component_id, kept; vectors of other lengths are never compared."""
    kind = "f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"

    @F.pandas_udf("key binary, node long, vector binary, width int")
    def units(col: pd.Series) -> pd.DataFrame:
        rows = []
        for v, u in zip(col, _unit(col), strict=True):
            raw = None if u is None else (u + 0.0).tobytes()
            rows.append((None, None, None, None) if raw is None else (xxhash.xxh3_128_digest(raw), xxhash.xxh3_64_intdigest(raw) - (1 << 63), np.array(v, kind).tobytes(), len(u)))
        return pd.DataFrame(rows, columns=["key", "node", "vector", "width"]).astype({"node": "Int64", "width": "Int32"})

    rows = materialize(embeddings.select("vec_id", units("embedding").alias("u")).select("vec_id", "u.*"), "vectors")
    reps = rows.where("node is not null").groupBy("node", "width").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector"))
    reps = materialize(reps, "directions")
    widths = reps.groupBy("width").count()
    large = widths.where(F.col("count") > leaf).collect()  # lengths that more than a leaf of vectors have

    # Lengths of few vectors are a leaf each, without a tree.
    few = reps.join(sized(widths.where(F.col("count") <= leaf).select("width")), "width", "left_semi")
    parts = [few.select("width", "node", "weight", "vector", F.array(F.lit(0).cast("long")).alias("leaves"))]
    for r in large:
        own = reps.where(F.col("width") == r["width"])
        picked = _stack(pd.Series([x["vector"] for x in own.orderBy("node").select("vector").limit(sample).collect()]), kind)
        forest = Forest(picked, r["count"], trees, leaf)
        indexed = own.select("width", "node", "weight", "vector", _index(forest, kind)("vector").alias("leaves"))
        if forest.deeper:
            indexed = split_further(materialize(indexed, "upper"), forest, kind, leaf).select("width", "node", "weight", "vector", "leaves")
        parts.append(indexed)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = materialize(every, "indexed")
    seen = every.select("*", F.explode("leaves").alias("leaf"))
    # blocks by hash of the vector: as many as its leaf needs
    size = materialize(seen.groupBy("width", "leaf").count(), "leaves")
    seen = seen.join(sized(size), ["width", "leaf"]).withColumn("last", F.floor((F.col("count") - 1) / BLOCK))
    seen = seen.withColumn("block", F.pmod(F.xxhash64("node"), F.col("last") + 1))
    pair = lambda i: F.struct(F.least(F.col("block"), i).alias("p"), F.greatest(F.col("block"), i).alias("q"))
    dealt = seen.withColumn("pq", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "last"), pair)))
    dealt = dealt.select("width", "leaf", "pq.p", "pq.q", "block", "node", "weight", "vector", "leaves")
    found = materialize(dealt.groupBy("width", "leaf", "p", "q").applyInPandas(_compare(threshold, kind), "node long, n long, root long"), "links")
    discard(every, size)
    classes = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = (
        reps.select("node", "vec_id", "weight")
        .join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
        .join(classes, "node", "left")
        .select("node", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    least = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    ids = known.join(least, "component").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(ids, "node", "left")
    one = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), one.alias("component_id"), F.coalesce(one == F.col("vec_id"), F.lit(False)).alias("kept"))
