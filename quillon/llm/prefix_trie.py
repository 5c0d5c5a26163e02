"""A trie of conversation prefixes, kept as succinct level-order (LOUDS) tries, one for each shard of prefixes.

A node is a distinct sequence of first turns. Its key are two 64-bit sums without carry (xor) of hashes of (place, turn's digest)
along the sequence: so the key of a longer sequence comes from a shorter one's and the turn added, and a running window gives all keys of
a conversation. Only digests and lengths of turns are moved, never texts. Equal conversations are put together first:
a path stands for all of them, and copies, however many, are one path.

Upper levels and shards. The rows of a node's subtree are bounded from above by the paths through it and what is left of them. Nodes with
a bound beyond SHARD_ROWS, and the root, are the heavy upper levels; the nodes below them that are not are the tops of shards, each at most
that large. Shards are dealt to groups of some SHARD_ROWS nodes, and a task builds a group's trie in NumPy: nodes in level
order, LOUDS bits (a one for each child, a zero for each node), labels, and rollups by a pass over the levels from the last to the first with
np.add.at. The tops' sums are then merged into the upper levels: each top and upper node is summed at its least path, from the
end of the path to its begin, and those sums by node. Nothing is collected, and no task holds more than a group.

Turns are ordered by `turn`, null first, ties by the turn's digest. A null role or text is an empty one; rows without a conv_id are in
no conversation. Repeated rows are turns of their own. Other columns are ignored. An empty table has no nodes. A long conversation goes
through one task of a window, row by row, not as a whole in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, discard, materialize, sized

#: Nodes of a shard, and about those of a group of shards.
SHARD_ROWS = 200_000
#: Members of a node are joined into lists of those with equal quotient by this.
ID_BLOCK = 4096
NODE = ["p", "q"]
TRIE = "group long, louds binary, label_p binary, label_q binary, conv_id binary, n_convs binary, chars binary, n_leaves binary, saved_tokens binary, tops binary"


class Louds:
    """The bits of a forest under node 0: for each node in level order a one per child, then a zero."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.ones, zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
        self.zeros = np.concatenate([[-1], zeros])

    @classmethod
    def build(cls, parent: np.ndarray) -> Louds:
        """parent[i]: the parent of node i + 1 in level order, 0 for tops; never falling."""
        degree = np.bincount(parent, minlength=len(parent) + 1)
        bits = np.ones(len(parent) + len(degree), np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        return cls(bits)

    @classmethod
    def unpack(cls, data: bytes, nodes: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8), count=2 * nodes + 1))

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def parents(self) -> np.ndarray:
        """rank0(select1(i)) of nodes 1, 2, ..."""
        return self.ones - np.arange(len(self.ones))

    def degrees(self) -> np.ndarray:
        """select0(i + 1) - select0(i) - 1 of nodes 0, 1, ..."""
        return np.diff(self.zeros) - 1

    def levels(self) -> list[tuple[int, int]]:
        """Node ranges of the levels below node 0: the children of a range are one range."""
        out, first, last = [], 0, 1
        while True:
            # children of nodes first..last - 1: the ones between their zeros
            low, high = int(self.zeros[first] + 1 - first) + 1, int(self.zeros[last] - last + 1) + 1
            if low >= high:
                return out
            out.append((low, high))
            first, last = low, high


def rollup(louds: Louds, *values: np.ndarray) -> list[np.ndarray]:
    """Sums over subtrees of values of nodes 1, 2, ...: levels from the last to the first, each added to its parents."""
    parent = louds.parents()
    out = [np.concatenate([[0], v]) for v in values]
    for low, high in reversed(louds.levels()[1:]):
        for total in out:
            np.add.at(total, parent[low - 1 : high - 1], total[low:high])
    return [total[1:] for total in out]


def build_trie(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's nodes (p, q, pp, pq, depth, conv_id, n_convs, chars) -> its row of TRIE."""
    place = pd.MultiIndex.from_arrays([pdf["p"], pdf["q"]]).get_indexer(pd.MultiIndex.from_arrays([pdf["pp"], pdf["pq"]]))
    depth, conv = pdf["depth"].to_numpy(), pdf["conv_id"].to_numpy()
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    level = np.zeros(len(pdf), np.int64)
    for at in np.split(by_depth, cuts):
        level[at] = np.where(place[at] < 0, 0, level[place[at]] + 1)
    rank, number = np.zeros(len(pdf) + 1, np.int64), 1  # rank[-1]: of no node, so 0
    by_level, order = np.argsort(level, kind="stable"), []
    for at in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        at = at[np.lexsort((pdf["q"].to_numpy()[at], pdf["p"].to_numpy()[at], conv[at], rank[place[at]]))]
        rank[at] = np.arange(number, number + len(at))
        number += len(at)
        order.append(at)
    order = np.concatenate(order)
    louds = Louds.build(rank[place[order]])
    pdf = pdf.iloc[order]
    n, chars = pdf["n_convs"].to_numpy(), pdf["chars"].to_numpy()
    leaves, saved = rollup(louds, (louds.degrees()[1:] == 0).astype(np.int64), (n - 1) * chars)
    tops = pdf.loc[place[order] < 0, ["pp", "pq", "depth"]].to_numpy().astype("<i8")
    label = [(pdf[a] ^ pdf[b]).to_numpy() for a, b in (("p", "pp"), ("q", "pq"))]
    columns = [louds.pack(), *(np.asarray(v).astype("<i8").tobytes() for v in (*label, pdf["conv_id"], n, chars, leaves, saved, tops))]
    return pd.DataFrame([[int(pdf["group"].iloc[0]), *columns]], columns=[c.split()[0] for c in TRIE.split(", ")])


def read_trie(row) -> pd.DataFrame:
    """The nodes of one row of TRIE: keys, parents and depths come from its bits and labels."""
    conv, n, leaves, saved, lp, lq = (np.frombuffer(row[c], "<i8") for c in ("conv_id", "n_convs", "n_leaves", "saved_tokens", "label_p", "label_q"))
    louds = Louds.unpack(row["louds"], len(conv))
    tops = np.frombuffer(row["tops"], "<i8").reshape(-1, 3)
    parent, levels = louds.parents(), louds.levels()
    p, q, depth = (np.zeros(len(conv) + 1, np.int64) for _ in range(3))
    for k, (low, high) in enumerate(levels):
        up = parent[low - 1 : high - 1]
        p[low:high] = lp[low - 1 : high - 1] ^ (p[up] if k else tops[:, 0])
        q[low:high] = lq[low - 1 : high - 1] ^ (q[up] if k else tops[:, 1])
        depth[low:high] = depth[up] + 1 if k else tops[:, 2]
    pp, pq, above = p[parent], q[parent], np.concatenate([[0], conv])[parent]
    pp[: len(tops)], pq[: len(tops)] = tops[:, 0], tops[:, 1]
    return pd.DataFrame({
        "p": p[1:], "q": q[1:], "pp": pp, "pq": pq, "depth": depth[1:], "conv_id": conv, "above": pd.array(np.where(parent > 0, above, 0), "Int64"), "top": parent == 0,
        "n_convs": n, "n_children": louds.degrees()[1:], "n_leaves": leaves, "saved_tokens": saved,
    })


def trie_nodes(tries: DataFrame) -> DataFrame:
    """The nodes of tries, one row each; `top` where the parent is in the upper levels."""

    def read(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                nodes = read_trie(row)
                for k in range(0, len(nodes), 50_000):
                    yield nodes.iloc[k : k + 50_000]

    return tries.mapInPandas(read, "p long, q long, pp long, pq long, depth long, conv_id long, above long, top boolean, n_convs long, n_children long, n_leaves long, saved_tokens long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, chars of every turn in its conversation's order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.withColumn("place", F.row_number().over(order).cast("long")).drop("turn")


def rebuilt_turns(turns: DataFrame, most: int = 6, block: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h = crc32(c) % most turns of conversation c - c % block, then go on with their own after h.

    -> (conv_id, depth, digest, chars, rest: turns after it), and (conv_id, turns) of all conversations."""
    first = turns.where((F.pmod("conv_id", F.lit(block)) == 0) & (F.col("place") < most))
    lengths = first.groupBy(F.col("conv_id").alias("root")).agg(F.count("*").alias("have"))
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("root"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h")
    )
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    each = each.join(lengths, "root", "left").select("conv_id", "root", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    own = turns.join(each.drop("root"), "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
    head = each.where("taken > 0").join(first.select(F.col("conv_id").alias("root"), F.col("place").alias("depth"), "digest", "chars"), "root").where("depth <= h")
    out = [d.select("conv_id", "depth", "digest", "chars", (F.col("turns") - F.col("depth")).alias("rest")) for d in (own, head)]
    return out[0].unionByName(out[1]), each.select("conv_id", "turns")


def keyed(rebuilt: DataFrame) -> DataFrame:
    """Adds the node's key p, q and its parent's pp, pq to each turn."""
    step = rebuilt.select("*", F.xxhash64("depth", "digest").alias("hp"), F.xxhash64(F.lit(7), "digest", "depth").alias("hq")).drop("digest")
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    step = step.select("*", F.bit_xor("hp").over(so_far).alias("p"), F.bit_xor("hq").over(so_far).alias("q"))
    return step.select("conv_id", "depth", "p", "q", F.col("p").bitwiseXOR(F.col("hp")).alias("pp"), F.col("q").bitwiseXOR(F.col("hq")).alias("pq"), "chars", "rest")


def member_digests(ends: DataFrame) -> DataFrame:
    """ends(p, q, conv_id) -> p, q, ends_sha256 of the comma-joined conv_ids in ascending order.

    Lists of ids in one block of ID_BLOCK numbers are joined first; a node's lists, in order, then pass a running hash."""
    lists = ends.groupBy("p", "q", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        now, state = None, None
        for pdf in batches:
            done = []
            for p, q, ids in zip(pdf["p"], pdf["q"], pdf["ids"], strict=True):
                if (p, q) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (p, q), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["p", "q", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["p", "q", "ends_sha256"])

    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "block").select("p", "q", "ids").mapInPandas(run, "p long, q long, ends_sha256 string")


class PrefixTrie:
    """The tries of a table of conversations: `tries` (rows of TRIE), `upper` (the heavy nodes), `ends` (members by the node they end at).

    All are written tables; `discard` removes them."""

    def __init__(self, conversations: DataFrame, shard_rows: int = SHARD_ROWS):
        spark = conversations.sparkSession
        bounded_batches(spark, rows=10_000)
        turns = materialize(numbered_turns(conversations), "turns")
        rebuilt, each = rebuilt_turns(turns)
        steps = materialize(keyed(rebuilt), "steps")
        end = steps.where("rest = 0").select("p", "q", "conv_id").union(each.where("turns = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
        self.ends = materialize(end, "ends")
        paths = self.ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        paths = materialize(steps.join(paths.select("conv_id", "n"), "conv_id"), "paths")
        discard(turns, steps)
        heavy = materialize(paths.groupBy(*NODE).agg(F.sum(F.col("rest") + 1).alias("bound")).where(F.col("bound") > shard_rows).select(*NODE, F.lit(True).alias("heavy")), "heavy")
        path = Window.partitionBy("conv_id")
        marked = paths.join(sized(heavy), NODE, "left").withColumn("cut", F.coalesce(F.max(F.when(F.col("heavy"), F.col("depth"))).over(path), F.lit(0)))
        top = [F.max(F.when(F.col("depth") == F.col("cut") + 1, F.col(c))).over(path).alias(f"top_{c}") for c in NODE]
        self.paths = materialize(marked.select("*", *top).drop("heavy"), "marked")
        node = [F.min(c).alias(c) for c in ("depth", "pp", "pq", "conv_id")] + [F.sum("n").alias("n_convs"), F.min("chars").alias("chars")]
        light = self.paths.where("depth > cut")
        rows = light.count()
        groups = max(1, -(-rows // shard_rows), min(spark.sparkContext.defaultParallelism, rows // 20_000))
        group = F.pmod(F.xxhash64("top_p", "top_q"), F.lit(groups)).alias("group")
        nodes = light.groupBy(*NODE, group).agg(*node)
        self.tries = materialize(nodes.groupBy("group").applyInPandas(build_trie, TRIE), "tries")
        self.upper = materialize(self.paths.where("depth <= cut").groupBy(*NODE).agg(*node), "upper")
        discard(paths, heavy)

    def nodes(self) -> DataFrame:
        """All nodes: p, q, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens."""
        light = materialize(trie_nodes(self.tries), "nodes")
        tops = light.where("top")
        root = self.ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        root = root.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("pp"), F.lit(None).cast("long").alias("pq"), "n_convs", F.lit(0).cast("long").alias("chars"))
        upper = self.upper.select(*root.columns).unionByName(root)
        below = tops.select("p", "q", "pp", "pq", "conv_id").unionByName(self.upper.select("p", "q", "pp", "pq", "conv_id"))
        children = below.groupBy(F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("n_children"))
        upper = upper.join(children, NODE, "left").fillna(0, ["n_children"])
        # what each upper node and top adds, at the path that is its least
        adds = upper.select("p", "q", "conv_id", F.expr("cast(n_children = 0 as bigint)").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        adds = adds.unionByName(tops.select("p", "q", "conv_id", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        steps = self.paths.where("depth <= cut + 1").select("p", "q", "conv_id", "depth", "cut").join(adds.where("p <> 0 or q <> 0"), [*NODE, "conv_id"], "left")
        rest = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.select("*", *[F.sum(F.coalesce(c, F.lit(0))).over(rest).alias(f"sum_{c}") for c in ("leaves", "saved")])
        sums = steps.where("depth <= cut").groupBy(*NODE).agg(F.sum("sum_leaves").alias("n_leaves"), F.sum("sum_saved").alias("saved_tokens"))
        whole = adds.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "*")
        upper = upper.join(sums.unionByName(whole), NODE)
        names = upper.select(F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("name"))
        kept = ["p", "q", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        inner = light.where("not top").withColumnRenamed("above", "parent_conv_id").select(*kept)
        outer = tops.drop("above").select("pp", "pq", *[c for c in kept if c != "parent_conv_id"]).unionByName(upper.drop("chars")).join(names, ["pp", "pq"], "left")
        return inner.unionByName(outer.withColumnRenamed("name", "parent_conv_id").select(*kept))

    def discard(self) -> None:
        discard(self.tries, self.upper, self.ends, self.paths)


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    trie = PrefixTrie(conversations, shard_rows)
    found = trie.nodes().join(member_digests(trie.ends), NODE, "left")
    out = materialize(found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    ), "trie-nodes")
    trie.discard()
    return out
