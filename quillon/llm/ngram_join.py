"""N-gram Jaccard join: exact, by size-banded tiles with hashed bitmap signatures.

Documents with equal shingle sets are one class; classes are compared, never copies. Sets whose Jaccard similarity
reaches t = num/den differ in at most k = floor((a + b)(1 - t)/(1 + t)) shingles, a and b their sizes. Class sizes are
cut into bands; inside a band (and from the bands above as far as t lets sizes reach) k is fixed, and the hash range of
shingles is divided into m > k parts, so two similar sets agree on at least m - k whole parts. A *tile* is a band, a
part and the content of that part: similar classes meet in at least one tile, and unlike single shingles, a tile
is not shared merely because a passage is. A set's *spare* is m - k - 1 less its empty parts: of the tiles it shares with
anyone it leaves its `spare` largest, in an order that is the same for all. The parts on which two similar sets agree are
more than the spare of either, so the last of them in that order is one that neither leaves, and a class that shares
few tiles, as by a common passage, is compared with none. With a spare below zero (m is chosen so that this is rare) a set
keeps all its tiles and the empty parts make tiles too (shown in `_tiles`).

Candidates of a tile are thinned by hashed bitmaps: |A & B| <= (a + b - popcount(bitA ^ bitB)) / 2. What passes is
settled by exact intersection of the sorted arrays of 64-bit shingle hashes, which are read for those classes only.

Components need no pair inside a component already known:
1. least and greatest class of each tile, by an aggregation that combines before its shuffle; tiles of one class go, and
   a join that AQE splits where it is skewed brings back the classes of the others; then each leaves what its spare allows,
2. in each tile left every class is compared with one only (linear in the tile's size): the class that shares the most tiles
   with others, which in a group of copies is what they were made from,
3. connected components of the links found,
4. of tiles that still hold several components, those of up to SMALL_TILE pairs to compare are joined with themselves. A
   larger one is cut into blocks of about BLOCK classes by hash, those of its most frequent component apart, and each
   pair of blocks but those of that component is compared by bitmap in one task,
5. pairs of different components that pass are verified exactly, and their links connect the components found before.
So a large group of near copies costs one comparison a member for most of its members, no task gets more than two
blocks, and what is emitted is candidates across components only.

Texts are scanned once for counts, tiles and bitmaps, and those of candidates that pass the bitmaps again for their arrays.
Intermediate tables are removed when what reads them is written.

Results: one row per input row. Words, case folding and short texts: see `shingle_hashes`. Null ids keep their row, with
component_id the least non-null id reachable (null if none); null or empty texts have n_shingles 0 and are their own
component; repeated rows repeat. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from math import exp, floor, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import bounded_batches, discard, materialize, sized
from quillon.llm.components import connected_components

#: Classes in one block of a tile, about.
BLOCK = 1024
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
FEATURES = "n_shingles long, key binary, node long, bitmap binary, tiles array<long>, slots array<int>"
SETS = "key binary, node long, hashes binary"
#: Tiles with at most so many pairs of a class outside their most frequent component with any are joined with themselves;
#: larger ones are compared by blocks.
SMALL_TILE = 1 << 10
#: A slot is a band and, in the low digits, a set's spare in it plus one (0: below zero).
SLOT = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's `size`-word shingles.

    Words are runs of other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Fewer words than `size` make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: max(len(h) - size + 1, 1)].copy()
    for i in range(1, min(size, len(h))):
        out = _mix(out * _A + h[i : len(out) + i])
    if len(h) < size:
        out = _mix(out + np.uint64(len(h)))
    return np.unique(out)


class Bands:
    """Bands of set sizes for a threshold: where each begins, how far it reaches, its k and its number of parts."""

    def __init__(self, threshold: Fraction, steps: int = 2):
        self.t = threshold
        self.gap = (1 - threshold) / (1 + threshold)
        self.growth = float(1 / threshold) ** steps
        self.starts, self.reach, self.k, self.parts, self.cuts, self.salt = [1], [], [], [], [], []

    def upto(self, size: int) -> None:
        while self.starts[-1] <= size:
            lo = self.starts[-1]
            nxt = max(lo + 1, floor(lo * self.growth))
            reach = floor((nxt - 1) / self.t)
            k = floor((nxt - 1 + reach) * self.gap)
            self.starts.append(nxt)
            self.reach.append(reach)
            self.k.append(k)
            m = self.parts_for(lo, k)
            self.parts.append(m)
            self.cuts.append(np.array([(i << 64) // m for i in range(1, m)], np.uint64))
            self.salt.append(_mix(np.arange(m, dtype=np.uint64) + np.uint64(len(self.parts) << 32)))

    @staticmethod
    def parts_for(size: int, k: int) -> int:
        """The fewest parts with which a set of this size seldom has more than m - k - 1 empty ones: 3.5 deviations off."""

        def room(m: int) -> float:
            load = size / m
            empty = m * exp(-load)
            deviation = sqrt(max(empty - m * (1 + load) * exp(-2 * load), 1e-9))
            return (m - k - 1 - empty) / deviation

        low, high = k + 2, max(k + 2, 4 * size)
        if room(high) < 3.5:
            return high
        while low < high:  # room grows with m
            mid = (low + high) // 2
            low, high = (low, mid) if room(mid) >= 3.5 else (mid + 1, high)
        return low

    def of(self, size: int) -> list[int]:
        """The bands a set of this size belongs to: its own, and those below that reach it (reach never falls with the band)."""
        self.upto(size)
        out = []
        for b in range(bisect_right(self.starts, size) - 1, -1, -1):
            if size > self.reach[b]:
                break
            if self.k[b]:  # with k = 0 only equal sets are similar
                out.append(b)
        return out


def _tiles(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, slots) of a sorted set: per band a hash of each part's content, and its slot beside each.

    Two similar sets agree on >= m - k parts. Of those, at most m - k - 1 are empty if one of the sets has no more empty
    parts, so a part that both have and emit remains; if both have more, both emit all parts. Likewise with parts left
    out because they are hot, which both or neither of two equal parts are.
    """
    tiles, slots = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    if len(s):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(s))])
        for b in bands.of(len(s)):
            m, k = bands.parts[b], bands.k[b]
            at = np.concatenate([[0], np.searchsorted(s, bands.cuts[b]), [len(s)]])
            parts = _mix(total[at[1:]] - total[at[:-1]] + bands.salt[b])
            full = at[1:] > at[:-1]
            spare = int(full.sum()) - k - 1
            tiles.append(parts[full] if spare >= 0 else parts)
            slots.append(np.full(len(tiles[-1]), b * SLOT + min(max(spare + 1, 0), SLOT - 1), np.int32))
    return np.concatenate(tiles), np.concatenate(slots)


def _bitmap(s: np.ndarray) -> bytes:
    """A bit per hash, in a power of two of at least eight times as many bits as the set has members: few bits coincide, so
    the bound is close."""
    bits = max(64, 1 << (8 * len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap as 64-bit words, its halves joined by OR until it has `size` bytes."""
    b = np.frombuffer(bitmap, np.uint64)
    while len(b) * 8 > size:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def needed(a, b, t: Fraction):
    """Least intersection that makes sets of sizes a and b similar: i * (num + den) >= num * (a + b)."""
    return -(-(t.numerator * (a + b)) // (t.numerator + t.denominator))


def features(documents: DataFrame, size: int, t: Fraction) -> DataFrame:
    """doc_id with FEATURES of documents(doc_id, text)."""

    @F.pandas_udf(FEATURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        bands, rows = Bands(t), []
        for x in texts:
            s = shingle_hashes(x, size)
            key = xxhash.xxh3_128_digest(s.tobytes())
            tiles, slots = _tiles(s, bands)
            rows.append((len(s), key, int.from_bytes(key[:8], "little", signed=True), _bitmap(s), tiles.view(np.int64), slots))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return documents.select("doc_id", run("text").alias("f")).select("doc_id", "f.*")


def passes_bitmap(t: Fraction):
    """Column expression over (n_a, bitmap_a, n_b, bitmap_b)."""

    @F.pandas_udf("boolean")
    def run(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
        need = needed(na.to_numpy(), nb.to_numpy(), t)
        top = (na + nb).to_numpy()
        out = []
        for x, y, n, s in zip(a, b, need.tolist(), top.tolist(), strict=True):
            size = min(len(x), len(y))
            out.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= s - 2 * n)
        return pd.Series(out, dtype=bool)

    return run("n_a", "bitmap_a", "n_b", "bitmap_b")


def links(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """pairs(a, b) of nodes -> (u, v) class keys of those whose sorted hash arrays reach the threshold."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # a merge of two sorted arrays
            out.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y), t))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("key").alias("u"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("key").alias("v"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(run("x", "y")).select("u", "v")


def _blocks(tiles: DataFrame) -> DataFrame:
    """tiles(tile, node, component, main, inside, outside, n, bitmap, own) -> rows dealt to pairs of blocks, a block by hash of the node.

    Blocks of the tile's main component come after the others and are compared with those only.
    """
    mains, others = F.ceil(F.col("inside") / BLOCK), F.ceil(F.col("outside") / BLOCK)
    hashed, is_main = F.xxhash64("node"), F.col("component") == F.col("main")
    block = F.when(is_main, others + F.pmod(hashed, mains)).otherwise(F.pmod(hashed, others))
    last = F.when(is_main, others).otherwise(others + mains) - 1
    dealt = tiles.withColumn("block", block).withColumn("last", last)
    pair = lambda i: F.struct(F.least(F.col("block"), i).alias("p"), F.greatest(F.col("block"), i).alias("q"))
    return dealt.withColumn("pq", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "last"), pair))).select(
        "tile", "pq.p", "pq.q", "block", "node", "component", "n", "bitmap", "own"
    )


def _across(t: Fraction):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of the two blocks that lie in different components, pass the bitmap test and share no lower tile of this kind."""
        p, q, tile = int(group.p.iloc[0]), int(group.q.iloc[0]), int(group.tile.iloc[0])
        rows, cols = group[group.block == p], group[group.block == q]
        if len(rows) > len(cols):
            rows, cols = cols, rows
        if not len(rows):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        size = int(group.bitmap.map(len).min())
        bits = [np.stack([folded(b, size) for b in side.bitmap]) for side in (rows, cols)]
        number = {c: i for i, c in enumerate(group.component.unique())}
        n, comp, node = ([side[c].map(number).to_numpy() if c == "component" else side[c].to_numpy() for side in (rows, cols)] for c in ("n", "component", "node"))
        own, out = [side.own.tolist() for side in (rows, cols)], []
        for i in range(len(rows)):
            differ = np.bitwise_count(bits[0][i] ^ bits[1]).sum(1, dtype=np.int64)
            ok = (differ <= n[0][i] + n[1] - 2 * needed(n[0][i], n[1], t)) & (comp[1] != comp[0][i])
            if p == q:
                ok &= node[1] > node[0][i]
            for j in np.flatnonzero(ok).tolist():
                if np.intersect1d(own[0][i], own[1][j], assume_unique=True)[0] == tile:
                    out.append((min(node[0][i], node[1][j]), max(node[0][i], node[1][j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def ngram_components(documents: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """documents(doc_id, text) -> row-wise doc_id, n_shingles, component_id (least doc_id linked, directly or not)."""
    bounded_batches(documents.sparkSession)
    t = Fraction(threshold)
    docs = documents.select("doc_id", "text")
    wide = materialize(features(docs, size, t), "shingles")

    # Tiles of two classes and more; copies of a class combine before the shuffle.
    every = wide.select("node", F.explode(F.arrays_zip("tiles", "slots")).alias("at"))
    every = every.select(F.col("at.tiles").alias("tile"), "node", F.col("at.slots").alias("slot"))
    met = every.groupBy("tile").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    met = materialize(met.select("tile"), "met")
    shared = materialize(every.join(met, "tile").distinct(), "shared")

    # Each class leaves the largest of them, as many as its spare: a window over the tiles of one class in one band, at most its parts.
    sizes = shared.groupBy("tile").agg(F.count("*").alias("size"))
    own = Window.partitionBy("node", "slot")
    left = shared.join(sizes, "tile").withColumn("rank", F.row_number().over(own.orderBy(F.desc("size"), "tile"))).withColumn("degree", F.sum("size").over(own))
    left = materialize(left.where(F.col("rank") >= F.col("slot") % SLOT).select("tile", "node", "degree"), "left")
    met_again = left.groupBy("tile").agg(F.max_by("node", F.struct("degree", "node")).alias("first"), F.count("*").alias("size")).where("size > 1")
    tiles = materialize(left.select("tile", "node").join(met_again, "tile"), "tiles")

    rows = materialize(wide.select("doc_id", "n_shingles", "key", "node"), "rows")
    named = rows.groupBy("key", "node", "doc_id").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rows")).alias("one")
    classes = materialize(named.groupBy("key", "node").agg(least).select("key", "node", "one.doc_id", "one.rows"), "classes")
    here = sized(tiles.select("node").distinct())
    small = wide.join(here, "node", "left_semi").select("node", "key", F.col("n_shingles").alias("n"), "bitmap")
    small = materialize(small.dropDuplicates(["key"]), "bitmaps")
    discard(wide, met, shared, left)

    def passing(pairs: DataFrame) -> DataFrame:
        side = lambda x: small.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}"))
        return materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(passes_bitmap(t)).select("a", "b"), "candidates")

    def settled(pairs: DataFrame) -> DataFrame:
        """Links among candidates; the arrays are those of their classes only."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = materialize(_sets(docs, classes.join(sized(nodes), "node", "left_semi"), size), "sets")
        out = materialize(links(pairs, sets, t), "links")
        discard(sets, pairs)
        return out

    stars = tiles.where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    found = settled(passing(stars))
    first = connected_components(found)

    # Tiles of three classes or more (a pair has been compared) that still hold several components.
    known = small.select("node", "key").join(first.select(F.col("node").alias("key"), "component"), "key", "left")
    known = materialize(known.select("node", "key", F.coalesce("component", "key").alias("component")), "known")
    of = known.select("node", "component")
    held = materialize(tiles.where("size > 2").join(of, "node").select("tile", "node", "component"), "held")
    each = held.groupBy("tile", "component").agg(F.count("*").alias("n"))
    main = each.groupBy("tile").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    open_ = materialize(held.join(main.where("outside > 0"), "tile"), "open")
    few = open_.where(f"outside * (inside + outside) <= {SMALL_TILE}")
    other = few.where("component <> main").select("tile", F.col("node").alias("b"), F.col("component").alias("c"))
    near = few.join(other, "tile").where("component <> c and (component = main or node < b)").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    many = open_.where(f"outside * (inside + outside) > {SMALL_TILE}")
    own = many.groupBy("node").agg(F.collect_set("tile").alias("own"))  # at most a set's own tiles
    across = _blocks(many.join(own, "node").join(small.select("node", "n", "bitmap"), "node"))
    across = across.groupBy("tile", "p", "q").applyInPandas(_across(t), "a long, b long")
    more = settled(passing(near.union(across).distinct()))

    # Its links connect components.
    ends = lambda x: known.select(F.col("key").alias(x), F.col("component").alias(f"c_{x}"))
    bridges = more.join(ends("u"), "u").join(ends("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
    joined = connected_components(bridges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    discard(tiles, small, held, open_, found, more)

    # Class components to documents' ids.
    ids = classes.join(known.select("key", "component"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    ids = ids.join(joined, "component", "left").select("key", "doc_id", F.coalesce("whole", "component").alias("component"))
    lowest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(lowest, "component").select("key", "component_id")
    alone = F.col("n_shingles") == 0  # texts without words are linked with nothing
    return rows.join(ids, "key").select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(documents: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents but for near duplicates: of each component the one with the least doc_id, once, with all its columns.

    Documents without an id cannot be named by their component and stay.
    """
    found = materialize(ngram_components(documents, size, threshold).select("doc_id", "component_id").where("doc_id is not null"), "groups")
    goes = found.where("doc_id <> component_id").select("doc_id").distinct()
    stay = documents.join(sized(goes), "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return stay
    once = stay.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*stay.columns)
    return stay.join(sized(again), "doc_id", "left_anti").select(*stay.columns).union(once)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """SETS of the classes in wanted(key, node, doc_id, rows), from the text of the row with their doc_id.

    Ids need not be unique nor known: texts are found by id (null-safe) and kept if their class is asked for. Where a
    class has its id on several rows, one of them is taken.
    """

    @F.pandas_udf(SETS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            raw = shingle_hashes(x, size).tobytes()
            key = xxhash.xxh3_128_digest(raw)
            rows.append((key, int.from_bytes(key[:8], "little", signed=True), raw))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SETS.split(", ")])

    wanted = materialize(wanted, "wanted")
    ids = sized(wanted.select("doc_id").distinct())
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    # Not deterministic to the optimizer, or it would move a test of the result below the join and run it on all texts.
    found = texts.select(run.asNondeterministic()("text").alias("s")).select("s.*")
    again = wanted.where("rows > 1").select("key")
    if again.isEmpty():
        return found.join(sized(wanted.select("key")), "key", "left_semi")
    once = found.join(sized(again), "key", "left_semi").dropDuplicates(["key"])
    return found.join(sized(wanted.where("rows = 1").select("key")), "key", "left_semi").union(once)
