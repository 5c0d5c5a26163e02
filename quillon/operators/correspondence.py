"""Which part of one version of a text became which part of the other, and back.

Segments are rows (doc, n, kind, a_start, a_end, b_start, b_end) in code points, half open, in order, that cover both texts: `block` where
the two are known to be the same part, `gap` between blocks. They come from a list of blocks with what each was turned into
(`block_segments`), or from the texts alone (`anchor_segments`): lines that stand once in either version are joined by their digest, and of
these pairs the longest run that rises on both sides is kept. Ranges are mapped by an interval join on the segments.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import WS, strip

SEGMENTS = "array<struct<kind string, a_start int, a_end int, b_start int, b_end int>>"
_NAMES = ("kind", "a_start", "a_end", "b_start", "b_end")


def _covered(blocks: list[tuple[int, int, int, int]], a: int, b: int) -> list[dict]:
    """Blocks in order as segments, with the gaps before, between and after them; texts of a and b code points."""
    out, p, q = [], 0, 0
    for a0, a1, b0, b1 in blocks:
        out += [("gap", p, a0, q, b0), ("block", a0, a1, b0, b1)]
        p, q = a1, b1
    return [dict(zip(_NAMES, s, strict=True)) for s in [*out, ("gap", p, a, q, b)]]


def place_blocks(a: str, b: str, blocks: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """Spans of blocks (first line, last line, what was written): each is looked for after the one before; what is not found, or
    begins before the end of one that was, is left to the gap."""
    starts = [0, *(m.end() for m in re.finditer("\n", a))]
    out, p, q = [], 0, 0
    for first, last, written in blocks:
        at = b.find(written, q) if written else -1
        begin = starts[max(first, 1) - 1] if first <= len(starts) else len(a)
        if at >= 0 and begin >= p:
            p, q = max(begin, starts[last] - 1 if last < len(starts) else len(a)), at + len(written)
            out.append((begin, p, at, q))
    return out


def block_segments(versions: DataFrame, blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """versions(doc, a, b) and blocks(doc, seq, line, end_line, written) -> segments. Null texts are empty; a document without blocks is one gap."""
    listed = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "line", "end_line", "written"))).alias("_l"))

    @F.pandas_udf(SEGMENTS)
    def run(a: pd.Series, b: pd.Series, each: pd.Series) -> pd.Series:
        out = []
        for x, y, rows in zip(a, b, each, strict=True):
            x, y = x or "", y or ""
            found = place_blocks(x, y, [(r["line"], r["end_line"], r["written"]) for r in rows] if rows is not None else [])
            out.append(_covered(found, len(x), len(y)))
        return pd.Series(out)

    whole = versions.select(doc, "a", "b").join(listed, doc, "left")
    return whole.select(doc, F.posexplode(run("a", "b", "_l")).alias("n", "s")).select(doc, "n", "s.*")


def rising(values: list[int]) -> list[int]:
    """Places of a longest run of strictly rising values, by the least last value of each length."""
    last, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(last, v)
        before.append(at[k - 1] if k else -1)
        if k == len(last):
            last.append(v)
            at.append(i)
        else:
            last[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _lone_lines(versions: DataFrame, doc: str, side: str) -> DataFrame:
    """(doc, digest, place, start, stop) of the lines of one side that stand there once; lines of white space are none."""
    lines = F.split(F.coalesce(side, F.lit("")), "\n")
    starts = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), F.md5(x).alias("digest"), (strip(x) == "").alias("blank")))
    rows = versions.select(doc, F.explode(starts).alias("l")).select(doc, "l.*")
    lone = rows.groupBy(doc, "digest").agg(F.min("i").alias("i"), F.min("n").alias("n"), F.min("blank").alias("blank"), F.count("*").alias("c"))
    return lone.where("c = 1 and not blank").select(doc, "digest", F.col("i").alias(f"{side}_i"))


def anchor_segments(versions: DataFrame, doc: str = "doc") -> DataFrame:
    """versions(doc, a, b) -> segments whose blocks are the lines that are anchors; neighbouring anchors are one block."""
    pairs = _lone_lines(versions, doc, "a").join(_lone_lines(versions, doc, "b"), [doc, "digest"])
    listed = pairs.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("a_i", "b_i"))).alias("_l"))

    @F.pandas_udf(SEGMENTS)
    def run(a: pd.Series, b: pd.Series, each: pd.Series) -> pd.Series:
        out = []
        for x, y, rows in zip(a, b, each, strict=True):
            x, y = x or "", y or ""
            rows = [(r["a_i"], r["b_i"]) for r in rows] if rows is not None else []
            edges = [[0, *(m.end() for m in re.finditer("\n", t)), len(t) + 1] for t in (x, y)]
            runs: list[list[int]] = []
            for k in rising([j for _, j in rows]):
                i, j = rows[k]
                if runs and (i, j) == (runs[-1][1] + 1, runs[-1][3] + 1):
                    runs[-1][1], runs[-1][3] = i, j
                else:
                    runs.append([i, i, j, j])
            out.append(_covered([(edges[0][i], edges[0][m + 1] - 1, edges[1][j], edges[1][n + 1] - 1) for i, m, j, n in runs], len(x), len(y)))
        return pd.Series(out)

    whole = versions.select(doc, "a", "b").join(listed, doc, "left")
    return whole.select(doc, F.posexplode(run("a", "b", "_l")).alias("n", "s")).select(doc, "n", "s.*")


def with_found(rows: DataFrame, text: str, wanted: str) -> DataFrame:
    """rows with _start (from 1) and _length of `wanted` in `text`: as it is, else with any white space where it has some. _length is 0 where
    it is not there, is empty or, to be found that way, shorter than two characters."""
    rows = rows.withColumn("_at", F.expr(f"locate({wanted}, {text})"))
    words = F.array_join(F.transform(F.split(wanted, rf"{WS}+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", r"\\$0")), f"{WS}+")
    rows = rows.withColumn("_pattern", F.when((F.col("_at") == 0) & (F.length(wanted) >= 2), words)).withColumn("_found", F.expr(f"regexp_extract({text}, _pattern, 0)"))
    length = F.when(F.col(wanted) == "", 0).when(F.col("_at") > 0, F.length(wanted)).otherwise(F.coalesce(F.length("_found"), F.lit(0)))
    place = F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.expr(f"locate(_found, {text})"))
    return rows.withColumn("_length", length).withColumn("_start", place).drop("_at", "_pattern", "_found")


def map_ranges(ranges: DataFrame, segments: DataFrame, versions: DataFrame, doc: str = "doc", side: str = "a") -> DataFrame:
    """ranges(doc, id, start, stop) of one side -> id, kind, start, stop, exact on the other.

    A range belongs to the segment that its start is in (an empty segment holds its place, one past the end the last). If what the range
    holds, trimmed, is found there on the other side, it is mapped to that, else to the whole segment; to nothing (null) where that is empty.
    """
    other = "b" if side == "a" else "a"
    s0, s1, o0, o1 = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{other}_start"), F.col(f"{other}_end")
    # a start is in one segment, in an empty one at its place, or past the last: the first of these by n
    joined = ranges.join(segments, doc).where((F.col("start") >= s0) & (F.col("start") <= F.greatest(s1, s0)))
    inside = (F.col("start") < F.greatest(s1, s0 + 1))
    best = joined.groupBy(doc, "id").agg(F.min_by(F.struct("kind", "start", "stop", o0.alias("o0"), o1.alias("o1")), F.struct((~inside).cast("int"), "n")).alias("s"))
    texts = versions.select(doc, F.coalesce(side, F.lit("")).alias("_from"), F.coalesce(other, F.lit("")).alias("_to"))
    rows = best.select(doc, "id", "s.*").join(texts, doc)
    rows = rows.withColumn("_want", strip(F.expr("substring(_from, start + 1, stop - start)"))).withColumn("_in", F.expr("substring(_to, o0 + 1, o1 - o0)"))
    rows = with_found(rows, "_in", "_want")
    length, place = F.col("_length"), F.col("_start")
    exact = length > 0
    whole = F.col("o1") > F.col("o0")
    first = F.when(exact, F.col("o0") + place - 1).when(whole, F.col("o0"))
    return rows.select(doc, "id", F.when(exact | whole, F.col("kind")).alias("kind"), first.alias("start"), F.when(exact, F.col("o0") + place - 1 + length).when(whole, F.col("o1")).alias("stop"), exact.alias("exact"))


def lines_of(text: Column, start: Column, stop: Column) -> Column:
    """struct<first, last>: the lines, from 1, that a range touches."""
    breaks = lambda end: F.regexp_count(F.substring(text, F.lit(1), end), F.lit("\n")) + 1
    return F.struct(breaks(start).alias("first"), breaks(F.greatest(start, stop - 1)).alias("last"))
