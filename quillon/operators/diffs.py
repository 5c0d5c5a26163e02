"""Differences of two versions of a text as rows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\s+|\\[A-Za-z]+\*?|\\.|[A-Za-z]+|\d+|.", re.S)
LINES = "array<struct<kind string, before int, after int, text string, changed string>>"


#: Cells of the table of common lengths that are held at once; larger ones are halved first.
CELLS = 4_000_000


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row i, column j: length of the longest common subsequence of x[i:] and y[j:]."""
    out = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        out[i] = _row(out[i + 1], y == x[i])
    return out


def _row(below: np.ndarray, same: np.ndarray) -> np.ndarray:
    row = np.append(np.where(same, below[1:] + 1, below[:-1]), 0)
    return np.maximum.accumulate(row[::-1])[::-1]


def _script(x: np.ndarray, y: np.ndarray) -> str:
    """A shortest script as letters: e for both, d for one of x, i for one of y; deletions first. Long sequences are halved."""
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        low, high = np.zeros(len(y) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
        for i in range(len(x) - 1, half - 1, -1):
            low = _row(low, y == x[i])
        for i in range(half):
            high = _row(high, y[::-1] == x[i])
        at = int(np.argmax(low + high[::-1]))
        return _script(x[:half], y[:at]) + _script(x[half:], y[at:])
    common, out, i, j = _common(x, y), [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append("e")
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or common[i + 1, j] >= common[i, j + 1]):
            out.append("d")
            i += 1
        else:
            out.append("i")
            j += 1
    return "".join(out)


def edits(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """A shortest script from a to b as runs (kind, items), after the common ends are set aside."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(s, len(ids)) for s in side[head : len(side) - tail]], np.int32) for side in (a, b))
    runs: list[tuple[str, list[str]]] = []
    i = j = 0
    for op in "e" * head + _script(x, y) + "e" * tail:
        kind, item = {"e": "equal", "d": "delete", "i": "insert"}[op], b[j] if op == "i" else a[i]
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append(item)
        i, j = i + (op != "i"), j + (op != "d")
    return runs


def words_changed(before: str, after: str) -> tuple[str, str]:
    """The words of each side that the other has not, joined."""
    runs = edits(_WORD.findall(before), _WORD.findall(after))
    return tuple("".join("".join(items) for k, items in runs if k == kind) for kind in ("delete", "insert"))


def line_edits(before: str, after: str) -> list[tuple]:
    """(kind, before, after, text, changed) of every line of either side, edited lines in pairs with the words changed."""
    runs, out, n, m = edits(before.split("\n"), after.split("\n")), [], 1, 1
    for k, (kind, items) in enumerate(runs):
        if kind == "equal":
            out += [(kind, n + i, m + i, s, "") for i, s in enumerate(items)]
            n, m = n + len(items), m + len(items)
            continue
        mate = runs[k + 1][1] if kind == "delete" and k + 1 < len(runs) and runs[k + 1][0] == "insert" else runs[k - 1][1] if kind == "insert" and k and runs[k - 1][0] == "delete" else []
        for i, s in enumerate(items):
            pair = (s, mate[i]) if kind == "delete" else (mate[i], s) if i < len(mate) else None
            changed = s if i >= len(mate) else words_changed(*pair)[kind == "insert"]
            out.append((kind, n + i if kind == "delete" else None, m + i if kind == "insert" else None, s, changed))
        n, m = n + (len(items) if kind == "delete" else 0), m + (len(items) if kind == "insert" else 0)
    return out


def line_diff(versions: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """versions(key, before, after) -> a row for each line of either: key, i, kind, before, after (line numbers), text, changed. Null is empty."""

    @F.pandas_udf(LINES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("kind", "before", "after", "text", "changed")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in line_edits(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    rows = versions.select(key, run(F.col(before), F.col(after)).alias("d"))
    return rows.select(key, F.posexplode("d").alias("i", "e")).select(key, "i", "e.*")


def change_share(before: Column, after: Column) -> Column:
    """Share of lines of either version that the other does not have, counted as sets: a cheap measure, without alignment."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    return 1 - F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
