"""Brace groups of any depth, by one scan of a text from left to right.

A pattern cannot follow braces of any depth, and java.util.regex follows alternatives under a repeat by recursion, which ends
a JVM on long texts. So texts as a whole are scanned (`matches`) in Arrow batches, and what the scan yields are spans: pieces
between and inside groups, calls of commands with their arguments. Inside lambdas, where no Python runs, `deep` states groups as a pattern
of possessive parts, which needs no stack; it ends at DEPTH levels.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of braces that `deep` follows.
DEPTH = 12
_MARK = re.compile(r"\\.|[{}]", re.S)
PIECES = "array<struct<group boolean, text string>>"
CALLS = "array<struct<before string, name string, args array<string>>>"


def deep(levels: int = DEPTH) -> str:
    """A pattern of a brace group that nests at most `levels` deep."""
    out = r"\{[^{}]*+\}"
    for _ in range(levels - 1):
        out = rf"\{{(?>[^{{}}]++|{out})*+\}}"
    return out


def inside(levels: int = DEPTH) -> str:
    """`deep` with what the outermost braces hold as a capturing group."""
    return rf"\{{((?>[^{{}}]++|{deep(levels - 1)})*+)\}}"


def matches(text: str) -> dict[int, int]:
    """Where each brace that is closed opens -> just past where it closes. Escaped braces are characters."""
    waiting, out = [], {}
    for m in _MARK.finditer(text):
        if m[0] == "{":
            waiting.append(m.start())
        elif m[0] == "}" and waiting:
            out[waiting.pop()] = m.end()
    return out


def cut(text: str) -> list[tuple[bool, str]]:
    """(group?, stretch): outermost closed groups and what lies between them, in order."""
    out, at = [], 0
    for start, end in sorted(matches(text).items()):
        if start >= at:
            if start > at:
                out.append((False, text[at:start]))
            out.append((True, text[start:end]))
            at = end
    if at < len(text):
        out.append((False, text[at:]))
    return out


def pieces(c: Column) -> Column:
    """array<struct<group, text>> of a text: its outermost brace groups and what lies between; none of a null."""

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"group": g, "text": t} for g, t in cut(x or "")] for x in texts])

    return run(c)


def read_call(text: str, at: int, need: int, ends: dict[int, int]) -> tuple[list[str], int] | None:
    """The arguments of a command from `at` on and where they end: `need` groups, commands or characters, with options in brackets and
    parameter marks (#1) as they come before them. None if a group does not close or the text ends."""
    args = []
    while need:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return None
        if text[at] == "[":
            end = at + 1
            while end < len(text) and text[end] != "]":
                end = ends.get(end, end + (2 if text[end] == "\\" else 1)) if text[end] in "{\\" else end + 1
            if end >= len(text):
                return None
            end += 1
        elif text[at] == "{":
            if at not in ends:
                return None
            end = ends[at]
            need -= 1
        elif text[at] == "#":
            end = min(at + 2, len(text))
        elif text[at] == "}":
            return None
        else:
            end = _TOKEN.match(text, at).end()
            need -= 1
        args.append(text[at:end])
        at = end
    return args, at


_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|.", re.S)


def find_calls(text: str, names: re.Pattern, need: dict[str, int], other: int) -> list[tuple[str, str | None, list[str]]]:
    """(text before, name, arguments) of each call of a command of `names`, and the rest with a null name. A call that is not whole is text."""
    ends, out, done, at = matches(text), [], 0, 0
    while m := names.search(text, at):
        at = m.end()
        found = read_call(text, at, need.get(m[1], other), ends)
        if found is not None:
            out.append((text[done : m.start(1) - 1], m[1], found[0]))
            done = at = found[1]
    out.append((text[done:], None, []))
    return out


def calls(c: Column, names: str, need: dict[str, int] | None = None, other: int = 1) -> Column:
    """array<struct<before, name, args>>: the calls \\name of commands whose names match `names` (a star after it is passed over), with as many
    arguments as `need` says; arguments as written. The last one has no name and is what comes after all calls."""

    @F.pandas_udf(CALLS)
    def run(texts: pd.Series) -> pd.Series:
        pattern = re.compile(rf"(?<!\\)(?:\\\\)*\\({names})(?![A-Za-z])\*?")
        return pd.Series([[{"before": b, "name": n, "args": a} for b, n, a in find_calls(x, pattern, need or {}, other)] if x else [] for x in texts])

    return run(c)
