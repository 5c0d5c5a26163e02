"""Display blocks and tables of a document: what stands alone on a page and may be too wide for it."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.braces import matches

BLOCKS = "array<struct<start int, end int, body_start int, body_end int, env string, kind string, spec string, width string, wide boolean, in_float boolean, scaled boolean, size string>>"
_SKIPPED = r"%[^\n]*|\\begin\{(?P<v>verbatim|lstlisting|minted|comment)(?P<s>\*?)\}.*?\\end\{(?P=v)(?P=s)\}|\\verb\*?(?P<q>[^A-Za-z\s*]).*?(?P=q)"
_HIDE = re.compile(rf"{_SKIPPED}|\\.", re.S)
_EVENT = re.compile(
    r"\\(?P<edge>begin|end)\s*\{(?P<env>[^{}]+)\}|\\(?P<scale>resizebox|scalebox|adjustbox)\*?|\\(?P<size>normalsize|small|footnotesize|scriptsize|tiny)(?![A-Za-z])|(?P<open>\\\[|\$\$)|(?P<close>\\\])|\\.", re.S
)
_SIZED = re.compile(r"(?:\{\s*\\(normalsize|small|footnotesize|scriptsize|tiny)(?![A-Za-z])\s*)+\Z")
# The kind of each environment that is a block (a star is left out of the name), those that float, and those with a width.
KINDS = {
    "equation": "equation", "displaymath": "display", "align": "align", "flalign": "align", "eqnarray": "align", "gather": "gather", "multline": "multline",
    "tabular": "tabular", "tabularx": "tabularx", "tabulary": "tabularx", "array": "array",
}
FLOATS = ("table", "figure", "table*", "figure*", "wraptable", "sidewaystable")
WIDTHS = ("tabularx", "tabulary", "tabular*")
#: Arguments of a command that scales; the last is what it scales.
SCALED = {"resizebox": 3, "scalebox": 2, "adjustbox": 2}


def _kind(env: str) -> str | None:
    if env in ("array*", "tabularx*", "tabulary*"):
        return None
    return "tabularx" if env == "tabular*" else KINDS.get(env.removesuffix("*"))


def find_blocks(text: str) -> list[tuple]:
    """The outermost blocks of a text, as BLOCKS has them, by one scan and a sweep over what it found."""
    text = _HIDE.sub(lambda m: m[0] if m["v"] is None and m["q"] is None and m[0][0] != "%" else re.sub(r"[^\n]", " ", m[0]), text)
    ends = matches(text)

    def group(at: int) -> tuple[int, int] | None:
        while at < len(text) and text[at].isspace():
            at += 1
        return (at, ends[at]) if at in ends and text[at] == "{" else None

    def option(at: int) -> int:
        m = re.compile(r"\s*\[[^\]]*\]").match(text, at)
        return m.end() if m else at

    found, waiting, floats, scaled, scalers, sizes, display, first = [], {}, [], [], [], [], None, 0

    def closed(env: str, start: int, after: int, body_end: int, end: int) -> None:
        if env in FLOATS:
            floats.append((start, end, env))
        elif env == "adjustbox":
            scaled.append((after, end))
        elif _kind(env):
            spec = width = None
            if _kind(env) in ("tabular", "tabularx", "array"):
                if env in WIDTHS and (g := group(after)):
                    width, after = text[g[0] + 1 : g[1] - 1].strip(), g[1]
                after = option(after)
                if g := group(after):
                    spec, after = text[g[0] + 1 : g[1] - 1], g[1]
            found.append((start, end, min(after, body_end), body_end, env, _kind(env), spec, width))

    for m in _EVENT.finditer(text):
        env = (m["env"] or "").strip()
        if m["edge"] == "begin":
            if env == "document" and not first:
                first = m.end()
            if env == "adjustbox":
                scalers.append(m.start())
            waiting.setdefault(env, []).append((m.start(), m.end()))
        elif m["edge"] and waiting.get(env):
            closed(env, *waiting[env].pop(), m.start(), m.end())
        elif m["scale"]:
            at, last = m.end(), None
            scalers.append(m.start())
            for _ in range(SCALED[m["scale"]]):
                g = group(option(at))
                if not g:
                    break
                last, at = g, g[1]
            if last:
                scaled.append(last)
        elif m["size"]:
            sizes.append((m.start(), m["size"]))
        elif display and m[0] == display[1]:
            found.append((display[0], m.end(), display[0] + 2, m.start(), "$$" if display[1] == "$$" else "\\[", "display", None, None))
            display = None
        elif m["open"] and not display:
            display = (m.start(), "$$" if m["open"] == "$$" else "\\]")
    for env, opened in waiting.items():
        for start, after in opened:
            closed(env, start, after, len(text), len(text))

    out, top, reach, around = [], -1, -1, []
    floats.sort(reverse=True)
    scaled.sort(reverse=True)
    for start, end, body, body_end, env, kind, spec, width in sorted(found, key=lambda b: b[0]):
        while floats and floats[-1][0] < start:
            around.append(floats.pop())
        around = [f for f in around if f[1] > start]
        while scaled and scaled[-1][0] <= start:
            reach = max(reach, scaled.pop()[1])
        if start < first or end <= top:
            continue
        holders = [f for f in around if end < f[1]]
        if kind == "array" and not any(f[2].startswith("table") for f in holders):
            continue
        top = max(top, end)
        own = holders[0] if holders else None
        if own:
            i = bisect_left(sizes, (start, ""))
            size = sizes[i - 1][1] if i and sizes[i - 1][0] >= own[0] else None
        else:
            m = _SIZED.search(text[max(0, start - 200) : start])
            size = m[1] if m else None
        inner = bisect_left(scalers, body)
        out.append((start, end, body, body_end, env, kind, spec, width, bool(own) and own[2].endswith("*"), bool(own), reach >= end or (inner < len(scalers) and scalers[inner] < body_end), size))
    return out


def blocks(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, start, end, body_start, body_end, env, kind, spec, width, wide, in_float, scaled, size): the outermost display formulas and tables of whole
    texts, after \\begin{document} where there is one. Offsets are code points from 0. An array counts in a table's float only; what
    is not closed goes to the text's end; comments and literal text hold none. wide: in a starred float. scaled: within a command or environment
    that scales, or with one inside. size: the size switch in force. A null or empty text has none."""
    names = [f.split()[0] for f in BLOCKS[len("array<struct<") : -2].split(", ")]

    @F.pandas_udf(BLOCKS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, b, strict=True)) for b in find_blocks(x)] if x else [] for x in texts])

    return documents.select(key, F.explode(run(text)).alias("x")).select(key, "x.*")
