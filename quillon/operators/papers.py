"""Equations of whole papers, a document at a time: numbers, references and what uses what, without a shuffle.

A document's text holds all that its numbers depend on, so one scan in an Arrow batch reads its events and walks them in order. `equations`
states the same for events and equations that are rows (windows and as-of joins); tests compare the two.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import latex
from quillon.functions.braces import matches
from quillon.functions.text import WS

# Environments of rows that each may have a number.
ROWS = ("align", "gather", "alignat", "flalign", "eqnarray")
_BREAK = re.compile(r"\\\\\*?(?:\s*\[[^\]]*\])?|\\(begin|end)\{[A-Za-z]+\*?\}|\\.|[{}]", re.S)
# Stand for the begin and end of sub-equations, which are no part of a formula.
SUB_BEGIN, SUB_END = "\x02", "\x03"
_SHAPES = re.compile(rf"\\(chapter\s*[\[{{]|section\s*[\[{{]|appendix(?![A-Za-z]))|[{SUB_BEGIN}{SUB_END}]", re.A)
_TAG = re.compile(r"\\tag\*?\s*\{([^}]*)\}", re.A)
_NO_NUMBER = re.compile(r"\\(nonumber|notag)(?![A-Za-z])")
_LABEL = re.compile(r"\\label\s*\{([^}]*)\}", re.A)
_REF = re.compile(r"\\(?:eq)?ref\s*\{([^}]*)\}", re.A)
# The characters of WS.
SPACE = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(WS, c))


def cut_rows(body: str) -> list[str]:
    """Rows of an environment's body, at \\\\ outside braces and inner environments; an empty last row is none."""
    if "\\\\" not in body:
        return [body]
    ends, rows, done, depth, at = matches(body), [], 0, 0, 0
    while m := _BREAK.search(body, at):
        at = m.end()
        if m[0] == "{":
            at = ends.get(m.start(), at)
        elif m[1]:
            depth = max(0, depth + (1 if m[1] == "begin" else -1))
        elif m[0].startswith("\\\\") and not depth:
            rows.append(body[done : m.start()])
            done = at
    rows.append(body[done:])
    return rows[:-1] if len(rows) > 1 and not rows[-1].strip() else rows


def events(bare: str) -> list[tuple]:
    """(start, i, kind, tag, env, latex, labels) of a text without comments, in order: see `equations.extract`."""
    text = bare.replace(SUB_BEGIN, "").replace(SUB_END, "").replace("\\begin{subequations}", SUB_BEGIN).replace("\\end{subequations}", SUB_END)
    out, done = [], 0

    def marks(begin: int, end: int) -> None:
        for i, m in enumerate(_SHAPES.finditer(text, begin, end)):
            kind = "sub_begin" if m[0] == SUB_BEGIN else "sub_end" if m[0] == SUB_END else m[1].rstrip("[{ \t\n\r\f\v")
            out.append((begin, i, kind, None, None, None, ()))

    for kind, begin, end, first, last, env in latex.spans(text, []):
        if begin > done:
            marks(done, begin)
        done = end
        if kind != "display":
            continue
        star = False
        if env is not None:  # \begin{env} and \end{env}, either with a star
            star = text[begin + 7 + len(env)] == "*"
            first, last = begin + 8 + len(env) + star, end - 6 - len(env) - star
        inner = text[first:last]
        for i, row in enumerate(cut_rows(inner) if env in ROWS else (inner,)):
            tag = m[1].strip(SPACE) if "\\tag" in row and (m := _TAG.search(row)) and m[1] else None
            plain = env in latex.NUMBERED and not star and not ("\\no" in row and _NO_NUMBER.search(row))
            labels = tuple(k.strip(SPACE) for k in _LABEL.findall(row)) if "\\label" in row else ()
            out.append((begin, i, "equation" if plain or tag is not None else "unnumbered", tag, env, row, labels))
    if done < len(text):
        marks(done, len(text))
    return out


def _letters(n: int) -> str:
    high = (n - 1) // 26
    return (chr(96 + high) if high > 0 else "") + chr(97 + (n - 1) % 26)


def numbers(given: list[tuple], ways: tuple[str | None, ...]) -> list[tuple[str | None, ...] | None]:
    """The number of each event (None for what is no equation) by each way: section, chapter or None; see `equations.number_equations`."""
    chapters = any(e[2] == "chapter" for e in given)
    appendix = inside = False
    chapter = section = letter = 0
    count, base, out = [0] * len(ways), [""] * len(ways), []

    def top(n: int) -> str:
        return (_letters(n).upper() if n > 0 else "") if appendix else str(n)

    def number(k: int) -> str:
        if ways[k] == "chapter":
            before = (top(chapter) if chapters else str(chapter)) + "."
        elif ways[k] == "section":
            before = f"{chapter}.{section}." if chapters else top(section) + "."
        else:
            before = ""
        return before + str(count[k])

    for e in given:
        kind, tag, found = e[2], e[3], None
        if kind == "sub_begin":
            inside, letter = True, 0
            for k in range(len(ways)):
                count[k] += 1
                base[k] = number(k)
        elif kind == "sub_end":
            inside = False
        elif kind == "equation":
            if tag is not None:
                found = (tag,) * len(ways)
            elif inside:
                letter += 1
                found = tuple(b + _letters(letter) for b in base)
            else:
                count = [c + 1 for c in count]
                found = tuple(number(k) for k in range(len(ways)))
        elif kind == "unnumbered":
            found = (None,) * len(ways)
        else:
            if kind == "chapter":
                chapter, section = chapter + 1, 0
            elif kind == "section":
                section += 1
            else:
                appendix, chapter = True, 0
                section = section if chapters else 0
            count = [0 if kind == "chapter" and w or kind == "section" and w == "section" else c for w, c in zip(ways, count, strict=True)]
        out.append(found)
    return out


_KINDS = {"start": pa.int32(), "i": pa.int32(), "kind": pa.string(), "tag": pa.string(), "env": pa.string(), "latex": pa.string(), "labels": pa.list_(pa.string())}
_TYPES = {"start": "int", "i": "int", "labels": "array<string>"}


def event_list(text: Column) -> Column:
    """array<struct<start, i, kind, tag, env, latex, labels>> of a document with its comments; none of a null."""

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:{_TYPES.get(n, 'string')}" for n in _KINDS) + ">>")
    def run(texts: pa.Array) -> pa.Array:
        return latex.lists([events(x or "") for x in texts.to_pylist()], pa.struct(list(_KINDS.items())))

    return run(latex.strip_comments(text))


def numbered(documents: DataFrame, within: Column | str | None = None, *more: str, doc: str = "doc_id", text: str = "text", latex_too: bool = False) -> DataFrame:
    """(doc, n, kind, env, number, number_<way> for each of `more`) of the equations of each document, n from 1 in order, and their latex if
    wanted: `equations.number_equations` of `equations.extract`. within: a way, or a column with each document's."""
    names = ["kind", "env", *(["latex"] if latex_too else []), "number", *[f"number_{m}" for m in more]]

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    def run(texts: pa.Array, ways: pa.Array) -> pa.Array:
        out = []
        for x, way in zip(texts.to_pylist(), ways.to_pylist(), strict=True):
            found = events(x or "")
            each = zip(found, numbers(found, (way, *more)), strict=True)
            out.append([(e[2], e[4], *((e[5],) if latex_too else ()), *n) for e, n in each if n is not None])
        return latex.lists(out, pa.struct([(n, pa.string()) for n in names]))

    way = within if isinstance(within, Column) else F.lit(within).cast("string")
    rows = documents.select(F.col(doc).alias("doc"), F.posexplode(run(latex.strip_comments(F.col(text)), way)).alias("n", "e"))
    return rows.select("doc", (F.col("n") + 1).alias("n"), "e.*")


def resolved(documents: DataFrame, within: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, seq, key, text, ok) of every \\ref and \\eqref of each document, in order: the number of what it means there, once for each label
    of that name, ?? where no number answers: `equations.resolve_references`."""

    @F.arrow_udf("array<struct<seq:int,key:string,text:string,ok:boolean>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            asked = [k.strip(SPACE) for k in _REF.findall(x or "")]
            known: dict[str, list[str | None]] = {}
            if asked:
                found = events(x)
                for e, n in zip(found, numbers(found, (within,)), strict=True):
                    for k in e[6]:
                        known.setdefault(k, []).append(n[0])
            out.append([(i, k, "??" if n is None else n, n is not None) for i, k in enumerate(asked) for n in known.get(k, (None,))])
        return latex.lists(out, pa.struct([("seq", pa.int32()), ("key", pa.string()), ("text", pa.string()), ("ok", pa.bool_())]))

    return documents.select(F.col(doc).alias("doc"), F.explode(run(latex.strip_comments(F.col(text)))).alias("r")).select("doc", "r.*")
