"""Scanning of Markdown and LaTeX.

Splitting a document into text and mathematics needs matching delimiters, escapes and nested environments, which no
regular expression states; `scan` does that in one pass over a text, in Arrow batches. All that follows (kinds, issues,
cleaning, symbols) is column expressions over the array of tokens: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.braces import calls, deep, inside
from quillon.functions.text import bound, collapse, normalize_unicode, outside, repair_escapes, strip, unicode_math

# Environments that are display mathematics by themselves, those that are so inside a formula, those that
# number their rows, those of rows, and those that align them.
STANDALONE = ("equation", "align", "gather", "multline", "alignat", "flalign", "eqnarray", "displaymath", "subequations")
INNER = ("split", "aligned", "gathered", "array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Vmatrix", "Bmatrix", "smallmatrix", "cases")
NUMBERED = ("equation", "align", "gather", "multline", "alignat", "flalign", "eqnarray")
DISPLAY_ENVS = STANDALONE + INNER

_OPENER = re.compile(r"```|`|\\\[|\\\(|\\begin\{([A-Za-z]+)(\*?)\}|\\.|\$\$?", re.S)
_CLOSER = {"\\[": "\\]", "\\(": "\\)", "$$": "$$", "$": "$"}
_CLOSE = {c: re.compile(re.escape(c) + r"|\\.", re.S) for c in _CLOSER.values()}
_NAMED = {"\\[": "\\[ display block", "\\(": "\\( inline block", "$$": "$$ display block", "$": "$ inline block"}
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
SCAN = "tokens:array<struct<kind:string,value:string,body:string,start:int,line:int,env:string>>,issues:array<struct<line:int,message:string>>"


def find_close(text: str, at: int, closer: str) -> int:
    """Where `closer` stands at or after `at`, escaped pairs skipped; -1 if nowhere."""
    return next((m.start() for m in _CLOSE[closer].finditer(text, at) if m[0] == closer), -1)


def find_end(text: str, at: int, name: str) -> tuple[int, int]:
    """Begin and end of the \\end that matches a \\begin{name} before `at`, nested ones of the name counted; (-1, -1) if none."""
    depth = 1
    for m in re.compile(r"\\(begin|end)\{" + re.escape(name) + r"\}").finditer(text, at):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return m.start(), m.end()
    return -1, -1


def spans(text: str, problems: list) -> Iterator[tuple[str, int, int, int, int, str | None]]:
    """(kind, begin, end, body's begin and end, env) of each formula of a text in order; what opens and never closes is added to problems, as its
    place and what is wrong."""
    at = 0
    while m := _OPENER.search(text, at):
        what, begin, at = m[0], m.start(), m.end()
        if what == "```" and begin and text[begin - 1] != "\n":
            what, at = "`", begin + 1
        if what[0] == "`":  # code is text, to its end
            end = text.find(what, at)
            at = end + len(what) if end >= 0 else len(text) if what == "```" else at
        elif m[1] and m[1] in DISPLAY_ENVS:
            _, end = find_end(text, at, m[1] + m[2])
            if end < 0:
                problems.append((begin, f"\\begin{{{m[1]}{m[2]}}} has no matching end"))
            else:
                yield "display", begin, end, begin, end, m[1]
                at = end
        elif what in _CLOSER:
            end = find_close(text, at, _CLOSER[what])
            if end < 0 or what == "$" and _BLANK_LINE.search(text, at, end):
                problems.append((begin, f"Unclosed {_NAMED[what]}"))
            else:
                stop = end + len(what)
                yield "display" if what in ("\\[", "$$") else "inline", begin, stop, at, end, None
                at = stop
        elif m[1]:  # any other environment: its head's first two characters are skipped like an escape
            at = begin + 2


def scan_text(text: str) -> tuple[list, list]:
    """Tokens (kind, value, body, start, line, env) and issues (line, message) of a text. What opens and never closes is text."""
    lines = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(lines, at - 1) + 1
    tokens, problems, done = [], [], 0
    for kind, begin, end, first, last, env in spans(text, problems):
        if begin > done:
            tokens.append(("text", text[done:begin], text[done:begin], done, line(done), None))
        tokens.append((kind, text[begin:end], text[first:last], begin, line(begin), env))
        done = end
    if done < len(text):
        tokens.append(("text", text[done:], text[done:], done, line(done), None))
    return tokens, [(line(at), message) for at, message in problems]


_TOKEN_TYPE = pa.struct([("kind", pa.string()), ("value", pa.string()), ("body", pa.string()), ("start", pa.int32()), ("line", pa.int32()), ("env", pa.string())])
_ISSUE_TYPE = pa.struct([("line", pa.int32()), ("message", pa.string())])


def lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Lists of structs from lists of tuples, column by column."""
    flat = [t for row in rows for t in row]
    columns = [pa.array([t[i] for t in flat], f.type) for i, f in enumerate(kind)]
    offsets = list(accumulate(map(len, rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def scan(text: Column) -> Column:
    """struct<tokens, issues> of a document. kind: text, inline or display; value: as written; body: without delimiters, but
    whole for environments; start: offset in code points; line: from 1. Null and empty texts have neither."""

    @F.arrow_udf(f"struct<{SCAN}>")
    def run(texts: pa.Array) -> pa.Array:
        found = [scan_text(x or "") for x in texts.to_pylist()]
        both = [lists([t for t, _ in found], _TOKEN_TYPE), lists([i for _, i in found], _ISSUE_TYPE)]
        return pa.StructArray.from_arrays(both, names=["tokens", "issues"])

    return run(text)


def tokenize(text: Column) -> Column:
    """The tokens of `scan`."""
    return scan(text)["tokens"]


# What is hidden before prose is looked for in a formula, in this order.
_GROUPS = (
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}"
    r"|\\(?:text|textrm|textbf|textit|textsf|texttt|mbox|mathrm|mathbf|mathit|mathsf|mathtt|operatorname|label|tag|ref|eqref|cite)\s*\*?\{[^{}]*\}"
)
_HIDDEN = _GROUPS + r"|\\[A-Za-z]+\*?|\\[^A-Za-z]"
# Names of operators that are set upright.
FUNCTIONS = "arcsin arccos arctan sinh cosh tanh sin cos tan sec csc cot log ln exp lim max min sup inf det gcd deg dim ker arg".split()
_HANGUL = "\uac00-\ud7a3\u3131-\u314e"


def escape_prose_in_math(c: Column) -> Column:
    """Prose in a formula as \\text{...}: parenthesised asides, Hangul, and two or more words in a row, but not `dx dy`."""
    aside = rf"[ \t]*\(\s*((?=[A-Za-z0-9{_HANGUL}\s,.'\"!?;:%\-]+\))(?:[^()]*(?:[{_HANGUL}]|[A-Za-z]{{2,}}[ \t]+[A-Za-z]{{2,}})[^()]*?))\s*\)"
    words = r"(?<![A-Za-z])(?!(?:d[A-Za-z][ \t]+)+d[A-Za-z](?![A-Za-z]|[ \t]+[A-Za-z]{2}))([A-Za-z]{2,}(?:[ \t]+[A-Za-z]{2,})+)"
    c = outside(c, _HIDDEN, lambda x: F.regexp_replace(x, aside, r" \\text{ ($1)}"))
    c = outside(c, _HIDDEN, lambda x: F.regexp_replace(x, rf"([{_HANGUL}](?:[{_HANGUL}0-9 \t,.]*[{_HANGUL}0-9,.])?)", r"\\text{$1}"))
    return outside(c, _HIDDEN, lambda x: F.regexp_replace(x, words, r"\\text{$1}"))


def upgrade_operator_names(c: Column) -> Column:
    """Bare names of operators as commands, but not in scripts or words."""
    name = r"(?<![A-Za-z\\])(?<![_^]\{?)(" + "|".join(FUNCTIONS) + ")(?![A-Za-z])"
    return outside(c, _HIDDEN, lambda x: F.regexp_replace(x, name, r"\\$1"))


# Greek commands, which a differential may be of.
GREEK = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega"
).split()


def space_differentials(c: Column) -> Column:
    """A thin space before the differentials of an integral."""
    operand = r"(?:(?<=[^\s{(\[,;:=+\-*/^_&<>|\\])(?<!\\[A-Za-z]{1,24}\*?)[ \t]+|(?<=[)}\]0-9]))"
    variable = r"((?:[A-Za-z]|\\(?:" + "|".join(GREEK) + r")(?![A-Za-z]))(?![A-Za-z0-9]))"
    spaced = lambda c: outside(c, _GROUPS, lambda x: F.regexp_replace(x, operand + "d" + variable, r"\\,d$1"))
    return bound(c, lambda c: F.when(c.rlike(r"\\(?:int|iint|iiint|oint)(?![A-Za-z])"), spaced(c)).otherwise(c))


def space_text_groups(c: Column) -> Column:
    """A space inside text groups where they touch an operand, as text mode keeps none outside."""
    word = rf"[A-Za-z{_HANGUL}]"
    c = F.regexp_replace(c, rf"(?<=[A-Za-z0-9)}}\]|!'])(\s*)\\(text|textrm|mbox)\{{(?={word}[^{{}}]*\}})", r"$1\\$2{ ")
    after = r"(?=\s*(?:[A-Za-z0-9(]|\\(?!(?:quad|qquad|text|textrm|mbox|end|label|tag|nonumber)(?![A-Za-z]))[A-Za-z]))"
    return F.regexp_replace(c, rf"\\(text|textrm|mbox)\{{([^{{}}]*{word})\}}{after}", r"\\$1{$2 }")


def normalize_vectors(c: Column, style: str = "boldsymbol") -> Column:
    """Every command for vectors as the chosen one, its argument braced; text groups stay. Braces nest up to twelve deep."""
    vector = rf"\\(?:vec|mathbf|boldsymbol|bm)(?![A-Za-z])\s*(?:{inside()}|(\\[A-Za-z]+|[A-Za-z0-9]))"
    groups = r"\\(?:text|textrm|textbf|textit|textsf|texttt|mbox)\s*\{[^{}]*\}"
    return outside(c, groups, lambda x: F.regexp_replace(x, vector, rf"\\{style}{{$1$2}}"))


def environments(c: Column) -> Column:
    """array<struct<name, start, stop, body>> of a text's outermost environments in order, up to one that does not end."""

    @F.pandas_udf("array<struct<name string, start int, stop int, body string>>")
    def run(texts: pd.Series) -> pd.Series:
        begin = re.compile(r"\\begin\{([A-Za-z]+\*?)\}")

        def one(x: str | None) -> list[dict]:
            out, at = [], 0
            while m := begin.search(x or "", at):
                end, at = find_end(x, m.end(), m[1])
                if end < 0:
                    break
                out.append({"name": m[1], "start": m.start(), "stop": at, "body": x[m.end() : end]})
            return out

        return texts.map(one)

    return run(c)


def has_rows(c: Column) -> Column:
    """Whether a formula has row breaks of its own, outside any environment."""
    inner = environments(c)
    outer = F.aggregate(inner, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), lambda s, e: F.struct(F.concat(s["text"], F.substring(c, s["at"] + 1, e["start"] - s["at"])).alias("text"), e["stop"].alias("at")))
    return F.concat(outer["text"], F.substring(c, outer["at"] + 1, F.length(c))).contains("\\\\")


# Names that a misspelt environment may mean, and those that are right as they are.
KNOWN_ENVS = (
    "equation align aligned gather gathered multline split cases dcases rcases matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix array subarray "
    "eqnarray flalign alignat alignedat subequations displaymath"
).split()
OTHER_ENVS = (
    "document itemize enumerate description figure table tabular tabularx longtable center flushleft flushright abstract proof theorem lemma corollary "
    "proposition definition remark example verbatim minipage quote quotation titlepage thebibliography algorithm algorithmic tikzpicture lstlisting comment "
    "frame block columns column subfigure wrapfigure appendix keywords acknowledgments acks IEEEkeywords figure* table* cases* split*"
).split()


def corrected_environments(names: DataFrame, column: str) -> DataFrame:
    """names with `corrected`: the one known environment a misspelt name is nearest to, null if it is right, too far or undecided."""
    from quillon.operators.relational import nearest_name

    bare = F.regexp_replace(column, r"\*\z", "")
    near = nearest_name(names.withColumn("_bare", bare), "_bare", KNOWN_ENVS, 2)
    right = F.col("_bare").isin(KNOWN_ENVS + OTHER_ENVS) | F.col(column).isin(OTHER_ENVS)
    close = (F.col("distance") <= F.when(F.length("_bare") >= 6, 2).otherwise(1)) & (F.col("ties") == 1)
    star = F.when(F.col(column).endswith("*"), "*").otherwise("")
    return near.select(*names.columns, F.when(~right & close, F.concat("nearest", star)).alias("corrected"))


def template(text: Column) -> Column:
    """The family of a paper's template, by its document class or a conference's package."""
    bare = strip_comments(text)
    name = F.trim(F.regexp_extract(bare, r"\\documentclass\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", 1))
    by_class = F.create_map(*[F.lit(x) for pair in (("IEEEtran", "ieee"), ("llncs", "lncs"), ("acmart", "acm"), ("sn-jnl", "nature")) for x in pair])
    package = bare.rlike(r"\\usepackage\s*(?:\[[^\]]*\])?\s*\{\s*neurips_\d{4}\s*\}")
    return F.coalesce(F.try_element_at(by_class, name), F.when(package, "neurips").otherwise("article"))


# Units in inches; widths of a column and of the text by layout.
UNITS = {"in": 1, "cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72.27, "bp": 1 / 72, "pc": 12 / 72.27, "em": 10 / 72.27, "ex": 4.3 / 72.27, "dd": 1238 / 1157 / 72.27, "px": 1 / 72}
LAYOUTS = {"two-column": (3.5, 7.16), "one-column": (6.5, 6.5)}


def length_in(spec: Column, line_width: Column, layout: str = "two-column") -> Column:
    """A TeX length in inches: a number of units, or a multiple of a line's, column's, text's or page's width; null if it is none."""
    bare, shape = F.regexp_replace(spec, r"\s+", ""), r"\A([+-]?(?:\d+\.?\d*|\.\d+))?\\?([A-Za-z]+)\z"
    column, text = LAYOUTS[layout]
    number = F.regexp_extract(bare, shape, 1)
    times = F.when(number == "", F.lit(1.0)).otherwise(number.try_cast("double"))
    unit = F.regexp_extract(bare, shape, 2)
    relative = F.when(unit.isin("linewidth", "hsize"), line_width).when(unit == "columnwidth", column).when(unit == "textwidth", text).when(unit == "paperwidth", 8.5)
    absolute = F.when(number != "", F.try_element_at(F.create_map(*[F.lit(x) for u, w in UNITS.items() for x in (u, float(w))]), unit))
    return F.when(bare.rlike(shape) & (times > 0), times * F.when(bare.contains("\\"), relative).otherwise(absolute))


def steps(c: Column, *each) -> Column:
    """The functions applied one after another, each evaluated once."""
    for f in each:
        c = bound(c, f)
    return c


# Commands whose argument is opaque to spacing; those after which a sign is an operation; signs of two characters.
_OPAQUE = (
    "text textrm textbf textit textsf texttt mbox mathrm mathbf mathit mathsf mathtt mathbb mathcal mathfrak boldsymbol operatorname label ref eqref tag cite href url "
    "hspace vspace color textcolor begin end"
).split()
_OPERANDS = (
    "mathrm mathbf mathit mathsf mathtt mathbb mathcal mathfrak boldsymbol infty hbar ell prime rangle rbrace rvert rVert rceil rfloor dots ldots cdots"
).split()
_DOUBLE = "<=|>=|!=|:=|=:|==+|->|<-|=>|<<|>>|--|[+][+]"


def space_operators(c: Column) -> Column:
    """One space around each + - = < > of a formula's lines that stands between operands (a relation: after anything), outside scripts and the
    arguments of opaque commands; runs of blanks inside a line are one space. Signs of one operand, a relation that begins a row and signs of
    two characters stay; & stays glued to its relation."""
    group = deep()
    unit = rf"(?s)\\(?:{'|'.join(_OPAQUE)})(?![A-Za-z])\*? *{group}|[_^][ \t]*{group}|\\(?:[A-Za-z]+\*?|.)|[ \t]+|{_DOUBLE}|."
    operand = rf"(?s)\A(?:[A-Za-z0-9.)\]}}|!']|[_^].*\}}|\\(?:{'|'.join(_OPERANDS + GREEK)})(?![A-Za-z]).*|\\[}}|])\z"

    def run(u: Column) -> Column:
        blank = lambda i: F.coalesce(F.get(u, i).rlike(r"\A[ \t]"), F.lit(False))
        before = lambda i: F.coalesce(F.get(u, F.when(blank(i - 1), i - 2).otherwise(i - 1)), F.lit("\n"))
        after = lambda i: F.coalesce(F.get(u, F.when(blank(i + 1), i + 2).otherwise(i + 1)), F.lit("\n"))
        relation = lambda x: x.isin("=", "<", ">")
        flags = F.transform(u, lambda x, i: F.when(relation(x), before(i) != "\n").when(x.isin("+", "-"), before(i).rlike(operand)).otherwise(False))

        def shown(f: Column) -> Column:
            spaced = lambda i: F.coalesce(F.get(f, i), F.lit(False))

            def one(x: Column, i: Column) -> Column:
                glued = F.coalesce(F.get(u, i - 1) == "&", F.lit(False))
                sign = F.concat(F.when(glued, "").otherwise(" "), x, F.when(after(i) == "\n", "").otherwise(" "))
                inner = (i > 0) & (i < F.size(u) - 1) & (F.coalesce(F.get(u, i - 1), F.lit("")) != "\n") & (F.coalesce(F.get(u, i + 1), F.lit("")) != "\n")
                gap = F.when(spaced(i - 1) | spaced(i + 1), "").when(inner, " ").otherwise(x)
                return F.when(spaced(i), sign).when(x.rlike(r"\A[ \t]"), gap).otherwise(x)

            return F.array_join(F.transform(u, one), "")

        return bound(flags, shown)

    return F.when(c.rlike("[-+=<>]|[ \t]{2}|\t"), bound(F.regexp_extract_all(c, F.lit(unit), F.lit(0)), run)).otherwise(c)


# Environments of rows, and those whose rows are aligned.
ROW_ENVS = "align aligned gather gathered split multline alignat flalign eqnarray cases array matrix pmatrix bmatrix vmatrix Vmatrix Bmatrix smallmatrix".split()
ANCHORED = "align aligned split alignat flalign eqnarray cases".split()


def with_anchor(line: Column) -> Column:
    """A row with & before its first relation = outside braces and brackets, unless it has one, begins with it, or = is part of another sign."""
    prefix = rf"\A((?>\\.|{deep()}|\[[^\[\]]*+\]|[^\\{{}}\[\]=&])++)(?<![<>!:=])=(?!=)"
    head = F.regexp_extract(line, prefix, 1)
    anchored = F.concat(F.regexp_replace(head, r"[ \t]+\z", ""), F.lit(" &"), F.substring(line, F.length(head) + 1, F.length(line)))
    return F.when((strip(head) != "") & ~line.contains("&"), anchored).otherwise(line)


def repair_rows(body: Column, anchored: Column) -> Column:
    """Rows one a line, each but the last with its break, and anchors where rows are aligned."""
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
    goes_on = r"(?:\\\\(?:\s*\*)?(?:\s*\[[^\]]*\])?|&|\{|\\begin\{[^}]*\}|\\end\{[^}]*\}|\\hline|\\cr)\s*\z"

    def run(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            aligned = F.when(anchored & ~x.rlike(r"\A\\(?:begin|end|hline|intertext|nonumber)(?![A-Za-z])"), with_anchor(x)).otherwise(x)
            done = (i == F.size(rows) - 1) | x.rlike(r"\A\\(?:begin|end|hline)(?![A-Za-z])") | x.rlike(goes_on)
            return F.when(done, aligned).otherwise(F.concat(aligned, F.lit(" \\\\")))

        return F.array_join(F.transform(rows, one), "\n")

    return bound(lines, run)


_WHOLE_ENV = r"(?s)\A\\begin\{([A-Za-z]+)(\*?)\}((?>(?!\\begin\{\1\2\}|\\end\{\1\2\}).)*+)\\end\{\1\2\}\z"


def render_env(formula: Column, starred: Column) -> Column:
    """A formula that is one environment: without its number if `starred` says so, its rows repaired."""
    name, star_, body = (F.regexp_extract(formula, _WHOLE_ENV, k) for k in (1, 2, 3))
    full = F.when(starred & name.isin(*NUMBERED), F.concat(name, F.lit("*"))).otherwise(F.concat(name, star_))
    rows = F.when(name.isin(*ROW_ENVS), repair_rows(body, name.isin(*ANCHORED))).otherwise(F.regexp_replace(body, r"\A\n+|\n+\z", ""))
    return F.concat(F.lit("\\begin{"), full, F.lit("}\n"), rows, F.lit("\n\\end{"), full, F.lit("}"))


def repair_nested(formula: Column) -> Column:
    """Rows of environments inside a formula repaired, where they are on several lines."""
    of = "|".join(ROW_ENVS)
    env = rf"\\begin\{{((?:{of})\*?)\}}(?>(?!\\(?:begin|end)\{{\1\}}).)*+\\end\{{\1\}}"
    pieces = F.regexp_extract_all(formula, F.lit(rf"(?s){env}|(?>(?!\\begin\{{(?:{of})\*?\}}).)++|\\"), F.lit(0))
    shape = r"(?s)\A(\\begin\{([A-Za-z]+)\*?\})(.*)(\\end\{[A-Za-z]+\*?\})\z"

    def one(x: Column) -> Column:
        body, name = F.regexp_extract(x, shape, 3), F.regexp_extract(x, shape, 2)
        fixed = F.concat(F.regexp_extract(x, shape, 1), F.lit("\n"), repair_rows(body, name.isin(*ANCHORED)), F.lit("\n"), F.regexp_extract(x, shape, 4))
        return F.when(x.rlike(rf"(?s)\A{env}\z") & strip(body).contains("\n"), fixed).otherwise(x)

    return F.when(formula.contains("\\begin{"), F.array_join(F.transform(pieces, one), "")).otherwise(formula)


def font_points(text: Column) -> Column:
    """The font size that a document's class options state, 10 by default."""
    options = F.regexp_extract(strip_comments(text), r"\\documentclass\s*\[([^\]]*)\]", 1)
    return F.coalesce(F.regexp_extract(options, r"(?:^|,)\s*(\d+(?:\.\d+)?)pt\s*(?:,|$)", 1).try_cast("double"), F.lit(10.0))


def detect_layout(text: Column) -> Column:
    """two10, one10 or one11: the columns that a document's class means, and its font size; two10 where there is no class."""
    bare, shape = strip_comments(text), r"\\documentclass\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}"
    options, name = F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2)
    two = ~bare.rlike(shape) | (name == "IEEEtran") | (name == "acmart") & options.rlike("sigconf|sigplan|sigchi") | options.contains("twocolumn")
    return F.when(two, "two10").when(options.contains("11pt"), "one11").otherwise("one10")


def clean_formula(body: Column) -> Column:
    """A formula's characters as LaTeX, escapes mended, prose set as text, operators upright and spaced, differentials and text spaced, no blanks at line ends."""
    if_ = lambda cue, f: lambda c: F.when(c.rlike(cue), f(c)).otherwise(c)  # noqa: E731 - a step only where it can change something
    return steps(
        body, if_(r"[^\x00-\x7f]|\)", unicode_math), repair_escapes, lambda c: F.regexp_replace(c, r"(?m)[ \t]+$", ""), if_(rf"[A-Za-z]{{2}}|[{_HANGUL}]", escape_prose_in_math),
        if_("|".join(FUNCTIONS), upgrade_operator_names), if_("int", space_differentials), if_(r"\\(?:text|mbox)", space_text_groups), space_operators, strip,
    )


def star(formula: Column) -> Column:
    """Numbering environments without their numbers."""
    return F.regexp_replace(formula, r"\\(begin|end)\{(" + "|".join(NUMBERED) + r")\}", r"\\$1{$2*}")


def clean(text: Column, mode: str = "standard") -> Column:
    """Formulas cleaned and delimiters normalised; then no blanks at line ends, runs of blank lines as one, ends trimmed.

    Inline formulas stand between $. Environments that are display mathematics by themselves are bare. Other display formulas, by mode: standard, on
    lines of their own between $$; academic, an equation, or align where they have rows; inline, between $. Numbering environments are starred, but
    not in a whole document, of which only the body is cleaned: it keeps its own numbers."""

    def emit(star_: Column):
        def one(x: Column) -> Column:
            def shown(f: Column) -> Column:
                name = F.regexp_extract(f, _WHOLE_ENV, 1)

                def other(b: Column) -> Column:
                    if mode == "inline":
                        return F.concat(F.lit("$"), collapse(b), F.lit("$"))
                    if mode == "standard":
                        return F.concat(F.lit("$$\n"), b, F.lit("\n$$"))
                    outer = F.regexp_replace(b, r"(?s)\\begin\{([A-Za-z]+\*?)\}(?>(?!\\(?:begin|end)\{\1\}).)*+\\end\{\1\}", "")
                    rows = (name == "") & outer.contains("\\\\")
                    kind = F.concat(F.when(rows, "align").otherwise("equation"), F.when(star_, "*").otherwise(""))
                    return F.concat(F.lit("\\begin{"), kind, F.lit("}\n"), F.when(rows, repair_rows(b, F.lit(True))).otherwise(b), F.lit("\n\\end{"), kind, F.lit("}"))

                inner = F.when(name != "", render_env(f, star_)).otherwise(repair_nested(f))
                display = F.when(name.isin(*STANDALONE), inner).otherwise(bound(inner, other))
                return F.when(x["kind"] == "display", display).otherwise(F.concat(F.lit("$"), collapse(f), F.lit("$")))

            return F.when(x["kind"] == "text", x["value"]).otherwise(bound(clean_formula(x["body"]), shown))

        return one

    normal = normalize_unicode(text)
    parts = document_parts(normal)
    star_ = ~(normal.contains("\\documentclass") & normal.contains("\\begin{document}"))
    body = bound(F.struct(tokenize(parts["body"]).alias("t"), star_.alias("s")), lambda p: F.array_join(F.transform(p["t"], emit(p["s"])), ""))
    out = F.concat(parts["preamble"], body, parts["rest"])
    return steps(out, lambda c: F.regexp_replace(c, r"(?m)[ \t]+$", ""), lambda c: F.regexp_replace(c, r"\n{3,}", "\n\n"), strip)


def clean_standard(text: Column) -> Column:
    """`clean` in the standard mode."""
    return clean(text)


def symbols(formula: Column) -> Column:
    """Distinct symbols of a formula in order: Latin letters outside commands and text groups, and Greek commands."""
    bare = F.regexp_replace(formula, r"\\(?:text|mathrm|operatorname|label|tag)\*?\{[^}]*\}", " ")
    found = F.regexp_extract_all(bare, F.lit(r"\\[A-Za-z]+|[A-Za-z]"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"\A(?:[A-Za-z]|\\(?:" + "|".join(GREEK) + r"))\z")))


# Environments whose text is literal, and commands whose argument is a piece of the document's set-up.
_LITERAL = r"\\begin\{(verbatim|lstlisting|minted|comment)(\*?)\}.*?\\end\{\1\2\}|\\verb\*?([^A-Za-z\s*]).*?\3"


def strip_comments(text: Column) -> Column:
    """Without comments (an unescaped % to the line's end); a line that is all comment goes with its newline. Literal text stays."""

    def change(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?m)^[ \t]*%[^\n]*(?:\n|\z)", "")
        return F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)%[^\n]*", "$1")

    cue = r"begin\{(?:verbatim|lstlisting|minted|comment)|verb"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){_LITERAL}|(?:[^\\]++|\\(?!{cue}))++|\\"), F.lit(0))
    apart = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(rf"(?s)\A(?:{_LITERAL})\z"), x).otherwise(change(x))), "")
    return F.when(~text.contains("%"), text).when(text.rlike(rf"\\(?:{cue})"), apart).otherwise(change(text))


def document_parts(text: Column) -> Column:
    """struct<preamble, body, rest>: around the \\begin{document} and \\end{document} of a whole document; body alone where there is none."""
    whole = r"(?s)\A(.*?\\begin\{document\})(.*?)(\\end\{document\}.*|\z)\z"
    is_whole = text.contains("\\documentclass") & text.contains("\\begin{document}")
    part = lambda i, other: F.when(is_whole, F.regexp_extract(text, whole, i)).otherwise(other)
    return F.struct(part(1, F.lit("")).alias("preamble"), part(2, text).alias("body"), part(3, F.lit("")).alias("rest"))


def macro_definitions(text: Column) -> Column:
    """array<struct<name, arity, body, preset, source>> of a text's \\newcommand, \\renewcommand, \\providecommand, \\def and \\DeclareMathOperator.

    preset: the text of a first argument that may be left out, null where none may. source: the definition, without blanks between its arguments. Bodies are of any depth; a definition that is not
    closed is none."""
    found = F.filter(calls(text, "newcommand|renewcommand|providecommand|def|edef|gdef|xdef|DeclareMathOperator", other=2), lambda x: x["name"].isNotNull())
    bare = lambda x: F.when(x.rlike(r"\A[{\[]"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)

    def one(x: Column) -> Column:
        args, last = x["args"], F.size(x["args"])
        options = F.filter(args, lambda a: a.startswith("["))
        body = bare(F.element_at(args, last))
        marks = F.when(x["name"].endswith("def"), F.size(F.filter(args, lambda a: a.startswith("#"))))
        return F.struct(
            F.regexp_extract(F.get(args, F.lit(0)), r"\A\{?\s*\\([A-Za-z]+)", 1).alias("name"),
            F.coalesce(marks, bare(F.get(options, F.lit(0))).try_cast("int"), F.lit(0)).alias("arity"),
            F.when(x["name"] == "DeclareMathOperator", F.concat(F.lit("\\operatorname{"), body, F.lit("}"))).otherwise(body).alias("body"),
            bare(F.get(options, F.lit(1))).alias("preset"), F.concat(F.lit("\\"), x["name"], F.array_join(args, "")).alias("source"),
        )

    return F.filter(F.transform(found, one), lambda m: m["name"] != "")


def commands_used(text: Column) -> Column:
    """Distinct names of commands in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\([A-Za-z]+)"), F.lit(1)))
