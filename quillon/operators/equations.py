"""Equations of documents as rows: extraction, numbering, references, and the graph of what defines what."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import latex
from quillon.functions.braces import cut, pieces
from quillon.functions.text import bound, strip
from quillon.operators import papers
from quillon.operators.papers import ROWS, SPACE, cut_rows  # noqa: F401
from quillon.operators.relational import asof_join, letters

def split_rows(body: Column) -> Column:
    """The rows of `cut_rows`; a null has one empty row."""

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([cut_rows(x or "") for x in bodies])

    return run(body)


def extract(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(events, labels) of documents: events(doc, seq, kind, tag, env, latex) as number_equations takes them, labels(doc, seq, key).

    Display formulas are equations, a row each in environments of rows; they are numbered unless the environment is starred
    or none that numbers, or the row says so. A tag is the number. Chapters, sections, the appendix, and where sub-equations begin and end
    come from the text between.
    """
    rows = documents.select(F.col(doc).alias("doc"), F.explode(papers.event_list(F.col(text))).alias("e"))
    seq = F.struct("e.start", "e.i").alias("seq")
    return rows.select("doc", seq, "e.kind", "e.tag", "e.env", "e.latex"), rows.select("doc", seq, F.explode("e.labels").alias("key"))


def counts_within(text: Column) -> Column:
    """Where a document's equation numbers start again: section or chapter, or null (through the whole). Said by \\numberwithin or
    \\counterwithin, by \\theequation, or by a class of books."""
    bare = latex.strip_comments(text)
    said = F.regexp_extract(bare, r"\\(?:number|counter)within\*?\s*\{equation\}\s*\{(\w+)\}", 1)
    shown = F.regexp_extract(bare, r"\\(?:re)?newcommand\*?\s*\{?\\theequation\}?\s*\{[^\n]*?\\the(section|chapter)(?![A-Za-z])", 1)
    book = bare.rlike(r"\\documentclass\s*(?:\[[^\]]*\])?\s*\{(?:book|report|scrbook|scrreprt|memoir)\}")
    found = F.when(said != "", said).when(shown != "", shown).when(book, "chapter")
    return F.when(found.isin("section", "chapter"), found)


def number_equations(events: DataFrame, within: bool | str | None = False, *more: str) -> DataFrame:
    """events(doc, seq, kind, tag) -> equations with their number.

    kind: chapter, section, appendix (from there on the topmost of these are letters, from A), equation, unnumbered, sub_begin and
    sub_end (around sub-equations: they share the number that is next at the begin, and have letters). A tag is the number and
    advances no counter. within: "section" (or True) or "chapter", where numbers start again and carry its number, by default
    nowhere; a column `within` of events says it for each document. `more` ways give columns number_<way> as well. The column env is kept
    where events have it. All windows are of one key and one order: one sort.
    """
    rule = F.col("within") if "within" in events.columns else F.lit("section" if within is True else within or None).cast("string")
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)

    def since(counted: Column, start: Column) -> tuple[Column, Column]:
        """Running count of `counted`, and what it was when `start` last held: their difference is the count since."""
        total = F.sum(F.when(counted, 1).otherwise(0)).over(w)
        return total, F.when(start, total)

    def from_last(e: DataFrame, name: str, counted: Column, start: Column) -> DataFrame:
        total, at = since(counted, start)
        e = e.withColumn(name, total).withColumn("_at", at)
        return e.withColumn(name, F.col(name) - F.coalesce(F.max("_at").over(w), F.lit(0))).drop("_at")

    kept = [c for c in ("env",) if c in events.columns]
    e = events.select("doc", "seq", "kind", "tag", *kept, rule.alias("_rule"))
    e = e.withColumn("_chapters", F.max(is_("chapter")).over(Window.partitionBy("doc"))).withColumn("_appendix", F.max(is_("appendix")).over(w))
    e = e.withColumn("_in_sub", F.last(F.when(is_("sub_begin", "sub_end"), is_("sub_begin")), ignorenulls=True).over(w))
    e = from_last(e, "_chapter", is_("chapter"), is_("appendix"))
    e = from_last(e, "_section", is_("section"), is_("chapter") | (is_("appendix") & ~F.col("_chapters")))
    inside, plain = F.coalesce("_in_sub", F.lit(False)), is_("equation") & F.col("tag").isNull()
    e = from_last(e, "_letter", plain & inside, is_("sub_begin"))
    top = lambda n: F.when(F.col("_appendix"), F.when(n > 0, F.upper(letters(n))).otherwise("")).otherwise(n.cast("string"))
    chapter, section = F.col("_chapter"), F.col("_section")
    out = {}
    for name, way in {"number": F.col("_rule"), **{f"number_{m}": F.lit(m) for m in more}}.items():
        e = from_last(e, "_n", is_("sub_begin") | (plain & ~inside), (is_("chapter") & way.isNotNull()) | (is_("section") & way.eqNullSafe("section")))
        prefix = (
            F.when(way == "chapter", F.concat(F.when(F.col("_chapters"), top(chapter)).otherwise(chapter.cast("string")), F.lit(".")))
            .when(way == "section", F.when(F.col("_chapters"), F.concat_ws(".", chapter, section, F.lit(""))).otherwise(F.concat(top(section), F.lit("."))))
            .otherwise("")
        )
        e = e.withColumn("_number", F.concat(prefix, F.col("_n").cast("string")))
        e = e.withColumn("_base", F.last(F.when(is_("sub_begin"), F.col("_number")), ignorenulls=True).over(w))
        number = F.when(inside, F.concat("_base", letters(F.col("_letter")))).otherwise(F.col("_number"))
        e = e.withColumn(name, F.when(is_("equation"), F.coalesce("tag", number)))
        out[name] = F.col(name)
    return e.where("kind in ('equation', 'unnumbered')").select("doc", "seq", "kind", *out, *kept)


def resolve_references(references: DataFrame, labels: DataFrame) -> DataFrame:
    """references(doc, seq, key) with labels(doc, key, number) -> the text of each reference, ?? where no label answers."""
    return references.join(labels, ["doc", "key"], "left").select("doc", "seq", "key", F.coalesce("number", F.lit("??")).alias("text"), F.col("number").isNotNull().alias("ok"))


def references(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, seq, key) of every \\ref and \\eqref, in order."""
    keys = F.regexp_extract_all(latex.strip_comments(F.col(text)), F.lit(r"\\(?:eq)?ref\s*\{([^}]*)\}"), F.lit(1))
    return documents.select(F.col(doc).alias("doc"), F.posexplode(keys).alias("seq", "key")).select("doc", "seq", strip(F.col("key")).alias("key"))


# Signs that define what stands left of them, and the character pairs in which = is part of another sign.
DEFINING = ("approx", "equiv", "propto", "simeq", "coloneqq", "triangleq")
_OTHER = r"[<>!]=|=[=:>]"


def relation(formula: Column) -> Column:
    """struct<left, right>: the sides of a formula's first defining sign outside braces (=, := or one of DEFINING); right null if there is none."""
    sign = r"&?:?=|&?\\(?:" + "|".join(DEFINING) + r")(?![A-Za-z])"
    parts = F.flatten(F.transform(pieces(formula), lambda p: F.when(p["group"], F.array(p["text"])).otherwise(F.regexp_extract_all(p["text"], F.lit(rf"(?s){_OTHER}|{sign}|\\[A-Za-z]+|\\.|."), F.lit(0)))))

    def cut(p: Column) -> Column:
        at = F.array_position(F.transform(p, lambda x: x.rlike(rf"\A(?:{sign})\z")), F.lit(True)).cast("int")
        join = lambda a, n: strip(F.array_join(F.slice(p, a, F.greatest(n, F.lit(0))), ""))
        return F.struct(F.when(at > 0, join(F.lit(1), at - 1)).otherwise(strip(formula)).alias("left"), F.when(at > 0, join(at + 1, F.size(p) - at)).alias("right"))

    return bound(parts, cut)


# Fonts and accents that are part of a name; commands that name nothing; subscripts that are places in a sequence.
DRESS = "mathbf boldsymbol bm mathcal mathbb hat bar tilde vec dot ddot".split()
NAMELESS = (
    "frac dfrac tfrac sqrt sum prod int oint lim left right big Big bigg Bigg approx implies iff to cdot times div pm mp le leq ge geq ne neq "
    "equiv sim propto in notin subset subseteq cup cap infty partial nabla quad qquad text textrm mathrm operatorname label tag nonumber "
    "begin end exp log ln sin cos tan max min arg det sup inf mid vert lvert rvert lVert rVert langle rangle ldots cdots dots displaystyle "
    "underbrace overbrace hspace top prime coloneqq triangleq forall exists simeq Rightarrow"
).split()
PLACES = r"[ijklmnt](?:\s*[+-]\s*\d+|,\s*[ijklmnt])?"
_SUBSCRIPT = r"\s*_\s*(?:\{[^{}]*\}|[A-Za-z0-9])"
_LIMITS = r"(?>\s*[_^]\s*(?:\{[^{}]*\}|[A-Za-z0-9]))*+"
_BASE = rf"\\(?:{'|'.join(DRESS)})\s*\{{[^{{}}]+\}}|\\[A-Za-z]+|[A-Za-z]"


def named(formula: Column, numbered: bool = True) -> Column:
    """Distinct names of a formula in order: letters and commands with their fonts and accents, and with subscripts that are no place in a
    sequence (x_i and h_{t+1} are x and h). Limits of operators, text groups and labels name nothing. A subscript of digits tells
    names apart if `numbered`, else it is a place too."""
    bare = F.regexp_replace(formula, r"\\(?:text|textrm|mathrm|operatorname|label|tag|ref|eqref)\s*\*?\{[^{}]*\}", " ")
    bare = F.regexp_replace(bare, rf"\\(?:{'|'.join(NAMELESS)})(?![A-Za-z]){_LIMITS}|\\(?:{'|'.join(DRESS)})(?![A-Za-z])(?!\s*\{{[^{{}}]+\}}){_LIMITS}", " ")
    place = PLACES if numbered else rf"{PLACES}|\d+"

    def one(x: Column) -> Column:
        sub = F.regexp_extract(x, r"_\s*\{?([^{}]*)\}?\z", 1)
        base = F.regexp_replace(F.regexp_extract(x, rf"\A(?:{_BASE})", 0), r"\s+", "")
        own = F.regexp_replace(sub, r"\s+", "")
        return F.when((own == "") | F.trim(sub).rlike(rf"\A(?:{place})\z"), base).when(F.length(own) == 1, F.concat(base, F.lit("_"), own)).otherwise(F.concat(base, F.lit("_{"), own, F.lit("}")))

    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(rf"(?:{_BASE})(?:{_SUBSCRIPT})?"), F.lit(0)), one))


def defines_and_uses(formula: Column, numbered: bool = True) -> Column:
    """struct<defines, left, uses> of a formula up to its first break or implication: the name that its left side is (of a function, its own),
    all names left of the first defining sign, and the others. Without such a sign nothing is defined."""
    first = F.regexp_extract(formula, r"(?s)\A(.*?)(?:\\implies|\\Rightarrow|\\\\|\\q?quad|\z)", 1)

    def of(r: Column) -> Column:
        side = F.regexp_replace(F.regexp_replace(r["left"], r"\([^()]*\)\z", ""), r"\A[&\s]+|[\s&]+\z", "")
        is_name = r["right"].isNotNull() & side.rlike(rf"\A(?:{_BASE})(?:{_SUBSCRIPT})?\z")
        none = F.array().cast("array<string>")
        left = F.when(r["right"].isNotNull(), named(r["left"], numbered)).otherwise(none)
        defines = F.when(is_name, F.get(named(side, numbered), F.lit(0)))
        gone = F.when(is_name, F.array(defines)).otherwise(none)
        return F.struct(defines.alias("defines"), left.alias("left"), F.array_except(named(formula, numbered), gone).alias("uses"))

    return bound(relation(first), of)


_PARTS = re.compile(rf"(?s)(?:{_OTHER})|(&?:?=|&?\\(?:{'|'.join(DEFINING)})(?![A-Za-z]))|\\[A-Za-z]+|\\.|[^<>!=:&\\]+|.")
_STOP = re.compile(r"\\implies|\\Rightarrow|\\\\|\\q?quad")
_TEXTS = re.compile(r"\\(?:text|textrm|mathrm|operatorname|label|tag|ref|eqref)\s*\*?\{[^{}]*\}", re.A)
_NO_NAME = re.compile(rf"\\(?:{'|'.join(NAMELESS)})(?![A-Za-z]){_LIMITS}|\\(?:{'|'.join(DRESS)})(?![A-Za-z])(?!\s*\{{[^{{}}]+\}}){_LIMITS}", re.A)
_NAME = re.compile(rf"(?:{_BASE})(?:{_SUBSCRIPT})?", re.A)
_ONLY_BASE, _SUB = re.compile(_BASE, re.A), re.compile(r"_\s*\{?([^{}]*)\}?\Z", re.A)
_PLACE, _BLANKS = re.compile(PLACES, re.A), re.compile(r"\s+", re.A)
_CALLED, _ENDS = re.compile(r"\([^()]*\)\Z"), re.compile(r"\A[&\s]+|[\s&]+\Z", re.A)


@lru_cache(4096)
def _name(x: str) -> str:
    base, sub = _BLANKS.sub("", _ONLY_BASE.match(x)[0]), m[1] if (m := _SUB.search(x)) else ""
    own = _BLANKS.sub("", sub)
    if not own or _PLACE.fullmatch(sub.strip(" ")):
        return base
    return f"{base}_{own}" if len(own) == 1 else f"{base}_{{{own}}}"


def names_of(formula: str) -> list[str]:
    """`named` of one formula."""
    return list(dict.fromkeys(map(_name, _NAME.findall(_NO_NAME.sub(" ", _TEXTS.sub(" ", formula))))))


def defined_and_used(formula: str) -> tuple[str | None, list[str]]:
    """`defines` and `uses` of `defines_and_uses` for one formula."""
    first = formula[: m.start()] if (m := _STOP.search(formula)) else formula
    at, left, defines = 0, None, None
    for group, part in cut(first) if "{" in first else ((False, first),):
        if not group and (m := next((m for m in _PARTS.finditer(part) if m[1]), None)):
            left = first[: at + m.start()].strip(SPACE)
            break
        at += len(part)
    uses = names_of(formula)
    if left is not None:
        side = _ENDS.sub("", _CALLED.sub("", left))
        if _NAME.fullmatch(side):
            defines = next(iter(names_of(side)), None)
            uses = [u for u in uses if u != defines]
    return defines, uses


def graph(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, src, dst, symbol): the edges of `formula_graph` over the equations of each document, which are numbered from 1 in order. One pass over
    each text: the last definition of a symbol is what its next use refers to."""

    @F.arrow_udf("array<struct<src:int,dst:int,symbol:string>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            last, edges = {}, []
            for n, formula in enumerate((e[5] for e in papers.events(x or "") if e[5] is not None), 1):
                defines, uses = defined_and_used(formula)
                edges += [(last[u], n, u) for u in uses if u in last]
                if defines is not None:
                    last[defines] = n
            out.append(edges)
        return latex.lists(out, pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("symbol", pa.string())]))

    return documents.select(F.col(doc).alias("doc"), F.explode(run(latex.strip_comments(F.col(text)))).alias("e")).select("doc", "e.*")


def formula_graph(equations: DataFrame) -> DataFrame:
    """equations(doc, seq, latex) -> edges (doc, src, dst, symbol): equation dst uses a symbol that src, the last before it that does, defines.

    An as-of join by (doc, symbol): one window over definitions and uses. Edges go forward only, so the graph has no cycle.
    """
    e = equations.select("doc", "seq", defines_and_uses(F.col("latex")).alias("d"))
    uses = e.select("doc", "seq", F.explode("d.uses").alias("symbol"))
    definitions = e.where("d.defines is not null").select("doc", "seq", F.col("d.defines").alias("symbol"), F.col("seq").alias("src"))
    found = asof_join(uses, definitions, ["doc", "symbol"], "seq", "src").where("src < seq")
    return found.select("doc", "src", F.col("seq").alias("dst"), "symbol")


def _used(text: str | None) -> list[str]:
    return re.findall(r"\\([A-Za-z]+)", text or "")


def _reached(formula: str | None, calls: dict[str, list[str]]) -> set[str]:
    """Names of `calls` that a formula needs: those it uses, and those that they use."""
    waiting, seen = [n for n in _used(formula) if n in calls], set()
    while waiting:
        name = waiting.pop()
        if name not in seen:
            seen.add(name)
            waiting += [n for n in calls[name] if n in calls]
    return seen


def with_definitions(equations: DataFrame, macros: DataFrame) -> DataFrame:
    """equations(doc, seq, latex) with macros(doc, name, body) -> doc, seq, names: the macros that an equation needs, those
    included that its macros use themselves, sorted. The macros of a document are one row beside its equations: one shuffle by document."""

    @F.arrow_udf("array<string>")
    def run(formulas: pa.Array, macros: pa.Array) -> pa.Array:
        out = []
        for formula, given in zip(formulas.to_pylist(), macros.to_pylist(), strict=True):
            calls: dict[str, list[str]] = {}
            for m in given:
                calls.setdefault(m["name"], []).extend(_used(m["body"]))
            out.append(sorted(_reached(formula, calls)))
        return pa.array(out, pa.list_(pa.string()))

    listed = macros.where("name is not null").groupBy("doc").agg(F.collect_list(F.struct("name", "body")).alias("_m"))
    rows = equations.join(listed, "doc").select("doc", "seq", run("latex", "_m").alias("names"))
    return rows.groupBy("doc", "seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")).where("size(names) > 0")


def definition_units(equations: DataFrame, macros: DataFrame) -> DataFrame:
    """equations(doc, seq, latex) with macros(doc, ord, name, body, source) -> doc, seq, unit: the definitions that an equation needs, in their
    order, then a blank line and the equation; it alone where it needs none. Of a name that is defined twice the last definition counts."""

    @F.arrow_udf("string")
    def run(formulas: pa.Array, macros: pa.Array) -> pa.Array:
        out = []
        for formula, given in zip(formulas.to_pylist(), macros.to_pylist(), strict=True):
            last: dict[str, dict] = {}
            for m in given or ():
                last.pop(m["name"], None)  # a later one stands in its own place
                last[m["name"]] = m
            needed = _reached(formula, {n: _used(m["body"]) for n, m in last.items()})
            out.append("\n".join(m["source"] for n, m in last.items() if n in needed) if needed else None)
        return pa.array(out, pa.string())

    listed = macros.where("name is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "body", "source"))).alias("_m"))
    rows = equations.join(listed, "doc", "left").select("doc", "seq", "latex", run("latex", "_m").alias("_d"))
    whole = F.when(F.col("_d").isNotNull(), F.concat("_d", F.lit("\n\n"), strip(F.col("latex")))).otherwise(strip(F.col("latex")))
    return rows.select("doc", "seq", whole.alias("unit"))
