"""Brace groups of any depth and length, in every operator that reads them."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import braces, latex, text
from quillon.operators import bibliography, equations

LONG = "x" * 100_000
NESTED = "{" * 2_000 + "y" + "}" * 2_000
MANY = "{a}" * 50_000


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("o")).collect()[0][0]


def test_matches_and_cut():
    assert braces.cut(r"a{b{c}}\{d} e{") == [(False, "a"), (True, "{b{c}}"), (False, r"\{d} e{")]
    assert braces.cut("}{x}{") == [(False, "}"), (True, "{x}"), (False, "{")]
    assert braces.cut("{a{b}") == [(False, "{a"), (True, "{b}")]
    assert braces.cut("") == []
    big = "{" + "{z}" * 333_333 + "}"
    assert braces.cut(big) == [(True, big)]


def test_calls(spark):
    got = one(spark, lambda c: braces.calls(c, "vec|def", {"def": 2}), r"a \vec{x}+\vec y \\vec \def\q#1#2{a{b}#1} \vec[o]{p} \vec{open")
    assert [(r["before"], r["name"], r["args"]) for r in got] == [
        ("a ", "vec", ["{x}"]), ("+", "vec", ["y"]), (r" \\vec ", "def", [r"\q", "#1", "#2", "{a{b}#1}"]), (" ", "vec", ["[o]", "{p}"]), (r" \vec{open", None, []),
    ]
    assert one(spark, lambda c: braces.calls(c, "vec"), None) == []


@pytest.mark.parametrize("inner", [LONG, MANY, NESTED], ids=["long", "many", "nested"])
def test_entries_of_any_size(spark, inner):
    bib = f"@string{{s = {{{inner}}}}}\n@article{{k, abstract = {{{inner}}}, note = \"{inner}\", title = s # {{ t}}}}\n@misc{{m, title = {{T}}}}"
    got = bibliography.entries(spark.createDataFrame([(1, bib)], "f int, text string")).orderBy("seq").collect()
    assert [(r.type, r.key, sorted(r.fields)) for r in got] == [("article", "k", ["abstract", "note", "title"]), ("misc", "m", ["title"])]
    assert got[0].fields["abstract"] == inner and got[0].fields["note"] == inner and got[0].fields["title"] == inner + " t"


@pytest.mark.parametrize("inner", [LONG, MANY], ids=["long", "many"])
def test_no_operator_needs_a_stack(spark, inner):
    assert one(spark, lambda c: F.length(text.escape_specials(c)["value"]), "\\url{" + inner + "} $" + inner.replace("}", "]").replace("{", "[") + "$") > len(inner)
    assert one(spark, lambda c: text.protect_capitals(c)["count"], "{" + inner + "} BERT") == 1
    assert one(spark, lambda c: F.length(latex.normalize_vectors(c)), "\\vec{" + inner + "}") == len(inner) + len("\\boldsymbol{}")
    assert one(spark, lambda c: latex.macro_definitions(c)[0]["body"], "\\newcommand{\\a}[1]{" + inner + "}") == inner
    assert one(spark, equations.split_rows, "a {" + inner + " \\\\ } \\\\ b") == ["a {" + inner + " \\\\ } ", " b"]
    assert one(spark, lambda c: equations.relation(c)["right"], "a_{" + inner + "=} = " + "b") == "b"
    assert one(spark, lambda c: F.size(equations.named(c)), "\\mathbf{y} = {" + inner + "}") > 0
    assert one(spark, bibliography.normalize_authors, "{" + inner + "} and Ada B") == "{" + inner + "} and B, Ada"


def test_any_depth(spark):
    assert one(spark, lambda c: latex.macro_definitions(c)[0]["body"], "\\def\\a" + NESTED) == NESTED[1:-1]
    assert one(spark, equations.split_rows, NESTED + "\\\\ b") == [NESTED, " b"]
    assert one(spark, lambda c: equations.relation(c)["left"], NESTED + " = b") == NESTED


def test_macros_with_a_preset(spark):
    got = one(spark, latex.macro_definitions, r"\newcommand{\x}[2][d{e}]{#1+#2} \renewcommand*\y{z} \DeclareMathOperator*{\op}{op} \gdef\g#1#2{#2} \newcommand{\open}{")
    assert [tuple(m)[:4] for m in got] == [("x", 2, "#1+#2", "d{e}"), ("y", 0, "z", None), ("op", 0, "\\operatorname{op}", None), ("g", 2, "#2", None)]


def test_units_with_definitions(spark):
    macros = spark.createDataFrame([(1, 0, "a", r"\b+1", r"\newcommand{\a}{\b+1}"), (1, 1, "b", "x", r"\def\b{x}"), (1, 2, "c", "y", r"\def\c{y}"), (1, 3, "b", "z", r"\renewcommand{\b}{z}")], "doc int, ord int, name string, body string, source string")
    eqs = spark.createDataFrame([(1, 1, r" \a = 2 "), (1, 2, "q"), (2, 1, r"\a")], "doc int, seq int, latex string")
    got = sorted(map(tuple, equations.definition_units(eqs, macros).collect()))
    assert got == [(1, 1, "\\newcommand{\\a}{\\b+1}\n\\renewcommand{\\b}{z}\n\n\\a = 2"), (1, 2, "q"), (2, 1, r"\a")]


def problems(spark, bib):
    return [(r.line, r.key, r.message) for r in bibliography.parse_problems(spark.createDataFrame([(1, bib)], "f int, text string")).collect()]


def parsed(spark, bib):
    return [(r.type, r.key, dict(r.fields)) for r in bibliography.entries(spark.createDataFrame([(1, bib)], "f int, text string")).orderBy("seq").collect()]


def test_strings_and_months(spark):
    bib = '@string{jmlr = "Journal of Machine Learning Research"}\n@article{a,\n  title = "A " # {B {C}} # " D",\n  journal = jmlr, month = mar, year = 2020,\n  author = {X Y}\n}'
    assert parsed(spark, bib) == [("article", "a", {"title": "A B {C} D", "journal": "Journal of Machine Learning Research", "month": "March", "year": "2020", "author": "X Y"})]
    assert parsed(spark, '@misc{m, month = jan # "~1"}') == [("misc", "m", {"month": "January~1"})]


def test_unbalanced_entries_are_reported_and_survived(spark):
    bib = "@article{bad,\n  title = {Unclosed,\n@book{ok, title={Fine}, author={A B}, publisher={P}, year={2001}}\n"
    assert problems(spark, bib) == [(2, "bad", "Unbalanced braces in a field value - entry cut short here")]
    assert [e[1] for e in parsed(spark, bib)] == ["bad", "ok"]
    assert parsed(spark, '@misc(p, title = "T (x)", year = 1999)\n@misc{q, title = "open\n@misc{r, title = {R}}') == [("misc", "p", {"title": "T (x)", "year": "1999"}), ("misc", "q", {}), ("misc", "r", {"title": "R"})]


def test_other_problems(spark):
    bib = "junk\n@comment{keep}\n% note\n@ {x}\n@misc{m, title = nosuch, Title = {again} year = 3}\n@misc{, a b}\n@misc{z, title = {t}"
    assert problems(spark, bib) == [
        (1, "", "Text outside any entry was ignored"), (4, "", "Stray @ ignored"), (4, "", "Text outside any entry was ignored"),
        (5, "m", 'Undefined @string macro "nosuch" - kept as literal text'), (5, "m", 'Duplicate field "title" - first one kept'), (5, "m", 'Missing comma after field "title"'),
        (6, "", "Entry @misc has no cite key"), (6, "", 'Field "a" has no "= value" - skipped to the next entry'), (7, "z", "Entry is never closed"),
    ]
    kept = bibliography.scan(spark.createDataFrame([(1, bib), (2, None)], "f int, text string")).orderBy("f").select("bib.kept").collect()
    assert [r[0] for r in kept] == [["@comment{keep}", "% note"], []]


def test_names_of_formulas(spark):
    names = lambda x, numbered=False: one(spark, lambda c: equations.named(c, numbered), x)
    assert names(r"\mathbf{y} = W x_i + b_{crit}") == [r"\mathbf{y}", "W", "x", "b_{crit}"]
    assert names(r"\sum_{i=1}^{N} h_{t+1} \max_{q} a_{12} \text{if} \hat{y}") == ["h", "a", r"\hat{y}"]
    assert names(r"a_{12} + a_3", True) == ["a_{12}", "a_3"]
    assert names(r"\mathbf x \int_0^T f(t)\,dt") == ["x", "f", "t", "d"]


def test_defines_and_uses(spark):
    both = lambda x: tuple(one(spark, equations.defines_and_uses, x))
    assert both(r"\mathbf{y} = W x + b") == (r"\mathbf{y}", [r"\mathbf{y}"], ["W", "x", "b"])
    assert both(r"\hat{y} = f(x;\theta)") == (r"\hat{y}", [r"\hat{y}"], ["f", "x", r"\theta"])
    assert both(r"y \approx z") == ("y", ["y"], ["z"])
    assert both(r"p(x) := q \implies r = s") == ("p", ["p", "x"], ["x", "q", "r", "s"])
    assert both(r"a \leq b") == (None, [], ["a", "b"])
    assert both(r"a + b = c") == (None, ["a", "b"], ["a", "b", "c"])
