"""Cleaning of whole texts in three modes: spacing of operators, rows and anchors, delimiters, whole documents."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import latex


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("o")).collect()[0][0]


SPACED = [
    ("a+  b=c", "a + b = c"), ("-x+(-1)", "-x + (-1)"), ("x^{-1}+y_{i+1}", "x^{-1} + y_{i+1}"), ("\\label{a-b}=c", "\\label{a-b} = c"), ("a<=b, c->d", "a<=b, c->d"), ("e^-x", "e^-x"), ("= b+c", "= b + c"), ("a &= b", "a &= b"),
    ("a &=b", "a &= b"), ("a=-b", "a = -b"), ("\\alpha-\\beta", "\\alpha - \\beta"), ("\\left(a-b\\right)", "\\left(a - b\\right)"), ("\\sin-x", "\\sin-x"), ("a\n  +b", "a\n  +b"), ("x  y\tz", "x y z"), ("a-\nb", "a -\nb"), ("{a+b}-1", "{a + b} - 1"),
    ("\\frac{a-b}{c}=\\mathrm{x-y}", "\\frac{a - b}{c} = \\mathrm{x-y}"), ("n!=m", "n!=m"), ("", ""),
]


def test_operators(spark):
    df = spark.createDataFrame(SPACED, "given string, want string").select("*", latex.space_operators(F.col("given")).alias("got"), latex.space_operators(F.col("want")).alias("again"))
    assert [(r.given, r.got, r.again) for r in df.collect()] == [(g, w, w) for g, w in SPACED]


ANCHORS = [("a = b", "a &= b"), ("= b", "= b"), ("a & = b", "a & = b"), ("a <= b", "a <= b"), ("x_{a=1} = b", "x_{a=1} &= b"), ("[a=b] = c", "[a=b] &= c"), ("\\= = c", "\\= &= c"), ("plain", "plain"), ("a == b", "a == b")]


def test_anchors(spark):
    df = spark.createDataFrame(ANCHORS, "given string, want string").select("*", latex.with_anchor(F.col("given")).alias("got"))
    assert [(r.given, r.got) for r in df.collect()] == ANCHORS


GAUSS = (
    "The integral, as typed:\n$$\n\\int_{-\\infty}^{\\infty} e^{-x**2} dx=√π\n$$\nholds for all $x∈ℝ$: $sin(x)²+cos(x)²=1$.\n\n$$\nf(x) = \\\\frac{1}{x} \\text{if} x>0, \\quad x\\_0=1\n$$",
    "The integral, as typed:\n<0>\n\\int_{-\\infty}^{\\infty} e^{-x^{2}}\\,dx = \\sqrt{\\pi}\n<1>\nholds for all $x\\in \\mathbb{R}$: $\\sin(x)^{2} + \\cos(x)^{2} = 1$.\n\n<0>\nf(x) = \\frac{1}{x} \\text{ if } x > 0, \\quad x_0 = 1\n<1>",
)
LOSS = (
    "First\n\\[\nL = (y_i - f(x_i))^2\n\\]\nthen:\n$$\n\\begin{align}\na = b + c \\\\\nd = e + f (some raw text here)\n\\end{align}\n$$\nand \\( E = mc^2 \\).",
    "First\n<0>\nL = (y_i - f(x_i))^2\n<1>\nthen:\n\\begin{align*}\na &= b + c \\\\\nd &= e + f \\text{ (some raw text here)}\n\\end{align*}\nand $E = mc^2$.",
)
MATRIX = (
    "$$\n\\begin{pmatrix}\na & b\nc & d\n\\end{pmatrix}\n\\begin{pmatrix} x \\\\ y \\end{pmatrix}\n=\n\\begin{pmatrix} e \\\\ f \\end{pmatrix}\n$$",
    "<0>\n\\begin{pmatrix}\na & b \\\\\nc & d\n\\end{pmatrix}\n\\begin{pmatrix} x \\\\ y \\end{pmatrix}\n=\n\\begin{pmatrix} e \\\\ f \\end{pmatrix}\n<1>",
)


@pytest.mark.parametrize("given, want", [GAUSS, LOSS, MATRIX], ids=["gauss", "loss", "matrix"])
def test_modes(spark, given, want):
    fill = lambda a, b: want.replace("<0>", a).replace("<1>", b)
    assert one(spark, latex.clean, given) == fill("$$", "$$")
    assert one(spark, lambda c: latex.clean(c, "academic"), given) == fill("\\begin{equation*}", "\\end{equation*}")
    inline = one(spark, lambda c: latex.clean(c, "inline"), given)
    assert "$$" not in inline and "equation" not in inline
    for mode in ("standard", "academic"):  # cleaning what is clean changes nothing
        done = one(spark, lambda c: latex.clean(c, mode), given)
        assert one(spark, lambda c: latex.clean(c, mode), done) == done


def test_rows_in_the_academic_mode(spark):
    assert one(spark, lambda c: latex.clean(c, "academic"), "\\[ a=b \\\\\nc=d \\]") == "\\begin{align*}\na &= b \\\\\nc &= d\n\\end{align*}"


def test_whole_documents_keep_their_numbers_and_preamble(spark):
    head, tail = "\\documentclass{article}\n\\newcommand{\\R}{$a+b$}\n\\begin{document}", "\\end{document} $x+y$"
    given = head + "\n\\begin{equation}\na+b \\label{k}\n\\end{equation}\nsee $c+d$\n" + tail
    assert one(spark, latex.clean, given) == head + "\n\\begin{equation}\na + b \\label{k}\n\\end{equation}\nsee $c + d$\n" + tail


def test_what_is_not_closed_stays(spark):
    text = "as $$\n(y - \\bar{y})^2\n\nand \\( b=c\n\nend."
    assert one(spark, latex.clean, text) == text
    assert one(spark, latex.clean, "`$a+b$` \\$5") == "`$a+b$` \\$5" and one(spark, latex.clean, None) == "" and one(spark, latex.clean, "") == ""


def test_long_formulas(spark):
    long = "a+b " * 20_000
    got = one(spark, latex.clean, f"\\[{long}\\] and $x_{{{'y' * 50_000}}}=z$")
    assert got.startswith("$$\na + b a + b") and got.endswith("} = z$")
