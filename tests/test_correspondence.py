import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import correspondence as C

INPUT = "Here is the loss:\n\\[\nL(\\theta) = \\frac{1}{N} \\sum_i (y_i - f(x_i))^2\n\\]\nAlso, for alignment:\n$$\n\\begin{align}\na = b + c \\\\\nd = e + f\n\\end{align}\n$$\nAnd inline \\( E = mc^2 \\)."
BLOCKS = [
    (2, 4, "$$\nL(\\theta) = \\frac{1}{N} \\sum_i (y_i  -\n f(x_i))^2\n$$"), (6, 11, "\\begin{align*}\na &= b + c \\\\\nd &= e + f\n\\end{align*}"), (12, 12, "And inline $E = mc^2$."),
]
OUTPUT = "Here is the loss:\n" + BLOCKS[0][2] + "\nAlso, for alignment:\n" + BLOCKS[1][2] + "\n" + BLOCKS[2][2]


@pytest.fixture(scope="module")
def tables(spark):
    versions = spark.createDataFrame([(1, INPUT, OUTPUT), (2, "", "x"), (3, None, None)], "doc int, a string, b string")
    blocks = spark.createDataFrame([(1, i, *b) for i, b in enumerate(BLOCKS)] + [(2, 0, 1, 1, "not there")], "doc int, seq int, line int, end_line int, written string")
    return versions, C.block_segments(versions, blocks)


def mapped(spark, tables, side, text, needle):
    at = text.index(needle)
    ranges = spark.createDataFrame([(1, 7, at, at + len(needle))], "doc int, id int, start int, stop int")
    (r,) = C.map_ranges(ranges, tables[1], tables[0], side=side).collect()
    return r.exact, (OUTPUT if side == "a" else INPUT)[r.start : r.stop], r.kind


def test_segments_cover_both_texts(tables):
    rows = tables[1].orderBy("doc", "n").collect()
    assert [(r.doc, r.kind) for r in rows] == [(1, k) for k in ["gap", "block"] * 3 + ["gap"]] + [(2, "gap"), (3, "gap")]
    one = [r for r in rows if r.doc == 1]
    assert (one[0].a_start, one[0].b_start, one[-1].a_end, one[-1].b_end) == (0, 0, len(INPUT), len(OUTPUT))
    assert all((x.a_end, x.b_end) == (y.a_start, y.b_start) for x, y in zip(one, one[1:]))
    assert [OUTPUT[r.b_start : r.b_end] for r in one if r.kind == "block"] == [b[2] for b in BLOCKS]


def test_ranges(spark, tables):
    assert mapped(spark, tables, "a", INPUT, "\\frac{1}{N}") == (True, "\\frac{1}{N}", "block")
    assert mapped(spark, tables, "a", INPUT, "for alignment") == (True, "for alignment", "gap")
    assert mapped(spark, tables, "b", OUTPUT, "E = mc^2") == (True, "E = mc^2", "block")
    assert mapped(spark, tables, "a", INPUT, "(y_i - f(x_i))^2") == (True, "(y_i  -\n f(x_i))^2", "block")  # other white space
    exact, text, _ = mapped(spark, tables, "a", INPUT, "a = b + c")
    assert not exact and text == BLOCKS[1][2]  # rewritten: the whole block
    assert mapped(spark, tables, "a", INPUT, "\\[")[0] is False
    assert mapped(spark, tables, "a", INPUT, " \\).")[:2] == (False, BLOCKS[2][2])


def test_empty_targets_map_to_nothing(spark):
    versions = spark.createDataFrame([(1, "abc", "")], "doc int, a string, b string")
    ranges = spark.createDataFrame([(1, 0, 1, 2)], "doc int, id int, start int, stop int")
    (r,) = C.map_ranges(ranges, C.anchor_segments(versions), versions).collect()
    assert (r.exact, r.kind, r.start, r.stop) == (False, None, None, None)


def test_lines_of(spark):
    df = spark.createDataFrame([("a\nbb\nccc", 2, 7), ("a", 0, 0)], "t string, s int, e int")
    assert [tuple(r.o) for r in df.select(C.lines_of(df.t, df.s, df.e).alias("o")).collect()] == [(2, 3), (1, 1)]


def plain_rising(values):
    best = [[]]
    for v in values:
        best += [run + [v] for run in best if not run or run[-1] < v]
    return max(map(len, best))


def test_rising_is_longest():
    rnd = random.Random(1)
    for n in range(11):
        for _ in range(20):
            v = rnd.sample(range(20), n)
            found = [v[i] for i in C.rising(v)]
            assert found == sorted(found) and len(found) == plain_rising(v)


def test_anchors(spark):
    a = "one\ntwo\nsame\nsame\nthree\n  \nfour\nfive"
    b = "new\nfour\none\ntwo\nsame\nthree\n  \nfive\nlast"
    versions = spark.createDataFrame([(1, a, b), (2, "x", None)], "doc int, a string, b string")
    rows = C.anchor_segments(versions).where("doc = 1").orderBy("n").collect()
    assert [(a[r.a_start : r.a_end], b[r.b_start : r.b_end]) for r in rows if r.kind == "block"] == [("one\ntwo", "one\ntwo"), ("three", "three"), ("five", "five")]
    assert [(a[r.a_start : r.a_end], b[r.b_start : r.b_end]) for r in rows if r.kind == "gap"] == [("", "new\nfour\n"), ("\nsame\nsame\n", "\nsame\n"), ("\n  \nfour\n", "\n  \n"), ("", "\nlast")]
    assert C.anchor_segments(versions).where("doc = 2").select(F.count("*")).collect()[0][0] == 1
