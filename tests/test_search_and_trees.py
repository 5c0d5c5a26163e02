import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import derivations, equations, search, venues


def numbers(spark, text, within=None):
    events, _ = equations.extract(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    if within is None:
        events = events.join(spark.createDataFrame([(1, text)], "doc int, text string").select("doc", equations.counts_within(F.col("text")).alias("within")), "doc")
    found = equations.number_equations(events, within or False)
    return [r.number for r in found.orderBy("seq").collect()]


def eq(x):
    return f"\\begin{{equation}} {x} \\end{{equation}}"


def test_sub_equations(spark):
    paper = eq("a") + "\\section{M}\\begin{align} a &= b \\\\ c &= d \\nonumber \\\\ e &= f \\tag{$\\star$} \\\\ g &= h \\end{align}\n\\begin{subequations}\n" + eq("p") + eq("q \\tag{T}") + eq("r") + "\\end{subequations} $$z$$" + eq("s")
    assert numbers(spark, paper) == ["1", "2", None, "$\\star$", "3", "4a", "T", "4b", None, "5"]


def test_numbers_within_sections(spark):
    paper = "\\documentclass{article}\\numberwithin{equation}{section}\\begin{document}\\section{A}" + eq("a") + "\\section*{S}\\section{B}" + eq("b") + "\\begin{subequations}" + eq("x") + eq("y") + "\\end{subequations}\\appendix\\section{X}" + eq("c")
    assert numbers(spark, paper) == ["1.1", "2.1", "2.2a", "2.2b", "A.1"]


def test_chapters(spark):
    paper = "\\documentclass[11pt]{book}\\chapter{A}" + eq("a") + "\\section{S}" + eq("b") + "\\chapter{B}" + eq("c") + "\\appendix\\chapter{X}" + eq("d") + "\\chapter{Y}" + eq("e")
    assert numbers(spark, paper) == ["1.1", "1.2", "2.1", "A.1", "B.1"]
    assert numbers(spark, paper, "section") == ["1.0.1", "1.1.1", "2.0.1", "1.0.1", "2.0.1"]
    assert numbers(spark, eq("a") + "\\section{S}" + eq("b"), "chapter") == ["0.1", "0.2"]


def test_where_numbers_start_again(spark):
    texts = [
        ("\\renewcommand{\\theequation}{\\thesection.\\arabic{equation}}", "section"), ("\\counterwithin*{equation}{chapter}", "chapter"), ("\\documentclass{report}", "chapter"),
        ("% \\numberwithin{equation}{section}", None), ("\\numberwithin{equation}{subsection}", None), ("", None),
    ]
    df = spark.createDataFrame(texts, "t string, want string")
    assert all(r.o == r.want for r in df.select("want", equations.counts_within(F.col("t")).alias("o")).collect())


EQUATIONS = [
    (1, 0, "L(\\theta) = \\norm{y}", "We minimise the  loss below", ["eq:loss"], ["1"]), (1, 1, "a = b \\label{eq:a}", "next", ["eq:A", "x"], ["2", "3"]), (1, 2, "p = 1", None, [], ["4a"]),
    (2, 0, "\\hat\\theta = q", "the hat", None, None), (2, 1, "", "loss of the minimise run", [], ["10"]),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(EQUATIONS, "doc int, idx int, latex string, context string, labels array<string>, numbers array<string>")
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.write_index(df, path, buckets=8)
    return spark.read.parquet(path), df


def plain(query):
    """Every equation looked at."""
    q, number, words = search.parse_query(query)
    out = []
    for doc, idx, latex, context, labels, nums in EQUATIONS:
        b, c, ls = " ".join(latex.lower().split()), " ".join((context or "").lower().split()), [x.lower() for x in labels or []]
        if not q:
            out.append((doc, idx, 0))
        elif q in ls:
            out.append((doc, idx, 100))
        elif number and number in [n.lower() for n in nums or []]:
            out.append((doc, idx, 90))
        elif any(q in x for x in ls):
            out.append((doc, idx, 60))
        elif q in b:
            out.append((doc, idx, 55 if b.startswith(q) else 50))
        elif q in c:
            out.append((doc, idx, 30))
        elif words and all(w in b or w in c for w in words):
            out.append((doc, idx, 15))
    return sorted(out)


@pytest.mark.parametrize("query", ["eq:loss", "EQ:a", "(3)", "eq. 1", "Eq 4b", "Eq 4a", "\\hat\\theta", "minimise", "loss minimise", "a", "th", "= ", "zzzz", "", "eq:", "equation (10)", "the  loss", "e", "1"])
def test_search(index, query):
    got = sorted((r.doc, r.idx, r.score) for r in search.search(*index, query, buckets=8).collect())
    assert got == plain(query)


def test_a_query_reads_its_buckets_only(index):
    plan = search.search(*index, "minimise", buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def walk(edges, tops, most):
    """Depth first, each step expanded where it is met first."""
    below, shown, out = {}, set(), []
    for s, d, o in sorted(edges, key=lambda x: x[2]):
        below.setdefault(s, []).append((o, d))

    def go(node, parent, path):
        ref = node in shown
        shown.add(node)
        out.append((tuple(path), parent, node, len(path) - 1, ref))
        if not ref and (most is None or len(path) <= most):
            for o, d in sorted(below.get(node, [])):
                go(d, node, [*path, o])

    for t in sorted(tops):
        go(t, None, [t])
    return out


@pytest.mark.parametrize("most", [None, 1, 2, 3, 8])
def test_top_down(spark, most):
    rnd = random.Random(most or 0)
    docs = {}
    for doc in range(6):
        edges = []
        for s in range(9):
            targets = rnd.sample(range(s + 1, 12), rnd.randint(0, 3))
            edges += [(s, d, o) for o, d in enumerate(targets)]
        docs[doc] = edges
    rows = [(doc, *e) for doc, edges in docs.items() for e in edges]
    got = derivations.top_down(spark.createDataFrame(rows, "doc int, src int, dst int, ord int"), max_depth=most).collect()
    for doc, edges in docs.items():
        tops = {s for s, _, _ in edges} - {d for _, d, _ in edges}
        want = walk(edges, tops, most)
        assert sorted((tuple(r.path), r.parent, r.node, r.depth, r.ref) for r in got if r.doc == doc) == sorted(want, key=lambda x: x[0])


def test_cycles_are_an_error(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 1, 0)], "doc int, src int, dst int, ord int")
    tops = spark.createDataFrame([(1, 0, 0)], "doc int, node int, ord int")
    assert [tuple(r.path) for r in derivations.top_down(edges, tops, 8).orderBy("path").collect()] == [(0,), (0, 0), (0, 0, 0), (0, 0, 0, 0)]  # the second 1 is a reference


def test_venues(spark):
    names = [
        "NIPS", "Advances in Neural Information Processing Systems 33 (NeurIPS)", "Proceedings of the 37th International Conference on Machine Learning", "J. Mach. Learn. Res.", "CVPR", "IEEE Trans. Pattern Anal. Mach. Intell.",
        "Journal of Applied Widget Science", "Annals of the Royal Academy & Society", "Widgets", "Journal of Foo", "The New England Journal of Medicine", "Nature", None, "", "Proc. ICML '19", "(Physics) Review: Letters.",
    ]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "i int, name string, iso4 string")
    got = {r.i: r.venue for r in venues.with_venue(df, "name").collect()}
    assert [got[i] for i in range(len(names))] == [
        "Adv. Neural Inf. Process. Syst. (NeurIPS)", "Adv. Neural Inf. Process. Syst. (NeurIPS)", "Proc. Int. Conf. Mach. Learn. (ICML)", "J. Mach. Learn. Res.", "Proc. IEEE/CVF Conf. Comput. Vis. Pattern Recognit. (CVPR)",
        "IEEE Trans. Pattern Anal. Mach. Intell.", "J. Appl. Widget Sci.", "Ann. R. Acad. Soc.", "Widgets", "J. Foo", "N. Engl. J. Med.", "Nature", None, "", "Proc. Int. Conf. Mach. Learn. (ICML)", "(Phys.) Rev.: Lett.",
    ]
    full = {r.i: r.venue for r in venues.with_venue(df, "name", "full").collect()}
    assert full[0] == "Advances in Neural Information Processing Systems" and full[6] == names[6] and full[12] is None
    assert [r.venue for r in venues.with_venue(df, "name", "keep").orderBy("i").collect()] == names
