import random

from quillon.operators import diffs, equations, projects


def files(spark):
    doc = "\\documentclass{article}\\begin{document}"
    rows = [
        ("p", "main.tex", doc + "A\\input{sec/one}B\\include{two.tex}C\\input{gone}D"), ("p", "sec/one.tex", "1[\\input{sec/sub}]"), ("p", "sec/sub.tex", "s"),
        ("p", "two.tex", "2\\input{main}\n"), ("p", "old/paper.tex", doc), ("q", "x.tex", doc + "only"), ("r", "a.tex", "no class"),
    ]
    return spark.createDataFrame(rows, "project string, path string, text string")


def test_main_files(spark):
    assert sorted((r.project, r.path) for r in projects.main_files(files(spark)).collect()) == [("p", "main.tex"), ("q", "x.tex")]


def test_main_files_by_name_depth_and_length(spark):
    doc = "\\documentclass{article}\\begin{document}"
    rows = [
        ("a", "deep/er/main.tex", doc), ("a", "x.tex", doc), ("b", "sub/paper.tex", doc), ("b", "ms.tex", doc), ("c", "bb.tex", doc), ("c", "a/b.tex", doc),
        ("d", "child.tex", "\\documentclass[main.tex]{subfiles}\\begin{document}"), ("d", "note.tex", "% " + doc), ("d", "v.tex", "\\begin{verbatim}" + doc + "\\end{verbatim}"), ("d", ".\\real.tex", doc),
    ]
    got = projects.main_files(spark.createDataFrame(rows, "project string, path string, text string")).collect()
    assert sorted((r.project, r.path) for r in got) == [("a", "deep/er/main.tex"), ("b", "sub/paper.tex"), ("c", "bb.tex"), ("d", ".\\real.tex")]


def test_includes_in_comments_and_literal_text_stay(spark):
    doc = "\\documentclass{article}\\begin{document}"
    body = "\\input{a}% \\input{a}\n50\\% \\input{a}\\begin{verbatim}\\input{a}\\end{verbatim}\\verb|\\input{a}| \\\\\\input{a}"
    df = spark.createDataFrame([("p", "main.tex", doc + body), ("p", "a.tex", "<A>")], "project string, path string, text string")
    want = "<A>% \\input{a}\n50\\% <A>\\begin{verbatim}\\input{a}\\end{verbatim}\\verb|\\input{a}| \\\\<A>"
    assert [r.text for r in projects.flatten(df).collect()] == [doc + want]


def test_missing(spark):
    assert [tuple(r) for r in projects.missing_includes(files(spark)).collect()] == [("p", "main.tex", "gone")]


def test_flatten(spark):
    doc = "\\documentclass{article}\\begin{document}"
    got = {r.project: r.text for r in projects.flatten(files(spark)).collect()}
    b = "\\clearpage\n2\\input{main} % not flattened: include cycle, not expanded\n\\clearpage"
    assert got == {"p": doc + "A1[s]B" + b + "C\\input{gone} % not flattened: file not found\nD", "q": doc + "only"}


def article(body, pre=""):
    return "\\documentclass{article}\n" + pre + "\\begin{document}\n" + body + "\n\\end{document}\n"


def test_flattened_projects(spark):
    """What brings in what, by project: expected text, files in the order read, notes."""
    child = "\\documentclass[../main]{subfiles}\n\\begin{document}\nBody A.\n\\end{document}\n"
    bbl = "\\begin{thebibliography}{1}\n\\bibitem{a} A.\n\\end{thebibliography}"
    kept = article("% \\input{gone}\n\\begin{verbatim}\n\\input{gone}\n\\end{verbatim}\n\\begin{comment}\\input{gone}\\end{comment}\n\\verb|\\input{gone}|")
    macro = article("x", "\\newcommand{\\inc}[1]{\\input{#1}}\n")
    cases = {
        "nested": ({"main.tex": article("\\input{sections/intro}\n\\input sections/method.tex\nEnd."), "sections/intro.tex": "Intro \\input{sections/deep}\n", "sections/deep.tex": "Deep.", "sections/method.tex": "Method."}, article("Intro Deep.\nMethod.\nEnd."), []),
        "include": ({"main.tex": article("\\include{ch1}"), "ch1.tex": "One."}, article("\\clearpage\nOne.\n\\clearpage"), []),
        "alike": ({"main.tex": article("\\includeonly{x}\\includegraphics{x}"), "x.tex": "BAD"}, article("\\includeonly{x}\\includegraphics{x}"), []),
        "subfile": ({"main.tex": article("\\subfile{s/a}"), "s/a.tex": child}, article("Body A."), []),
        "import": ({"paper/main.tex": article("\\import{chap/}{c1}"), "paper/chap/c1.tex": "C1 \\input{part} \\subimport{sub/}{x}", "paper/chap/part.tex": "P", "paper/chap/sub/x.tex": "X"}, article("C1 P X"), []),
        "dots": ({"main.tex": article("\\input{./a/../b}"), "b.tex": "B"}, article("B"), []),
        "literal": ({"main.tex": kept, "gone.tex": "IN"}, kept, []),
        "macro": ({"main.tex": macro}, macro, []),
        "missing": ({"main.tex": article("\\input{nope} after")}, article("\\input{nope} % not flattened: file not found\n after"), [("main.tex", 3, "nope", "file not found")]),
        "cycle": ({"main.tex": article("\\input{a}"), "a.tex": "A\n\\input{b}", "b.tex": "B \\input{a}"}, article("A\nB \\input{a} % not flattened: include cycle, not expanded"), [("b.tex", 1, "a", "include cycle, not expanded")]),
        "bbl": ({"main.tex": article("Text.\n\\bibliographystyle{plain}\n\\bibliography{refs}"), "main.bbl": bbl + "\n"}, article("Text.\n" + bbl), []),
        "no bbl": ({"main.tex": article(" \\bibliographystyle{plain}\n\\bibliography{refs}")}, article(" \\bibliographystyle{plain}\n\\bibliography{refs}"), []),
        "two bbl": ({"main.tex": article("\\bibliography{refs}"), "a.bbl": "a", "b.bbl": "b"}, article("\\bibliography{refs}"), []),
        "empty": ({"main.tex": article("x \\input{a}|"), "a.tex": "y \\input{b}\n", "b.tex": None}, article("x y|"), []),
        "no main": ({"a.txt": "x"}, None, []),
    }
    rows = [(k, p, x, "clash") for k, (texts, _, _) in cases.items() for p, x in texts.items()] + [(None, "main.tex", article("x"), ""), ("null", None, article("x"), ""), ("dots", "./b.tex", "A", "")]
    got = {r.project: r for r in projects.flatten(spark.createDataFrame(rows, "project string, path string, text string, main string")).collect()}
    assert {k: r.text for k, r in got.items()} == {k: want for k, (_, want, _) in cases.items() if want is not None}
    assert {k: [tuple(n) for n in r.notes] for k, r in got.items()} == {k: notes for k, (_, want, notes) in cases.items() if want is not None}
    assert got["nested"].inlined == ["main.tex", "sections/intro.tex", "sections/deep.tex", "sections/method.tex"] and got["import"].main == "paper/main.tex"
    assert projects.flatten(spark.createDataFrame([], "project string, path string, text string")).collect() == []


def test_long_files_are_flattened(spark):
    body = "a {b} 50\\% % c\n" * 20_000 + "\\verb|" + "x" * 100_000 + "|" + " " * 100_000
    rows = [("p", "main.tex", article("\\input{a}")), ("p", "a.tex", body)]
    assert [r.text for r in projects.flatten(spark.createDataFrame(rows, "project string, path string, text string")).collect()] == [article(body.rstrip())]


def test_figures(spark):
    text = article("\\includegraphics[width=\\linewidth]{plot}\n\\includegraphics{other.png}\n\\includegraphics{missing} % \\includegraphics{note}\n\\includegraphics{#1}", "\\graphicspath{{figs/}}\n")
    flat = spark.createDataFrame([("p", "main.tex", text), ("q", "m.tex", "none")], "project string, main string, text string")
    paths = spark.createDataFrame([("p", "figs/plot.pdf"), ("p", "figs/plot.png"), ("p", "./other.png"), ("q", "missing.pdf")], "project string, path string")
    assert sorted((r.project, r.reference, r.path) for r in projects.figures(flat, paths).collect()) == [("p", "missing", None), ("p", "other.png", "other.png"), ("p", "plot", "figs/plot.pdf")]


def test_prepared_sources(spark):
    rows = [
        ("many", "main.tex", b"M"), ("many", "sec/a.txt", b"A"), ("many", "f.png", b"\x89PNG"), ("single", "2301.12345.gz", b"S"), ("pdf", "x", b"%PDF-1.5"), ("empty", "x", b""), ("empty", "y", None),
        ("page", "p.tex", b" <!DOCTYPE html>"), ("page", "f.png", b"x"), ("txt", "readme.txt", b"hello"), ("two", "a.pdf", b"%PDF-1"), ("two", "b.txt", b"b"), (None, "a.TEX", b"\xff"), (None, None, b"z"),
    ]
    got = projects.prepared_sources(spark.createDataFrame([(*r, "x") for r in rows], "package string, path string, data binary, error string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([
        ("many", "main.tex", "M", 1, None), ("many", "sec/a.txt", "A", 1, None), ("single", "2301.12345.tex", "S", 0, None), ("pdf", None, None, None, "pdf only"), ("empty", None, None, None, "empty"),
        ("page", None, None, None, "web page"), ("txt", None, None, None, "no tex"), ("two", None, None, None, "pdf only"), (None, "a.TEX", "\ufffd", 1, None),
    ], key=str)


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",)], "p string")
    assert [r[0] for r in df.select(projects.normal_path("p")).collect()] == ["a/c", "x", ""]


def events(spark):
    kinds = ["equation", "section", "equation", "unnumbered", "equation", "section", "equation", "appendix", "section", "equation"]
    tags = {4: "*"}
    return spark.createDataFrame([("d", i, k, tags.get(i)) for i, k in enumerate(kinds)], "doc string, seq int, kind string, tag string")


def test_numbers(spark):
    assert [r.number for r in equations.number_equations(events(spark)).orderBy("seq").collect()] == ["1", "2", None, "*", "3", "4"]
    assert [r.number for r in equations.number_equations(events(spark), True).orderBy("seq").collect()] == ["0.1", "1.1", None, "*", "2.1", "A.1"]


def test_references(spark):
    refs = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc string, seq int, key string")
    labels = spark.createDataFrame([("d", "a", "3")], "doc string, key string, number string")
    assert sorted((r.key, r.text, r.ok) for r in equations.resolve_references(refs, labels).collect()) == [("a", "3", True), ("b", "??", False)]


def test_rows_and_relations(spark):
    rows = ["a \\\\ b", "a \\\\[2pt] \\begin{cases}x\\\\y\\end{cases} \\\\* ", "{p \\\\ q}", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(equations.split_rows(df.x)).collect()] == [["a ", " b"], ["a ", " \\begin{cases}x\\\\y\\end{cases} "], ["{p \\\\ q}"], [""]]
    formulas = ["a_{1} = b + \\alpha", "f(x) = x^2", "a \\leq b = c", "x == y", "\\frac{a=b}{c} &= d", "no relation q", "a := b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(formulas)], "i int, x string").orderBy("i")
    got = [(r.d.defines, r.d.uses) for r in df.select(equations.defines_and_uses(df.x).alias("d")).collect()]
    assert got == [("a_1", ["b", "\\alpha"]), ("f", ["x"]), (None, ["a", "b", "c"]), (None, ["x", "y"]), (None, ["a", "b", "c", "d"]), (None, ["n", "o", "r", "e", "l", "a", "t", "i", "q"]), ("a", ["b"])]


def test_edits_are_shortest(monkeypatch):
    r = random.Random(1)
    for cells in (diffs.CELLS, 4):
        monkeypatch.setattr(diffs, "CELLS", cells)
        for _ in range(300):
            a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
            runs = diffs.edits(a, b)
            assert [s for k, x in runs if k != "insert" for s in x] == a and [s for k, x in runs if k != "delete" for s in x] == b
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a) - 1, -1, -1):
                for j in range(len(b) - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
            assert sum(len(x) for k, x in runs if k == "equal") == best[0][0]
    assert diffs.line_edits("a\nb x\nc", "a\nb y\nc\nd") == [("equal", 1, 1, "a", ""), ("delete", 2, None, "b x", "x"), ("insert", None, 2, "b y", "y"), ("equal", 3, 3, "c", ""), ("insert", None, 4, "d", "d")]
