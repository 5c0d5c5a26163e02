from quillon.operators import blocks

NAMES = ["start", "end", "body_start", "body_end", "env", "kind", "spec", "width", "wide", "in_float", "scaled", "size"]


def found(text):
    """Of each block: its text, its body, and the rest without offsets."""
    return [(text[b[0] : b[1]], text[b[2] : b[3]], *b[4:]) for b in blocks.find_blocks(text)]


def test_blocks():
    tab = "\\begin{tabular}[t]{l{x}r}a & b\\end{tabular}"
    inner = "\\begin{equation}\\begin{array}{c}y\\end{array}\\end{equation}"
    cases = {
        "x \\[ a \\] y $$b$$": [("\\[ a \\]", " a ", "\\[", "display", None, None, False, False, False, None), ("$$b$$", "b", "$$", "display", None, None, False, False, False, None)],
        tab: [(tab, "a & b", "tabular", "tabular", "l{x}r", None, False, False, False, None)],
        inner: [(inner, inner[16:-14], "equation", "equation", None, None, False, False, False, None)],
        "\\begin{array}{c}w\\end{array} \\\\[2pt] \\$ 5": [],
        "\\begin{table*}\\small\\begin{array}{c}w\\end{array}\\end{table*}": [("\\begin{array}{c}w\\end{array}", "w", "array", "array", "c", None, True, True, False, "small")],
        "\\begin{figure}\\begin{array}{c}w\\end{array}\\end{figure}": [],
        "\\resizebox{1cm}{!}{" + tab + "}": [(tab, "a & b", "tabular", "tabular", "l{x}r", None, False, False, True, None)],
        "{\\small {\\tiny $$b$$}}": [("$$b$$", "b", "$$", "display", None, None, False, False, False, "tiny")],
        "\\begin{tabularx}{ 5cm }{X}\\scalebox{2}{a}\\end{tabularx}": [("\\begin{tabularx}{ 5cm }{X}\\scalebox{2}{a}\\end{tabularx}", "\\scalebox{2}{a}", "tabularx", "tabularx", "X", "5cm", False, False, True, None)],
        "\\begin{adjustbox}{w}\\[a\\]\\end{adjustbox}": [("\\[a\\]", "a", "\\[", "display", None, None, False, False, True, None)],
        "% $$a$$\n\\verb|$$a$$| \\begin{verbatim}\\[a\\]\\end{verbatim}": [],
        "\\begin{align*}a": [("\\begin{align*}a", "a", "align*", "align", None, None, False, False, False, None)],
        "$$a$$\\begin{document}\\[b\\]\\end{document}": [("\\[b\\]", "b", "\\[", "display", None, None, False, False, False, None)],
        "\\[ a": [], "\\begin{tabular": [], "": [],
    }
    assert {k: found(k) for k in cases} == cases


def test_many_blocks_in_linear_time():
    one = "\\begin{table}{\\small\\resizebox{1cm}{!}{\\begin{tabular}{l}a\\end{tabular}}}\\end{table} \\[ x \\] " + "{" * 20
    got = blocks.find_blocks(one * 5_000)
    assert len(got) == 10_000 and [b[10] for b in got[:2]] == [True, False] and got[0][11] == "small"


def test_rows(spark):
    df = spark.createDataFrame([(1, "\U0001d465 $$b$$", "e"), (2, None, ""), (3, "", ""), (1, "\U0001d465 $$b$$", "e")], "id int, text string, env string")
    got = blocks.blocks(df, "id", df.text)
    assert got.columns == ["id", *NAMES] and [(r.id, r.start, r.end, r.kind) for r in got.collect()] == [(1, 2, 7, "display")] * 2
