"""Operators that were too slow on large tables: the same results as their plain or column versions, within a time."""

import random
import time

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import latex
from quillon.operators import equations, papers, symbols
from quillon.operators import relational as R


def within(seconds, df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    assert time.time() - began < seconds


def test_nearest_names(spark):
    rnd = random.Random(3)
    words = ["gather", "align", "aligned", "cases", "ab", "matrix", "\U0001d400b"]
    names = [None, "", "a", "ba", "\U0001d400b", "b\U0001d400"] + ["".join(rnd.choice("abgilnes") for _ in range(rnd.randrange(9))) for _ in range(60)]
    names += ["".join(rnd.sample(w, len(w))) for w in words for _ in range(5)]
    given = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = given.select("name", F.posexplode(F.array(*map(F.lit, words))).alias("i", "w")).select("name", "i", "w", R.osa_distance(F.col("name"), F.col("w")).alias("d")).collect()
    want = {}
    for n in names:
        near = sorted((p.d, p.i, p.w) for p in set(pairs) if p.name == n and p.d is not None and p.d <= 2)
        want[n] = (near[0][2], near[0][0], sum(x[0] == near[0][0] for x in near)) if near else (None, None, 0)
    assert {r.name: (r.nearest, r.distance, r.ties) for r in R.nearest_name(given, "name", words, 2).collect()} == want


def test_environments_of_many_rows(spark):
    names = F.get(F.array(*map(F.lit, ("eqaution", "algin*", "align", "itemise"))), (F.col("id") % 4).cast("int"))
    within(60, latex.corrected_environments(spark.range(100_000).select(names.alias("name")), "name"))


def paper(rnd):
    """A text of sections, equations, references and odd pieces in any order."""
    names = ["x", "y_i", "\\hat{h}_{t+1}", "z_{ab}", "W_1", "f(x)", "\\alpha", "g _ {2}", "\\bar {u}", "\\mathcal", "\u3000q\u00a0"]
    signs = [" = ", " &= ", " := ", "\\approx ", " \\equiv", " <= ", " == ", " \\approxeq ", " + ", "\\implies ", " \\quad ", "=:"]
    head = lambda: rnd.choice(["", rnd.choice(names) + rnd.choice(signs), "&" + rnd.choice(names) + " ="])
    eq = lambda: head() + "".join(rnd.choice([rnd.choice(names), rnd.choice(signs), "\\text{if x}", "{a = b}", "\\sum_{i=1}^n ", "\\{", "\\}"]) for _ in range(rnd.randrange(1, 7))) + rnd.choice(["", "", "\\label{k%d}" % rnd.randrange(4), "\\tag{ T }", "\\tag{}", "\\nonumber", "\\notag", "\\label { k1\u00a0}"])
    rows = lambda: rnd.choice(["\\\\", "\\\\[2pt]", " \\\\* "]).join(eq() for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "\\\\", "\\\\ \n"])
    env = lambda e, b: f"\\begin{{{e}}}{b}\\end{{{e}}}"
    one = [
        lambda: f"$${eq()}$$", lambda: f"\\[{eq()}\\]", lambda: f"${eq()}$", lambda: env(rnd.choice(["equation", "equation*", "aligned", "multline"]), eq()), lambda: env(rnd.choice(["align", "align*", "gather"]), rows()),
        lambda: "\\section{s}", lambda: "\\chapter [t]", lambda: "\\appendix ", lambda: "\\appendixes", lambda: env("subequations", eq()) if rnd.random() < 0.2 else "\\begin{subequations}", lambda: "\\end{subequations}",
        lambda: "\\ref{k%d}" % rnd.randrange(5), lambda: "\\eqref { k1 }", lambda: "% \\section{c}\n", lambda: "50\\% of\n", lambda: "\\verb|%|", lambda: "\n```\n$$x$$\n```\n", lambda: "a ``` b $", lambda: "\\begin{verbatim}%\\end{verbatim}", lambda: "\n\n", lambda: "\\begin{align} x", lambda: "\x02",
    ]
    return "".join(rnd.choice(one)() for _ in range(rnd.randrange(16)))


def papers_(spark, n=1500):
    rnd = random.Random(7)
    return spark.createDataFrame([(i, paper(rnd)) for i in range(n)] + [(n, None), (n + 1, "")], "doc_id int, text string").repartition(4).cache()


def bag(df):
    return sorted(map(repr, df.collect()))


def test_papers_equal_rows(spark):
    """What is read of each document in one pass is what windows and joins say of its events."""
    docs = papers_(spark)
    events, labels = equations.extract(docs)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("seq"))
    for within in (None, "section", "chapter"):
        want = equations.number_equations(events, within, "section", "chapter").select("doc", n.alias("n"), "kind", "env", "number", "number_section", "number_chapter")
        assert bag(papers.numbered(docs, within, "section", "chapter")) == bag(want)
    known = labels.join(equations.number_equations(events), ["doc", "seq"]).select("doc", "key", "number")
    assert bag(papers.resolved(docs)) == bag(equations.resolve_references(equations.references(docs), known))
    rows = events.where("latex is not null").select("doc", n.alias("seq"), "latex")
    edges = bag(equations.graph(docs))
    assert len(edges) > 50 and edges == bag(equations.formula_graph(rows))


def test_papers_of_many_orders(spark):
    text = "\\section{A} " + "\\begin{align} a_1 &= b + c \\label{k} \\\\ b &= a_1 \\end{align} $$ d(x) = a_1 $$ see \\ref{k}." * 4
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).repartition(4)
    within(45, papers.numbered(many, "section"))
    within(45, papers.resolved(many))
    within(45, equations.graph(many))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_symbol_table_aggregates_once(spark):
    docs = spark.createDataFrame([(1, "where $x_i$ is the input, $i \\in N$ and $x$ denotes a thing. $$y = x$$"), (2, None), (3, "$\\pi$")], "doc_id int, text string")
    table = symbols.symbol_table(docs)
    said = {(r.doc, r.symbol): r.description for r in symbols.definitions(docs).collect()}
    assert {(r.doc, r.symbol): (r.n, r.description, r.index_only) for r in table.collect()} == {
        (1, "x"): (3, said[1, "x"], False), (1, "i"): (2, said[1, "i"], False), (1, "N"): (1, None, False), (1, "y"): (1, None, False), (3, "\\pi"): (1, None, False)
    }
    assert plan(table).count("Aggregate") == 1 and "Join" not in plan(table)


def test_macros_of_documents(spark, tmp_path):
    """Cycles, names defined twice, other documents' names; no table is written on the way."""
    macros = [(1, 0, "f", "\\g", "F"), (1, 1, "g", "\\f \\h", "G"), (1, 2, "h", "x", "H"), (1, 3, "u", "\\h", "U"), (1, 4, "h", "\\u", "H2"), (2, 0, "a", None, "A"), (2, 1, "h", "", "H3"), (None, 0, "f", "", "N")]
    macros = spark.createDataFrame(macros, "doc int, ord int, name string, body string, source string")
    eqs = spark.createDataFrame([(1, 1, " \\f "), (1, 2, "\\h"), (1, 3, "x"), (2, 1, "\\f \\h"), (3, 1, "\\f"), (None, 1, "\\f"), (2, 2, None)], "doc int, seq int, latex string")
    got = equations.with_definitions(eqs, macros.drop("ord", "source"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, ["f", "g", "h", "u"]), (1, 2, ["h", "u"]), (2, 1, ["h"])]
    assert "Relation" not in plan(got)
    units = {(r.doc, r.seq): r.unit for r in equations.definition_units(eqs, macros).collect()}
    assert units == {(1, 1): "F\nG\nU\nH2\n\n\\f", (1, 2): "U\nH2\n\n\\h", (1, 3): "x", (2, 1): "H3\n\n\\f \\h", (3, 1): "\\f", (None, 1): "\\f", (2, 2): None}
