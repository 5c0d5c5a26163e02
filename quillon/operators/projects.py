"""Multi-file projects as rows: includes are resolved by joins, so a corpus of projects is flattened at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.latex import strip_comments
from quillon.operators.tables import discard, durable

_TWO = r"(?:sub)?(?:import|inputfrom|includefrom)"
# A style of references that is alone on its line goes with the line.
_LONE_STYLE = r"(?<![^\n])[ \t]*\\bibliographystyle\*?\s*\{[^{}]*\}[ \t]*(?:%[^\n]*)?(?:\n|\z)"
_COMMAND = (
    rf"{_LONE_STYLE}|\\{_TWO}\*?\s*\{{[^{{}}]*\}}\s*\{{[^{{}}]*\}}|\\(?:input|include|subfile|bibliography|bibliographystyle)\*?\s*\{{[^{{}}]*\}}"
    r"|\\input[ \t]+[^\s{}%\\]+|\\begin\s*\{document\}|\\end\{document\}"
)
# What an include is not read in: escaped characters, comments, and literal text.
_SKIPPED = r"%[^\n]*|\\begin\{(verbatim|lstlisting|minted|comment)(\*?)\}.*?\\end\{\1\2\}|\\verb\*?([^A-Za-z\s*]).*?\3"
# Names of files that are likely to be the main one, likeliest first.
MAIN = ("main.tex", "paper.tex", "ms.tex", "manuscript.tex", "article.tex")


def main_files(files: DataFrame) -> DataFrame:
    """files(project, path, text) -> the main file of each project: one with \\documentclass (not of subfiles) and
    \\begin{document} outside comments and literal text; a conventional name first, then the least deep, then the shortest path."""
    path = normal_path(F.col("path"))
    base = F.lower(F.regexp_extract(path, r"([^/]+)\z", 1))
    rank = F.array_position(F.array(*[F.lit(x) for x in MAIN]), base)
    order = [F.when(rank > 0, rank).otherwise(len(MAIN) + 1), F.size(F.split(path, "/")), F.length(path), path]
    text = F.regexp_replace(strip_comments(F.col("text")), rf"(?s){_SKIPPED}", "")
    whole = text.rlike(r"\\documentclass(?![A-Za-z])") & text.rlike(r"\\begin\s*\{document\}") & ~text.rlike(r"\\documentclass\s*\[[^\]]*\]\s*\{subfiles\}")
    roots = files.where(F.lower("path").endswith(".tex") & whole)
    return roots.withColumn("_rn", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where("_rn = 1").drop("_rn")


def normal_path(path):
    """A path with slashes, without `.` and `..` segments (those above the root are dropped)."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/")


def pieces(files: DataFrame) -> DataFrame:
    """files(project, path, text) -> rows (project, path, i, line, raw, command, folder, name, next, first, last): a file's text cut at
    the commands that bring in files or references, in order; those in comments and literal text are text, and so are
    names with macros or arguments in them. `next` is the character after the piece; pieces `first` to `last` are a document's body."""
    found = F.regexp_extract_all("text", F.lit(rf"(?s){_COMMAND}|{_SKIPPED}|\\.|[^\\%\n]+|."), F.lit(0))
    marked = F.transform(found, lambda x: F.when(x.rlike(rf"\A(?:{_COMMAND})\z"), F.concat(F.lit("\u0001"), x, F.lit("\u0001"))).otherwise(x))
    cut = files.select("project", "path", F.split(F.array_join(marked, ""), "\u0001").alias("cut"))
    n = F.size("cut")
    begins = F.array_position(F.transform("cut", lambda x: x.rlike(r"\A\\begin\s*\{document\}\z")), True)
    ends = n - F.array_position(F.reverse(F.transform("cut", lambda x: x == "\\end{document}")), True)
    cut = cut.select("*", begins.alias("first"), F.when((ends < n) & (ends >= begins), ends - 1).otherwise(n - 1).alias("last"))
    after = lambda i: F.when(F.get("cut", i + 1) != "", F.left(F.get("cut", i + 1), F.lit(1))).when(i + 2 < n, "\\").otherwise("")
    rows = cut.select("project", "path", "first", "last", F.explode(F.transform("cut", lambda x, i: F.struct(i.alias("i"), x.alias("raw"), after(i).alias("next")))).alias("x"))
    rows = rows.select("project", "path", "first", "last", "x.*")
    above = Window.partitionBy("project", "path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.sum(F.length("raw") - F.length(F.translate("raw", "\n", ""))).over(above), F.lit(0)) + 1
    command = F.regexp_extract("raw", r"\A[ \t]*\\([A-Za-z]+)", 1)
    two = command.rlike(rf"\A{_TWO}\z")
    name = F.when(two, F.regexp_extract("raw", r"\}\s*\{([^{}]*)\}\z", 1)).when(F.col("raw").rlike(r"\A\\input[ \t]+[^{]+\z"), F.regexp_extract("raw", r"[ \t]+(\S+)\z", 1)).otherwise(F.regexp_extract("raw", r"\{([^{}]*)\}", 1))
    rows = rows.select("*", line.alias("line"), command.alias("c"), F.when(two, F.trim(F.regexp_extract("raw", r"\{([^{}]*)\}", 1))).alias("folder"), F.trim(name).alias("name"))
    plain = (F.col("i") % 2 == 0) | F.col("c").isin("begin", "end") | (F.col("name") == "") | F.col("name").rlike(r"[#\\]")
    return rows.select("project", "path", "i", "line", "raw", F.when(~plain, F.col("c")).alias("command"), "folder", "name", "next", "first", "last")


def _joined(folder, name):
    """A name seen from a folder, or from the top if it starts with a slash."""
    return normal_path(F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", folder, name)))


def _folder(path):
    return F.regexp_extract(path, r"\A(?:(.*)/)?[^/]*\z", 1)


def _resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Piece rows with `base`, `root` -> with `below`, the folder that names in the file brought in are seen from, and `file`, the path
    it has, null if there is none: as written if that ends in .tex, else with .tex, else (not of \\include) as written."""
    reads = F.col("command").isNotNull() & ~F.col("command").isin("bibliography", "bibliographystyle")
    below = F.when(F.col("folder").isNull(), F.col("base")).when(F.col("command").startswith("sub"), _joined(F.col("base"), F.col("folder"))).otherwise(_joined(F.col("root"), F.col("folder")))
    rows = rows.withColumn("below", F.when(reads, below)).withColumn("wanted", F.when(reads, _joined(F.col("below"), F.col("name"))))
    is_tex = F.lower("wanted").endswith(".tex")
    only_tex = (F.col("command") == "include") | F.col("command").endswith("includefrom")
    asks = rows.where(reads).select("project", "at", "i", F.explode(F.array_compact(F.array(
        F.when(~is_tex, F.struct(F.lit(0).alias("o"), F.concat("wanted", F.lit(".tex")).alias("p"))), F.when(is_tex | ~only_tex, F.struct(F.lit(1).alias("o"), F.col("wanted").alias("p"))),
    ))).alias("a"))
    asks = asks.select("project", "at", "i", "a.o", F.col("a.p").alias("path"))
    hit = asks.join(known, ["project", "path"]).groupBy("project", "at", "i").agg(F.min_by("path", "o").alias("file"))
    return rows.join(hit, ["project", "at", "i"], "left")


def missing_includes(files: DataFrame) -> DataFrame:
    """(project, path, target) of includes that no file answers, of files that the main file brings in."""
    notes = flatten(files).select("project", F.explode("notes").alias("x")).where("x.note = 'file not found'")
    return notes.select("project", "x.path", "x.target").distinct()


def flatten(files: DataFrame) -> DataFrame:
    """files(project, path, text) -> project, main, text, inlined, notes: main files with all they bring in in place.

    Names are seen from the main file's folder, within \\import from the folder it names. \\include is set between page breaks; of a
    subfile the body counts; \\bibliography becomes the compiled references (.bbl named as the main file, or the only one), and
    the style goes with it. What is missing, or would include itself, stays with a comment that says so. `inlined` are
    the files in the order they are read, `notes` (path, line, target, note) what could not be brought in. Paths that are the same when
    normalised are one file, of the greatest text; null texts are empty, rows without project or path are left out.

    Levels of the tree of includes are expanded by a join each, and put together from the lowest up, by a join each: a piece is
    named by the numbers of the pieces above it. Projects are spread by their pieces; no project is in one task before its text is.
    """
    files = files.where("project is not null and path is not null").groupBy("project", normal_path(F.col("path")).alias("path")).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    files = durable(files)
    known = files.select("project", "path")
    main = main_files(files).select("project", F.col("path").alias("main"))
    bbl = files.where(F.lower("path").endswith(".bbl")).join(main, "project")
    own = F.col("path") == F.concat(F.regexp_replace("main", r"(?i)\.tex\z", ""), F.lit(".bbl"))
    bbl = bbl.groupBy("project").agg(F.coalesce(F.max(F.when(own, F.col("path"))), F.when(F.count("*") == 1, F.max("path"))).alias("path"))
    main = durable(main.join(bbl.where("path is not null").select("project", F.col("path").alias("bbl")), "project", "left"))
    references = files.join(main.select("project", F.col("bbl").alias("path")), ["project", "path"]).select("project", _trimmed("text").alias("references"))
    cut = pieces(files)
    cut = cut.join(references.withColumnRenamed("project", "of"), (F.col("project") == F.col("of")) & F.col("command").isin("bibliography", "bibliographystyle"), "left")
    cut = durable(cut.withColumn("raw", F.when(F.col("of").isNull(), F.col("raw")).when(F.col("command") == "bibliography", F.col("references")).otherwise("")).drop("of", "references"))

    root = _folder(F.col("main"))
    now = main.select("project", F.array().cast("array<int>").alias("at"), F.col("main").alias("path"), F.lit(False).alias("body"), root.alias("base"), root.alias("root"), F.array("main").alias("seen"))
    levels = []
    while True:  # no file is twice on the way to a piece, so this ends
        rows = now.join(cut, ["project", "path"]).where(~F.col("body") | (F.col("first") == 0) | ((F.col("i") >= F.col("first")) & (F.col("i") <= F.col("last"))))
        rows = _resolved(rows, known)
        why = F.when(F.col("below").isNotNull() & F.col("file").isNull(), "file not found").when(F.array_contains("seen", F.col("file")), "include cycle, not expanded")
        rows = durable(rows.select("*", why.alias("note")).drop("first", "last"))
        levels.append(rows)
        below = rows.where("file is not null and note is null")
        if below.isEmpty():
            break
        now = below.select("project", F.array_append("at", F.col("i")).alias("at"), F.col("file").alias("path"), (F.col("command") == "subfile").alias("body"), F.col("below").alias("base"), "root", F.array_append("seen", F.col("file")).alias("seen"))

    inner, spent = None, []
    for depth, rows in reversed(list(enumerate(levels))):
        kept = F.concat("raw", F.lit(" % not flattened: "), F.col("note"), F.when(~F.col("next").isin("\n", ""), "\n").otherwise(""))
        literal = F.when(F.col("note").isNotNull(), kept).otherwise(F.col("raw"))
        if inner is not None:
            rows = rows.withColumn("under", F.array_append("at", F.col("i"))).join(inner.select("project", F.col("at").alias("under"), "text"), ["project", "under"], "left")
            paged = F.when((F.col("command") == "include") | F.col("command").endswith("includefrom"), F.concat(F.lit("\\clearpage\n"), "text", F.lit("\n\\clearpage"))).otherwise(F.col("text"))
            literal = F.coalesce(paged, literal)
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", literal.alias("x")))), lambda x: x["x"]), "")
        inner = rows.groupBy("project", "at").agg(whole.alias("text"))
        if depth:
            inner = durable(inner.withColumn("text", _trimmed(F.regexp_replace("text", r"\A\n", ""))))
            spent.append(inner)
    said = None
    for rows in levels:
        one = rows.select("project", "at", "i", F.when(F.col("note").isNotNull(), F.struct("path", "line", F.col("wanted").alias("target"), "note")).alias("note"), F.when(F.col("note").isNull(), F.col("file")).alias("file"))
        said = one if said is None else said.union(one)
    order = F.array_sort(F.collect_list(F.struct(F.array_append("at", F.col("i")).alias("at"), "note", "file")))
    said = said.where("note is not null or file is not null").groupBy("project").agg(order.alias("said"))
    out = inner.join(main.select("project", "main"), "project").join(said, "project", "left")
    names = F.array_compact(F.transform("said", lambda x: x["file"]))
    none = F.array().cast("array<struct<path:string,line:bigint,target:string,note:string>>")
    out = out.select(
        "project", "main", "text", F.array_distinct(F.concat(F.array("main"), F.coalesce(names, F.array().cast("array<string>")))).alias("inlined"),
        F.coalesce(F.array_compact(F.transform("said", lambda x: x["note"])), none).alias("notes"),
    )
    out = durable(out)
    discard(files, cut, main, *levels, *spent)
    return out


def _trimmed(text):
    return F.rtrim(text, F.lit(" \t\n\r\f\u000b"))


# Endings that a figure's name may lack, in the order they are tried.
FIGURES = ("", ".pdf", ".png", ".jpg", ".jpeg", ".eps", ".PDF", ".PNG", ".JPG", ".JPEG", ".EPS")
_FIGURE = r"\\includegraphics\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}|\\graphicspath\s*\{(?:\s*\{[^{}]*\})*\s*\}"


def figures(flat: DataFrame, paths: DataFrame) -> DataFrame:
    """flat(project, main, text), paths(project, path) -> (project, reference, path) once for each figure a text shows: the file it means, null
    if none. Looked for from the main file's folder, then in the folders of \\graphicspath, with each ending in turn."""
    found = F.regexp_extract_all("text", F.lit(rf"(?s){_FIGURE}|{_SKIPPED}|\\.|[^\\%]+|."), F.lit(0))
    shown = flat.select("project", _folder(F.col("main")).alias("root"), F.filter(found, lambda x: x.rlike(rf"\A(?:{_FIGURE})\z")).alias("x"))
    folders = F.flatten(F.transform(F.filter("x", lambda x: x.startswith("\\graphicspath")), lambda x: F.regexp_extract_all(x, F.lit(r"\{([^{}]*)\}"), F.lit(1))))
    named = F.transform(F.filter("x", lambda x: x.startswith("\\includegraphics")), lambda x: F.trim(F.regexp_extract(x, r"\{([^{}]*)\}\z", 1)))
    shown = shown.select("project", "root", folders.alias("folders"), F.explode(F.array_distinct(named)).alias("reference")).where("reference <> '' and not contains(reference, '#')")
    places = F.concat(F.array("root"), F.transform("folders", lambda f: _joined(F.col("root"), F.trim(f))))
    asks = shown.select("project", "reference", F.posexplode(F.flatten(F.transform(places, lambda d: F.transform(F.array(*[F.lit(x) for x in FIGURES]), lambda e: _joined(d, F.concat("reference", e)))))).alias("o", "path"))
    known = paths.select("project", normal_path(F.col("path")).alias("path")).distinct()
    hit = asks.join(known, ["project", "path"]).groupBy("project", "reference").agg(F.min_by("path", "o").alias("path"))
    return shown.select("project", "reference").join(hit, ["project", "reference"], "left")


# Endings of files that are read as text.
TEXTS = r"(?i)\.(tex|ltx|latex|sty|cls|bbl|def|cfg|tikz|pgf|pdf_tex|txt)\z"


def prepared_sources(members: DataFrame) -> DataFrame:
    """members(package, path, data) of unpacked archives -> package, path, text, n_binary, error: the text files of each package, or one row with
    what is wrong with it (empty, pdf only, web page, no tex). A member alone in its package is text whatever its name, unless it is
    a PDF; names lose .gz and get .tex where they lack an ending. Only flags are aggregated, contents stay in their rows."""
    size, pdf = F.coalesce(F.length("data"), F.lit(0)), F.coalesce(F.substring("data", 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    path = F.regexp_replace(F.coalesce("path", F.lit("")), r"(?i)\.gz\z", "")
    page = F.coalesce(F.make_valid_utf8(F.substring("data", 1, 1024).cast("string")), F.lit("")).rlike(r"(?i)\A\s*<(!doctype html|html)")
    rows = members.select("package", path.alias("path"), "data", size.alias("size"), pdf.alias("pdf"), page.alias("page"), F.coalesce(F.col("path"), F.lit("")).rlike(TEXTS).alias("named"))
    tex = F.col("path").rlike(r"(?i)\.(tex|ltx|latex)\z")
    flags = rows.groupBy("package").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("pdf").alias("any_pdf"), F.max(F.when(F.col("named"), F.col("page"))).alias("page_named"), F.max(F.col("page") & ~F.col("pdf")).alias("page_any"),
        F.count_if("named").alias("named"), F.max(F.col("named") & tex).alias("tex"),
    )
    single = F.col("n") == 1
    texts = F.when(single, F.when(F.col("any_pdf") & (F.col("named") == 0), 0).otherwise(1)).otherwise(F.col("named"))
    error = (
        F.when(F.col("bytes") == 0, "empty").when(single & F.col("any_pdf"), "pdf only")
        .when((texts == 1) & F.when(single, F.col("page_any")).otherwise(F.col("page_named")), "web page")
        .when(~(F.col("tex") | (single & (F.col("named") == 0))), F.when(F.col("any_pdf"), "pdf only").otherwise("no tex"))
    )
    state = flags.select("package", single.alias("single"), (F.col("n") - texts).alias("n_binary"), error.alias("error"))
    good = rows.join(state.where("error is null").withColumnRenamed("package", "of"), F.col("package").eqNullSafe(F.col("of"))).drop("of")
    good = good.where("named or single").select("package", F.when(F.col("path").rlike(TEXTS), F.col("path")).otherwise(F.concat("path", F.lit(".tex"))).alias("path"), F.make_valid_utf8(F.coalesce(F.col("data"), F.lit(b"")).cast("string")).alias("text"), "n_binary", "error")
    bad = state.where("error is not null").select("package", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n_binary"), "error")
    return good.union(bad)
