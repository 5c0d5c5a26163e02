"""Text normalisation as column expressions: all JVM-side, nothing leaves whole-stage evaluation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.braces import deep

# Code points that have no width and are deleted; spaces that become an ordinary one; smart punctuation and its ASCII form.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u061c\u2061\u2062\u2063\u2064"
ODD_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SMART = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"'}

# Superscript and subscript characters and what they stand for.
SUPERSCRIPTS = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni", strict=True))
SUBSCRIPTS = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜᵢⱼ", "0123456789+-=()aeoxhklmnpstij", strict=True))
# Mathematical characters and their LaTeX.
GLYPHS = {
    "−": "-", "–": "-", "—": "-", "×": "\\times ", "⋅": "\\cdot ", "·": "\\cdot ", "÷": "\\div ", "±": "\\pm ", "∓": "\\mp ",
    "≤": "\\leq ", "≥": "\\geq ", "≠": "\\neq ", "≈": "\\approx ", "≡": "\\equiv ", "∝": "\\propto ", "∞": "\\infty ",
    "∑": "\\sum ", "∏": "\\prod ", "∫": "\\int ", "∂": "\\partial ", "∇": "\\nabla ", "∈": "\\in ", "∉": "\\notin ",
    "⊂": "\\subset ", "⊆": "\\subseteq ", "∪": "\\cup ", "∩": "\\cap ", "∅": "\\emptyset ", "∀": "\\forall ", "∃": "\\exists ",
    "→": "\\to ", "⇒": "\\Rightarrow ", "⇔": "\\Leftrightarrow ", "←": "\\leftarrow ", "°": "^\\circ ",
    "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ", "ε": "\\varepsilon ", "ζ": "\\zeta ", "η": "\\eta ",
    "θ": "\\theta ", "κ": "\\kappa ", "λ": "\\lambda ", "μ": "\\mu ", "ν": "\\nu ", "ξ": "\\xi ", "π": "\\pi ", "ρ": "\\rho ",
    "σ": "\\sigma ", "τ": "\\tau ", "φ": "\\phi ", "χ": "\\chi ", "ψ": "\\psi ", "ω": "\\omega ",
    "Γ": "\\Gamma ", "Δ": "\\Delta ", "Θ": "\\Theta ", "Λ": "\\Lambda ", "Π": "\\Pi ", "Σ": "\\Sigma ", "Φ": "\\Phi ", "Ψ": "\\Psi ", "Ω": "\\Omega ",
    "Ι": "I", "Ξ": "\\Xi ", "Υ": "\\Upsilon ", "ι": "\\iota ", "υ": "\\upsilon ", "ς": "\\varsigma ", "ϕ": "\\phi ", "ϵ": "\\epsilon ",
    "ℝ": "\\mathbb{R}", "ℕ": "\\mathbb{N}", "ℤ": "\\mathbb{Z}", "ℚ": "\\mathbb{Q}", "ℂ": "\\mathbb{C}", "ℓ": "\\ell ", "ℏ": "\\hbar ",
    "∘": "\\circ ", "⊥": "\\perp ", "∥": "\\parallel ", "∣": "\\mid ", "≪": "\\ll ", "≫": "\\gg ", "∼": "\\sim ", "≃": "\\simeq ", "≅": "\\cong ",
    "⊃": "\\supset ", "⊇": "\\supseteq ", "∖": "\\setminus ", "∧": "\\land ", "∨": "\\lor ", "¬": "\\neg ", "⊕": "\\oplus ", "⊗": "\\otimes ",
    "∬": "\\iint ", "∮": "\\oint ", "∴": "\\therefore ", "∵": "\\because ", "⋯": "\\cdots ", "⋮": "\\vdots ", "⋱": "\\ddots ",
    "⇐": "\\Leftarrow ", "↔": "\\leftrightarrow ", "↦": "\\mapsto ", "⟨": "\\langle ", "⟩": "\\rangle ", "⌈": "\\lceil ", "⌉": "\\rceil ",
    "⌊": "\\lfloor ", "⌋": "\\rfloor ", "′": "'", "″": "''", "½": "\\frac{1}{2}", "¼": "\\frac{1}{4}", "¾": "\\frac{3}{4}",
}
# Commands that after a doubled backslash can only be an escaped copy.
COMMANDS = (
    "frac dfrac tfrac sqrt sum prod int iint oint lim infty partial nabla cdot cdots ldots times div pm leq geq neq approx equiv subseteq forall exists "
    "rightarrow Rightarrow leftarrow mathbb mathbf mathrm mathcal text left right sin cos tan log exp hat bar vec tilde overline binom quad qquad operatorname "
    "langle rangle alpha beta gamma delta epsilon varepsilon theta lambda sigma omega Delta Sigma Omega"
).split()

#: White space as a class: ASCII's and Unicode's.
WS = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_TEXT_GROUP = r"\\(?:text|textrm|textbf|textit|textsf|texttt|mbox)\s*\{[^{}]*\}"


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def bound(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def outside(c: Column, kept: str, change) -> Column:
    """`change` applied to what lies between the matches of the pattern `kept`, which stay as they are.

    The text is cut into matches and stretches between them, so a pattern of `change` cannot reach across a match.
    """
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)(?:{kept})|(?:(?!{kept}).)+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(rf"(?s)\A(?:{kept})\z"), x).otherwise(change(x))), "")


def normalize_unicode(c: Column) -> Column:
    """CRLF and CR to LF; invisible code points out; odd spaces to a space; smart quotes and the ellipsis to ASCII."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, ODD_SPACES + "".join(SMART) + INVISIBLE, " " * len(ODD_SPACES) + "".join(SMART.values()))
    return F.replace(c, F.lit("\u2026"), F.lit("..."))


def scripts(c: Column, table: dict[str, str], mark: str) -> Column:
    """Each run of a table's characters as one group: x²³ becomes x^{23}."""
    run = F.regexp_replace(c, "([" + "".join(table) + "]+)", mark + r"{$1}")
    return F.translate(run, "".join(table), "".join(table.values()))


def unicode_sqrt(c: Column) -> Column:
    """A root takes what follows it, in parentheses, braces or a single atom, into braces; a lone one becomes the command."""
    c = F.regexp_replace(c, r"√[ \t]*(?:\(\s*([^()]*?)\s*\)|(\d+(?:\.\d+)?|[A-Za-z]|\\[A-Za-z]+)|\{\s*([^{}]*?)\s*\})", r"\\sqrt{$1$2$3}")
    return F.replace(c, F.lit("√"), F.lit("\\sqrt "))


def unicode_math(c: Column) -> Column:
    """Mathematical characters of a formula as LaTeX: scripts, then glyphs, then roots, then no space before closers."""
    out = scripts(scripts(c, SUPERSCRIPTS, "^"), SUBSCRIPTS, "_")
    out = reduce(lambda x, g: F.replace(x, F.lit(g), F.lit(GLYPHS[g])), GLYPHS, out)
    out = F.when(c.rlike(r"[^\x00-\x7f]"), unicode_sqrt(out)).otherwise(c)
    return F.regexp_replace(out, rf"([a-zA-Z]){WS}+([)\]}},])", "$1$2")


def repair_escapes(c: Column) -> Column:
    """Doubled backslashes before known commands, escaped underscores and ** powers of a formula mended; text groups stay."""

    def mend(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?<!\\)\\\\(" + "|".join(COMMANDS) + r")(?![A-Za-z])", r"\\$1")
        x = F.regexp_replace(x, r"(?<!\\)\\_", "_")
        return F.regexp_replace(x, r"([A-Za-z0-9)}\]])[ \t]*\*\*[ \t]*(?:\(\s*([^()]*?)\s*\)|\{\s*([^{}]*?)\s*\}|(-?\d+(?:\.\d+)?|[A-Za-z]|\\[A-Za-z]+))", r"$1^{$2$3$4}")

    return F.when(c.rlike(_TEXT_GROUP), outside(c, _TEXT_GROUP, mend)).otherwise(mend(c))


def collapse(c: Column) -> Column:
    """Newlines with the blanks around them, and runs of blanks, to one space; ends trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, rf"{WS}*\n{WS}*", " "), r"[ \t]{2,}", " "))


# LaTeX commands and Unicode letters that stand for ASCII ones without an accent to drop.
LATEX_LETTERS = {"ss": "ss", "o": "o", "O": "O", "ae": "ae", "AE": "AE", "oe": "oe", "OE": "OE", "aa": "a", "AA": "A", "l": "l", "L": "L", "i": "i", "j": "j"}
LETTERS = {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ı": "i"}


@lru_cache(maxsize=1)
def _accents() -> dict[str, str]:
    """Characters that decompose into one other and combining marks of U+0300 to U+036F, by the decomposition's rule."""
    marks = {x: None for x in range(0x300, 0x370)}
    plain = {chr(c): unicodedata.normalize("NFD", chr(c)).translate(marks) for c in range(0xC0, 0xAC00) if c not in marks}
    return {c: p for c, p in plain.items() if len(p) == 1 and p != c}


def ascii_fold(c: Column) -> Column:
    """LaTeX accents and Unicode letters to plain ASCII: commands and braces out, letters without their marks."""
    for name in sorted(LATEX_LETTERS, key=len, reverse=True):
        c = F.regexp_replace(c, rf"\\{name}(?![a-zA-Z]){WS}*", LATEX_LETTERS[name])
    for pattern in (r"\\[`'^\"~=.]", rf"\\[cvuHkrdbt](?![a-zA-Z]){WS}*", rf"\\[a-zA-Z]+{WS}*", r"[{}]"):
        c = F.regexp_replace(c, pattern, "")
    for a, b in LETTERS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return F.translate(c, "".join(_accents()) + marks, "".join(_accents().values()))


def title_key(c: Column) -> Column:
    """What is compared of a title: folded, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]", "")


def normalize_doi(c: Column) -> Column:
    """Trimmed and lower-cased, without a resolver's address or a doi: prefix."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\Ahttps?://(dx\.)?doi\.org/", ""), rf"\Adoi:{WS}*", "")


def fix_pages(c: Column) -> Column:
    """A page range with hyphens or a dash gets the double hyphen; anything else stays."""
    return F.regexp_replace(c, rf"\A{WS}*([A-Za-z]?\d+){WS}*(?:-{{1,3}}|\u2013|\u2014){WS}*([A-Za-z]?\d+){WS}*\z", "$1--$2")


def _shortened(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(strip(F.left(c, F.lit(width - 1))), F.lit("\u2026"))).otherwise(c)


def doc_title(title: Column, text: Column, index: Column, width: int = 22, sample: str = "Sample") -> Column:
    """The user's title, else the document's own without commands, else its first line with content, cut to `width`.

    A null text is the sample document. Lengths are in code points.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    own = F.regexp_extract(text, r"\\title\s*(?:\[[^\]]*\])?\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", 1)
    own = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"\\[A-Za-z]+\*?", " "), r"[{}$\\~]", " "), rf"{WS}+", " "))
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, rf"\A#+{WS}*", ""), r"[$\\{}]", "")))
    line = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    found = F.coalesce(_shortened(blank(own), width), _shortened(line, width), F.concat(F.lit("Untitled "), index.cast("string")))
    return F.coalesce(blank(strip(title)), F.when(text.isNull(), sample).otherwise(found))


def file_base(title: Column, default: str = "document") -> Column:
    """A file name of a title: no extension of a document, no character a file system refuses, at most 80 characters."""
    c = F.regexp_replace(strip(title), r"(?i)\.(tex|md|png|bib)\z", "")
    for pattern, to in ((r"[\\/:*?\"<>|\x00-\x1f]+", "-"), (rf"{WS}+", "-"), ("-{2,}", "-"), (r"\A[-.]+|[-.]+\z", "")):
        c = F.regexp_replace(c, pattern, to)
    return F.coalesce(F.nullif(F.left(c, F.lit(80)), F.lit("")), F.lit(default))


_ARXIV_PAGE = r"(?i)\A(?:https?://)?(?:[a-z0-9-]+\.)*arxiv\.org/(?:abs|pdf|html|src|e-print|format|ps)/(.+)\z"


def parse_arxiv_id(c: Column) -> Column:
    """struct<id, error>: a preprint's id from its bare form or a page's address, the month checked. error: empty, link, id or month."""
    given = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"(?i)\Aarxiv{WS}*:{WS}*", "")
    link = given.rlike(r"(?i)arxiv\.org|\Ahttps?://")
    page = F.regexp_extract(given, _ARXIV_PAGE, 1)
    for pattern in (r"[?#][^\n]*\z", r"/+\z", r"(?i)\.pdf\z"):
        page = F.regexp_replace(page, pattern, "")
    bare = F.when(link, page).otherwise(given)
    new = bare.rlike(r"\A\d{4}\.\d{4,5}(v\d+)?\z")
    old = bare.rlike(r"\A[a-z][a-z-]*(?:\.[A-Za-z]{2})?/\d{7}(v\d+)?\z")
    month = F.substring(bare, 3, 2).between("01", "12")
    error = (
        F.when(strip(F.coalesce(c, F.lit(""))) == "", "empty").when(link & ~given.rlike(_ARXIV_PAGE), "link").when(~(new | old), "id").when(new & ~month, "month")
    )
    return F.struct(F.when(error.isNull(), bare).alias("id"), error.alias("error"))


def normalize_equation(c: Column) -> Column:
    """What a formula says, as a cache key: labels, tags, references, sizes, spacing, single braces, white space and final punctuation out."""
    for pattern, to in (
        (rf"\\(label|tag\*?|eqref|ref){WS}*\{{[^{{}}]*\}}", ""), (r"\\(nonumber|notag|displaystyle|textstyle|left|right|big|Big|bigg|Bigg)(?![A-Za-z])", ""),
        (r"\\[,;:! ]|\\q?quad(?![A-Za-z])|~", ""), (r"\^\{(\w)\}", r"^$1"), (r"_\{(\w)\}", r"_$1"), (rf"{WS}+", ""), (r"[.,;]+\z", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def escape_prose(c: Column) -> Column:
    """LaTeX specials of prose escaped unless they are already; commands and braces stay."""
    for pattern, to in ((r"(?<!\\)([#%&_$])", r"\\$1"), (r"(?<!\\)\^", r"\\^{}"), (r"(?<!\\)~", r"\\textasciitilde{}")):
        c = F.regexp_replace(c, pattern, to)
    return c


# Commands whose argument is an address or a name, in which nothing is escaped.
VERBATIM = ("url", "href", "path", "nolinkurl", "doi", "ref", "eqref", "label", "cite[a-zA-Z]*")
_DEEP = deep()


def escape_specials(value: Column) -> Column:
    """struct<value, count>: bare & % # _ of a field escaped, outside formulas, escapes and the arguments of VERBATIM commands.

    Dollars that pair up are formulas; an odd number of them are characters, and escaped. Braces nest up to twelve deep.
    """
    literal = r"(?s)\\(?:" + "|".join(VERBATIM) + rf")\s*{_DEEP}|\\."
    paired = F.regexp_count(F.regexp_replace(value, r"(?s)\\.", ""), F.lit(r"\$")) % 2 == 0
    cut = lambda kept: F.regexp_extract_all(value, F.lit(rf"{kept}|[^\\]|\\\z"), F.lit(0))
    pieces = F.when(paired, cut(literal + r"|\$(?>\\.|[^$\\]++)*+\$")).otherwise(cut(literal))
    escaped = F.transform(pieces, lambda x: F.when(x.isin("&", "%", "#", "_", "$"), F.concat(F.lit("\\"), x)).otherwise(x))
    count = F.size(F.filter(pieces, lambda x: x.isin("&", "%", "#", "_", "$")))
    return F.struct(F.array_join(escaped, "").alias("value"), count.alias("count"))


_PIECE = rf"(?s){_DEEP}|\$[^$]*(?:\$|\z)|\\(?:[a-zA-Z]+|.)|[^\s{{}}$\\]+(?![^\s{{}}$\\])|."


def protect_capitals(title: Column) -> Column:
    """struct<value, count>: words with a capital that is not their first letter, braced so that styles keep it.

    A hyphen begins a new part; a part that is one capital counts as well. Words that touch braces, formulas or commands,
    and what these hold, stay.
    """
    pieces = F.regexp_extract_all(title, F.lit(_PIECE), F.lit(0))
    core = lambda x: F.regexp_extract(x, r"\A[(\"'`]*(.*?)[)\"'.,:;!?]*\z", 1)
    part = lambda p, many: p.rlike(r"\A.[^A-Z]*[A-Z]") | (many & p.rlike(r"\A[A-Z]\z"))

    def wants(x: Column, i: Column) -> Column:
        after, word = F.get(pieces, i + 1), core(x)
        glued = F.coalesce(after.rlike(r"\A[{}$\\]"), F.lit(False))
        parts = F.split(word, "-")
        return ~x.rlike(r"\A[\s{}$\\]") & ~glued & (F.length(word) >= 2) & word.rlike("[A-Za-z]") & F.exists(parts, lambda p: part(p, F.size(parts) > 1))

    flags = F.transform(pieces, wants)
    braced = lambda x: F.regexp_replace(x, r"\A([(\"'`]*)(.*?)([)\"'.,:;!?]*)\z", r"$1{$2}$3")
    out = F.transform(F.arrays_zip(pieces.alias("x"), flags.alias("w")), lambda p: F.when(p["w"], braced(p["x"])).otherwise(p["x"]))
    return F.struct(F.array_join(out, "").alias("value"), F.size(F.filter(flags, lambda w: w)).alias("count"))


def column_count(spec: Column) -> Column:
    """Columns that an array specification declares."""
    return F.regexp_count(F.regexp_replace(F.regexp_replace(spec, r"[@!><]\{[^}]*\}", ""), r"[pmb]\{[^}]*\}", "p"), F.lit(r"[lcrpmbX]"))


def preview(c: Column, width: int = 240) -> Column:
    return F.left(c, F.lit(width))


def sniff_format(data: Column, path: Column) -> Column:
    """Image or archive format from magic bytes, else from the extension (which a bitmap's two bytes need to agree with)."""
    head = F.hex(F.substring(data, 1, 12))
    named = F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)), F.lit(""))
    magic = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "255044462D": "pdf", "25215053": "eps", "C5D0D3C6": "eps", "504B0304": "zip", "1F8B": "gz"}
    out = F.when(head.rlike("\\A52494646.{8}57454250"), "webp").when(head.startswith("424D") & (named == "bmp"), "bmp")
    for bytes_, name in magic.items():
        out = out.when(head.startswith(bytes_), name)
    return out.otherwise(F.when(named == "jpg", "jpeg").otherwise(named))


def image_content(colors: Column, sampled: Column) -> Column:
    """What an image holds, by its distinct colours among the pixels sampled: line-art, photo, mixed, or unknown."""
    return F.when(colors.isNull() | (F.coalesce(sampled, F.lit(0)) == 0), "unknown").when(colors <= 256, "line-art").when(colors / sampled >= 0.08, "photo").otherwise("mixed")
