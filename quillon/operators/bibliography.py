"""Bibliographies as rows: entries and fields of .bib texts, names, keys, validation, duplicates and the keys cited."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.braces import deep, matches
from quillon.functions.text import WS, ascii_fold, bound, normalize_doi, strip, title_key
from quillon.operators.relational import letters

_DEEP = deep()
FIELDS = "array<struct<k:string,v:string>>"
BIB = "entries array<struct<type string, key string, line int, fields array<struct<k string, v string>>>>, problems array<struct<line int, key string, message string>>, kept array<string>"

# Names of months that are known without a definition.
MONTHS = "January February March April May June July August September October November December".split()
_HEAD = re.compile(r"@\s*([A-Za-z][\w-]*)?\s*([{(])?")
_NEXT = re.compile(r"\n[ \t]*@")
_SWALLOWED = re.compile(r"\n[ \t]*@[A-Za-z]+[ \t]*[{(]")
_GAP = re.compile(r"\s*")
_NAME = re.compile(r"[^\s=,{}\"#()]+")
_QUOTED = re.compile(r"\\.|[{}\"]|(?<=\n)@", re.S)


class _Bib:
    """One .bib text, read from left to right. What cannot be read is a problem with its line, and reading goes on at the next line that
    begins with @."""

    def __init__(self, text: str):
        self.text, self.ends = text, matches(text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.macros = {m[:3].lower(): m for m in MONTHS}
        self.entries: list[dict] = []
        self.problems: list[dict] = []
        self.kept: list[str] = []

    def problem(self, at: int, key: str, message: str) -> None:
        self.problems.append({"line": bisect_left(self.breaks, at) + 1, "key": key, "message": message})

    def gap(self, at: int) -> int:
        return _GAP.match(self.text, at).end()

    def recover(self, at: int) -> int:
        found = _NEXT.search(self.text, at)
        return found.end() - 1 if found else len(self.text)

    def stray(self, begin: int, end: int) -> None:
        told, at = False, begin
        for line in self.text[begin:end].split("\n"):
            bare = line.strip()
            if bare.startswith("%"):
                self.kept.append(bare)
            elif bare and not told:
                self.problem(at + line.index(bare[0]), "", "Text outside any entry was ignored")
                told = True
            at += len(line) + 1

    def part(self, at: int, key: str) -> tuple[str, int] | None:
        """One part of a value: braced, quoted, a number or a macro."""
        text, first = self.text, self.text[at : at + 1]
        if first == "{":
            end = self.ends.get(at)
            if end is None or _SWALLOWED.search(text, at, end):
                self.problem(at, key, "Unbalanced braces in a field value - entry cut short here")
                return None
            return text[at + 1 : end - 1], end
        if first == '"':
            depth = 0
            for m in _QUOTED.finditer(text, at + 1):
                if m[0] == "@":
                    break
                depth += (m[0] == "{") - (m[0] == "}")
                if m[0] == '"' and depth <= 0:
                    return text[at + 1 : m.start()], m.end()
            self.problem(at, key, "Unterminated quoted value - entry cut short here")
            return None
        name = _NAME.match(text, at)
        if name is None:
            self.problem(at, key, 'Expected a value ({...}, "...", number or macro)')
            return None
        if name[0][0].isdigit():
            end = re.compile(r"\d+").match(text, at).end()
            return text[at:end], end
        if name[0].lower() not in self.macros:
            self.problem(at, key, f'Undefined @string macro "{name[0]}" - kept as literal text')
        return self.macros.get(name[0].lower(), name[0]), name.end()

    def value(self, at: int, key: str) -> tuple[str, int] | None:
        parts = []
        while True:
            found = self.part(self.gap(at), key)
            if found is None:
                return None
            parts.append(found[0])
            at = self.gap(found[1])
            if self.text[at : at + 1] != "#":
                return " ".join("".join(parts).split()), found[1]
            at += 1

    def block(self, begin: int, at: int, kind: str) -> int:
        """@comment and @preamble: kept as written."""
        end = self.ends.get(at) if self.text[at] == "{" else self.text.find(")", at) + 1 or None
        if end is None:
            self.problem(begin, "", f"Unclosed @{kind} - skipped to the next entry")
            return self.recover(at)
        self.kept.append(self.text[begin:end])
        return end

    def macro(self, begin: int, at: int, close: str) -> int:
        at = self.gap(at + 1)
        name = _NAME.match(self.text, at)
        equals = self.gap(name.end()) if name else at
        if not name or self.text[equals : equals + 1] != "=":
            self.problem(begin, "", "Malformed @string - expected name = value")
            return self.recover(at)
        found = self.value(equals + 1, "@string")
        if found is None:
            return self.recover(equals)
        self.macros[name[0].lower()] = found[0]
        at = self.gap(found[1])
        return at + (self.text[at : at + 1] == close)

    def entry(self, begin: int, at: int, kind: str, close: str) -> int:
        text = self.text
        key = re.compile(r"[^,\s}){(]*").match(text, at + 1)
        at, key = key.end(), key[0]
        fields: set[str] = set()
        if not key:
            self.problem(begin, "", f"Entry @{kind} has no cite key")
        self.entries.append({"type": kind, "key": key, "line": bisect_left(self.breaks, begin) + 1, "fields": (listed := [])})
        while True:
            at = self.gap(at)
            if at >= len(text) or text[at] == "@" and text[at - 1] == "\n":
                self.problem(begin, key, "Entry is never closed")
                return at
            if text[at] == close:
                return at + 1
            if text[at] == ",":
                at += 1
                continue
            name = _NAME.match(text, at)
            equals = self.gap(name.end()) if name else at
            if not name or text[equals : equals + 1] != "=":
                self.problem(at, key, f'Field "{name[0]}" has no "= value" - skipped to the next entry' if name else f'Unexpected "{text[at]}" - skipped to the next entry')
                return self.recover(at)
            found = self.value(equals + 1, key)
            if found is None:
                return self.recover(at)
            if name[0].lower() in fields:
                self.problem(at, key, f'Duplicate field "{name[0].lower()}" - first one kept')
            else:
                fields.add(name[0].lower())
                listed.append({"k": name[0].lower(), "v": found[0]})
            at = self.gap(found[1])
            if at < len(text) and text[at] not in (",", close):
                self.problem(at, key, f'Missing comma after field "{name[0].lower()}"')

    def read(self) -> _Bib:
        at, text = 0, self.text
        while at < len(text):
            begin = text.find("@", at)
            self.stray(at, begin if begin >= 0 else len(text))
            if begin < 0:
                break
            head = _HEAD.match(text, begin)
            if not head[1]:
                self.problem(begin, "", "Stray @ ignored")
                at = begin + 1
            elif not head[2]:
                self.problem(begin, "", f"Expected {{ after @{head[1]}")
                at = head.end()
            else:
                kind, open_, close = head[1].lower(), head.end() - 1, "}" if head[2] == "{" else ")"
                at = self.block(begin, open_, kind) if kind in ("comment", "preamble") else self.macro(begin, open_, close) if kind == "string" else self.entry(begin, open_, kind, close)
        return self


def scan(bibs: DataFrame, text: str = "text") -> DataFrame:
    """bibs(..., text) -> the other columns and bib: struct<entries, problems, kept> of the text, read once in linear time."""

    @F.pandas_udf(BIB)
    def run(texts: pd.Series) -> pd.DataFrame:
        read = [_Bib(x or "").read() for x in texts]
        return pd.DataFrame({"entries": [b.entries for b in read], "problems": [b.problems for b in read], "kept": [b.kept for b in read]})

    return bibs.select(*[c for c in bibs.columns if c != text], run(text).alias("bib"))


def parse_problems(bibs: DataFrame, text: str = "text") -> DataFrame:
    """bibs(..., text) -> the other columns, line, key and message of what could not be read as it stands."""
    found = scan(bibs, text)
    return found.select(*[c for c in found.columns if c != "bib"], F.explode("bib.problems").alias("p")).select("*", "p.*").drop("p")


def _first_of_each(named: Column) -> Column:
    """A list of (k, v) without later ones of a k."""
    empty = F.array().cast(FIELDS)
    return F.aggregate(named, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))


def entries(bibs: DataFrame, text: str = "text") -> DataFrame:
    """bibs(..., text) -> the other columns, seq, type, key and fields (map of lower-case names; the first of a name counts).

    Values joined by # are concatenated, names of months and of @string are replaced by their text (unknown ones stay), and white
    space in a value is one space. Braces nest to any depth. An entry that is cut short keeps the fields before the cut.
    """
    found = scan(bibs, text)
    rest = [c for c in found.columns if c != "bib"]
    return found.select(*rest, F.posexplode("bib.entries").alias("seq", "e")).select(*rest, "seq", "e.type", "e.key", F.map_from_entries("e.fields").alias("fields"))


def _cut(c: Column, separator: str) -> Column:
    """Stretches of c between separators that are not escaped and in no braces."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)\\.|{_DEEP}|(?:{separator})|."), F.lit(0))
    return F.split(F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(rf"\A(?:{separator})\z"), "\u0001").otherwise(x)), ""), "\u0001")


def words(c: Column) -> Column:
    """Words of a name, at white space and ties outside braces."""
    return F.filter(_cut(c, rf"{WS}|~"), lambda x: x != "")


def split_authors(field: Column) -> Column:
    """Names of an author field, at the word `and` outside braces."""
    marked = F.transform(words(field), lambda w: F.when(F.lower(w) == "and", "\u0001").otherwise(w))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def _lower_word(w: Column) -> Column:
    letter = F.regexp_extract(F.regexp_replace(w, rf"\A\{{?\\(?:[a-zA-Z]+{WS}*|[^a-zA-Z])", ""), "[A-Za-z]", 0)
    return ~(w.startswith("{") & ~w.startswith("{\\")) & (letter != "") & (letter == F.lower(letter))


def _join(ws: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(ws, begin + 1, F.greatest(n, F.lit(0))), " ")


def parse_name(name: Column) -> Column:
    """struct<first, von, last, jr, literal> of a name in any of its forms: First von Last; von Last, First; von Last, Jr, First."""
    no = F.lit("")

    def form(first=no, von=no, last=no, jr=no, literal=None) -> Column:
        literal = F.lit(None).cast("string") if literal is None else literal
        return F.struct(first.alias("first"), von.alias("von"), last.alias("last"), jr.alias("jr"), literal.alias("literal"))

    def lower(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: _lower_word(w) & (i < F.size(ws) - 1))

    def plain(ws: Column) -> Column:  # the last word is never a von
        n = F.size(ws)

        def cut(low: Column) -> Column:
            at = F.array_position(low, F.lit(True))
            von = F.when(at > 0, at - 1).otherwise(n - 1).cast("int")

            def split(v: Column) -> Column:
                last = (F.array_position(F.slice(low, v + 1, n), F.lit(False)) - 1 + v).cast("int")
                return form(_join(ws, F.lit(0), v), _join(ws, v, last - v), _join(ws, last, n - last))

            return bound(von, split)

        return F.when(n <= 1, form(last=F.coalesce(F.get(ws, F.lit(0)), no))).otherwise(bound(lower(ws), cut))

    def inverted(parts: Column) -> Column:
        many = F.size(parts) > 2
        first = F.when(many, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1))), ", ")).otherwise(F.get(parts, F.lit(1)))
        jr = F.when(many, F.get(parts, F.lit(1))).otherwise(no)
        head = lambda ws: bound((F.array_position(lower(ws), F.lit(False)) - 1).cast("int"), lambda k: form(first, _join(ws, F.lit(0), k), _join(ws, k, F.size(ws) - k), jr))
        return bound(words(F.get(parts, F.lit(0))), head)

    def whole(t: Column) -> Column:
        of = lambda parts: F.when(F.size(parts) == 1, bound(words(t), plain)).otherwise(inverted(parts))
        braced = t.rlike(rf"(?s)\A{_DEEP}\z")
        return F.when(F.lower(t) == "others", form(literal=F.lit("others"))).when(braced, form(last=t, literal=t)).otherwise(bound(F.transform(_cut(t, ","), strip), of))

    return bound(strip(name), whole)


def format_name(p: Column) -> Column:
    """`von Last, Jr, First` with spaced and dotted initials; braced names and `others` as they are."""
    dotted = lambda w: F.when(w.rlike(r"\A[A-Z]\z"), F.concat(w, F.lit("."))).when(w.rlike(r"\A([A-Z]\.){2,}\z"), F.trim(F.regexp_replace(w, r"\.", ". "))).otherwise(w)
    first = F.regexp_replace(F.array_join(F.transform(words(p["first"]), dotted), " "), rf"{WS}+", " ")
    last = F.concat(F.when(p["von"] != "", F.concat(p["von"], F.lit(" "))).otherwise(""), p["last"])
    shown = lambda x: F.when(p["jr"] != "", F.concat_ws(", ", last, p["jr"], x)).when(x != "", F.concat_ws(", ", last, x)).otherwise(last)
    return F.coalesce(p["literal"], bound(first, shown))


def normalize_authors(field: Column) -> Column:
    """The names of an author field in one form, joined by `and`."""
    return F.array_join(F.transform(F.transform(split_authors(field), parse_name), format_name), " and ")


# Words that no key is made of; fields that each type needs (a|b: either); the order of fields.
STOPWORDS = "a an the on of towards toward to in for and or with via at by from into is are do does how what why when which can we beyond about".split()
REQUIRED = {
    "article": "author title journal|journaltitle year|date", "book": "author|editor title publisher year|date", "booklet": "title",
    "inbook": "author|editor title chapter|pages publisher year|date", "incollection": "author title booktitle publisher year|date",
    "inproceedings": "author title booktitle year|date", "conference": "author title booktitle year|date", "manual": "title",
    "mastersthesis": "author title school|institution year|date", "phdthesis": "author title school|institution year|date",
    "thesis": "author title school|institution year|date", "misc": "", "online": "title url|doi", "proceedings": "title year|date",
    "techreport": "author title institution year|date", "report": "author title institution year|date", "unpublished": "author title note",
}
FIELD_ORDER = "author title journal booktitle editor volume number pages year publisher doi url".split()


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def with_base_keys(found: DataFrame, word_in_key: bool = True) -> DataFrame:
    """entries(key, fields, ...) with base: family name, year and the title's first word that tells; or name and year."""
    known = lambda c: F.when(c != "", c)
    people = F.coalesce(known(_field("author")), _field("editor"))
    first = parse_name(F.coalesce(F.get(split_authors(people), F.lit(0)), F.lit("")))
    family = bound(first, lambda p: F.when(p["literal"].eqNullSafe("others"), "").otherwise(p["last"]))
    year = F.coalesce(known(F.regexp_extract(_field("year"), r"\d{4}", 0)), F.regexp_extract(_field("date"), r"\d{4}", 0))
    folded = found.withColumn("_name", ascii_fold(family)).withColumn("_title", ascii_fold(F.regexp_replace(_field("title"), r"\$[^$]*\$", " ")))
    telling = F.filter(F.split(F.lower("_title"), "[^a-z0-9]+"), lambda w: w.rlike("[a-z]") & ~w.isin(*STOPWORDS))
    folded = folded.withColumn("_name", F.regexp_replace("_name", "[^A-Za-z0-9]", "")).withColumn("_word", F.coalesce(F.get(telling, F.lit(0)), F.lit("")))
    if word_in_key:
        made = F.concat(F.coalesce(known(F.lower("_name")), F.lit("anon")), year, "_word")
    else:
        who = F.coalesce(known(F.col("_name")), known(F.col("_word")), F.lit("Anon"))
        made = F.concat(F.upper(F.left(who, F.lit(1))), F.substring(who, F.lit(2), F.length(who)), year)
    own = (F.col("_name") == "") & (F.col("_word") == "") & (F.col("key") != "")
    return folded.withColumn("base", F.when(own, F.col("key")).otherwise(made)).drop("_name", "_title", "_word")


def with_keys(found: DataFrame, file: str, word_in_key: bool = True) -> DataFrame:
    """found with new_key: base keys, those that several entries of a file share with letters a, b, ... in their order."""
    over = Window.partitionBy(file, "base")
    rank, many = F.row_number().over(over.orderBy("seq")), F.count("*").over(over) > 1
    return with_base_keys(found, word_in_key).withColumn("new_key", F.when(many, F.concat("base", letters(rank))).otherwise(F.col("base"))).drop("base")


def problems(found: DataFrame) -> DataFrame:
    """The columns but fields, and message: what an entry lacks, for each."""
    missing = lambda t, need: [F.when(~_any_of(alt.split("|")), f"@{t} is missing {' or '.join(alt.split('|'))}") for alt in need.split()]
    checks = F.when(~F.col("type").isin(*REQUIRED), F.array(F.concat(F.lit("unknown type @"), "type")))
    for t, need in REQUIRED.items():
        if need:
            checks = checks.when(F.col("type") == t, F.array(*missing(t, need)))
    year = F.when((_field("year") != "") & ~_field("year").rlike(r"\A\d{4}\z"), F.concat(F.lit("year "), _field("year"), F.lit(" has not four digits")))
    untitled = F.when((F.col("type") == "misc") & (_field("title") == ""), "@misc has no title")
    every = F.concat(F.coalesce(checks, F.array().cast("array<string>")), F.array(year, untitled))
    return found.select(*[c for c in found.columns if c != "fields"], F.explode(F.filter(every, lambda x: x.isNotNull())).alias("message"))


def _any_of(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (_field(n) != "")
    return out


def format_entry(key: str = "key") -> Column:
    """An entry(type, key, fields) as text, its fields in their usual order and then by name."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(FIELD_ORDER) for x in (n, i)])
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda f: F.struct(F.coalesce(F.try_element_at(rank, f["key"]), F.lit(len(FIELD_ORDER))).alias("r"), f["key"].alias("k"), f["value"].alias("v"))))
    lines = F.transform(pairs, lambda p: F.concat(F.lit("  "), p["k"], F.lit(" = {"), p["v"], F.lit("}")))
    return F.concat(F.lit("@"), "type", F.lit("{"), key, F.when(F.size(lines) > 0, F.concat(F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))).otherwise(F.lit("\n}")))


def _slots(file: str, kind: str):
    """For the entries of one file in order: the entry whose place each takes, and its precedence there (0: its type and key count)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq")
        by_doi, by_title, slots = {}, {}, {}  # slots: seq -> [order of entries, names filled, doi]
        for seq, doi, title, filled in zip(g.seq, g.doi, g.title, g.filled, strict=True):
            at = by_doi.get(doi) if doi else None
            if at is None and len(title) >= 12 and (t := by_title.get(title)) is not None and (not doi or not slots[t][2] or slots[t][2] == doi):
                at = t
            if at is None:
                slots[at := seq] = [[seq], set(filled), doi]
                if len(title) >= 12:
                    by_title[title] = seq
            else:
                order, names, own = slots[at]
                slots[at] = [[seq, *order] if len(filled) > len(names) else [*order, seq], names | set(filled), own or doi]
            for d in (doi, slots[at][2]):
                if d:
                    by_doi[d] = at
        rows = [(g[file].iloc[0], s, at, k) for at, (order, _, _) in slots.items() for k, s in enumerate(order)]
        return pd.DataFrame(rows, columns=[file, "seq", "slot", "rank"])

    return run, f"`{file}` {kind}, seq int, slot int, rank int"


def merged(found: DataFrame, file: str) -> DataFrame:
    """(file, seq, type, key, fields, keys): duplicates of a file as one entry at the first one's place, with all their keys.

    Entries of one DOI are one, else those of one title of 12 letters or more whose DOIs do not differ. The entry with the
    most filled fields gives type and key; a field that it lacks or leaves blank is taken from the others. A file is one
    document, so its entries' ids and titles are compared in one task; all fields are merged as columns.
    """
    filled = F.transform(F.filter(F.map_entries("fields"), lambda f: f["value"] != ""), lambda f: f["key"])
    narrow = found.select(file, "seq", normalize_doi(_field("doi")).alias("doi"), title_key(_field("title")).alias("title"), filled.alias("filled"))
    run, schema = _slots(file, found.schema[file].dataType.simpleString())
    places = narrow.groupBy(file).applyInPandas(run, schema)
    named = F.transform(F.map_entries("fields"), lambda f: F.struct(f["key"].alias("k"), f["value"].alias("v")))
    rows = found.join(places, [file, "seq"]).select(file, "slot", F.struct("rank", "type", "key", "seq", named.alias("named")).alias("e"))
    one = rows.groupBy(file, "slot").agg(F.array_sort(F.collect_list("e")).alias("es"))
    whole = F.flatten(F.transform("es", lambda e: e["named"]))
    full = F.concat(F.filter(whole, lambda f: f["v"] != ""), F.filter(whole, lambda f: f["v"] == ""))
    first = F.get("es", F.lit(0))
    keys = F.transform(F.array_sort(F.transform("es", lambda e: F.struct(e["seq"], e["key"].alias("k")))), lambda e: e["k"])
    return one.select(file, F.col("slot").alias("seq"), first["type"].alias("type"), first["key"].alias("key"), F.map_from_entries(_first_of_each(full)).alias("fields"), keys.alias("keys"))


def key_map(kept: DataFrame, file: str, key: str = "key") -> DataFrame:
    """(file, old, new) from merged entries: each key that was merged with the one that stays; of a key used twice, the first."""
    rows = kept.select(file, F.posexplode("keys").alias("i", "old"), F.col(key).alias("new"), "seq")
    return rows.groupBy(file, "old").agg(F.min_by("new", F.struct("seq", "i")).alias("new"))


_CITE = r"\\(?!citestyle)[a-zA-Z]*cite[a-zA-Z]*\*?(?:\s*\[[^\]]*\]|\s*\([^()]*\))*\s*\{[^{}]*\}"
_CITES = r"\\[a-zA-Z]*cites\*?(?:(?:\s*\[[^\]]*\]|\s*\([^()]*\))*\s*\{[^{}]*\})+"


def rewrite_cites(texts: DataFrame, keys: DataFrame, file: str, text: str = "text") -> DataFrame:
    """texts(file, text) with the keys cited replaced by keys(file, old, new), a join on (file, key): file, text, replaced, missing.

    Two keys of one list that become one are cited once. missing: cited keys that are neither old nor new ones, sorted.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"(?s){_CITES}|{_CITE}|(?:(?!\\[a-zA-Z]*cite).)+|\\"), F.lit(0))
    pieces = texts.select(file, F.posexplode(cut).alias("p", "piece"))
    is_cite = F.col("piece").rlike(rf"(?s)\A(?:{_CITES}|{_CITE})\z")
    bits = F.when(is_cite, F.regexp_extract_all("piece", F.lit(r"(?s)\[[^\]]*\]|\([^()]*\)|\{[^{}]*\}|[^\[({]+|."), F.lit(0))).otherwise(F.array("piece"))
    rows = pieces.select(file, "p", is_cite.alias("cite"), F.posexplode(bits).alias("q", "bit"))
    rows = rows.withColumn("list", F.col("cite") & F.col("bit").startswith("{"))
    each = rows.where("list").select(file, "p", "q", F.posexplode(F.split(F.expr("substring(bit, 2, length(bit) - 2)"), ",")).alias("i", "raw"))
    each = each.withColumn("old", F.trim("raw")).join(keys.select(file, "old", "new"), [file, "old"], "left")
    known = keys.select(file, F.col("new").alias("old"), F.lit(True).alias("known")).distinct()
    each = each.join(known, [file, "old"], "left")
    to = F.coalesce("new", "old")
    first = F.row_number().over(Window.partitionBy(file, "p", "q", to).orderBy("i")) == 1
    each = each.withColumn("keep", first | F.col("new").isNull()).withColumn("shown", F.when(F.col("new").isNull(), F.col("raw")).otherwise(F.replace("raw", "old", "new")))
    lists = each.groupBy(file, "p", "q").agg(
        F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("i", "shown")))).alias("l"),
        F.count_if(F.col("new") != F.col("old")).alias("n"),
        F.collect_set(F.when(F.col("new").isNull() & F.col("known").isNull() & ~F.col("old").isin("", "*"), F.col("old"))).alias("m"),
    )
    whole = rows.join(lists, [file, "p", "q"], "left")
    shown = F.when(F.col("list"), F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: x["shown"]), ","), F.lit("}"))).otherwise(F.col("bit"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "q", shown.alias("s"))))
    return whole.groupBy(file).agg(
        F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("text"), F.coalesce(F.sum("n"), F.lit(0)).alias("replaced"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("missing"),
    )
