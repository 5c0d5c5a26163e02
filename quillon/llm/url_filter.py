"""URL filters: rules by longest match, and for the rest a path-template tree, with DataFrame functions only.

The tree, per host: the segments of a path, all of them, are generalised from the root down. At a node (the template so
far), a segment stays literal while it holds at least SHARE of the node's URLs and SUPPORT of them; all others are
variable and become one wildcard branch. Then labelled branches of a node are merged, the two neighbours in bad share
that are closest first, as long as each branch of the one is alike to each of the other (two-proportion z-test, |z| < Z).
Merged branches are one node, written {a|b}, with one subtree. A template is rejected if its smoothed labelled purity
(bad + PRIOR / 2) / (n + PRIOR) reaches PURITY: the prior is neutral, so a template with good labels only, or with none, is
never rejected, and one with bad labels only not before it has six. A URL gets the verdict of its template, for which no other
template's labels stand in. In literal segments the characters \\ * | { } are written with a backslash.

Labels are a table (url, bad). Where none is given, the URLs that a rule decides are the labels.

All steps are aggregations to (host, template, segment), which partial aggregation does before any shuffle, so a host
with a third of all rows is no hot key; joins back to the rows are on those small tables, split by AQE where skewed.

Null URLs and URLs without :// have empty host and path and are judged like any other (no rule fits: allow, unless
labels reject the empty template). Repeated rows repeat; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, sized

SHARE = 0.1
SUPPORT = 5
Z = 1.96
PRIOR = 4.0
PURITY = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to /, ? or #, path up to ? or #; host lower-cased in A-Z only."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. rules: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: len(x[1])):
        at, _, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _alike(a: Column, b: Column) -> Column:
    """Whether the bad shares of two branches (n labels, x bad) do not differ by the two-proportion z-test."""
    pooled = (a["x"] + b["x"]) / (a["n"] + b["n"])
    spread = F.sqrt(pooled * (1 - pooled) * (1 / a["n"] + 1 / b["n"]))
    return (spread == 0) | (F.abs(a["x"] / a["n"] - b["x"] / b["n"]) < Z * spread)


def _merged(branches: Column) -> Column:
    """branches: array of (name, n, x), n > 0, at most 1 / SHARE + 1 of them -> array of groups, each an array of branches."""
    share = lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + b["x"]) / F.aggregate(g, F.lit(0.0), lambda s, b: s + b["n"])

    def join_closest(groups: Column, _: Column) -> Column:
        def gap(g: Column, i: Column) -> Column:
            after = F.get(groups, i + 1)
            return F.when(F.forall(g, lambda a: F.forall(after, lambda b: _alike(a, b))), F.struct((share(after) - share(g)).alias("gap"), i.alias("i")))

        gaps = F.transform(F.slice(groups, 1, F.size(groups) - 1), gap)
        at = F.array_min(gaps)["i"]
        both = F.array(F.concat(F.get(groups, at), F.get(groups, at + 1)))
        return F.when(at.isNull(), groups).otherwise(F.concat(F.slice(groups, F.lit(1), at), both, F.slice(groups, at + 3, F.size(groups))))

    ranked = F.array_sort(F.transform(branches, lambda b: F.struct((b["x"] / b["n"]).alias("share"), b["name"].alias("name"), b["n"].alias("n"), b["x"].alias("x"))))
    return F.aggregate(F.slice(branches, 2, F.size(branches)), F.transform(ranked, lambda b: F.array(b)), join_closest)


def _nodes(live: DataFrame) -> DataFrame:
    """Nodes of SUPPORT URLs and more: at, steps: names of the branches by "/" and the literal segment, and by "*" for the wildcard."""
    each = live.groupBy("at", "segment").agg(F.sum("n").alias("own"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    each = materialize(each, "segments")
    node = each.groupBy("at").agg(F.sum("own").alias("whole"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).where(F.col("whole") >= SUPPORT)
    literal = each.where(F.col("own") >= SUPPORT).join(node.select("at", "whole"), "at").where(F.col("own") >= SHARE * F.col("whole"))
    literal = literal.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("segment", F.col("labelled").alias("n"), F.col("bad").alias("x")))).alias("literal"))
    node = node.join(literal, "at", "left")
    known = F.transform(F.coalesce("literal", F.array().cast("array<struct<segment:string,n:bigint,x:bigint>>")), lambda b: F.struct(
        F.concat(F.lit("/"), b["segment"]).alias("key"), F.regexp_replace(b["segment"], r"([\\*|{}])", r"\\$1").alias("name"), b["n"].alias("n"), b["x"].alias("x")
    ))
    node = node.select("at", "labelled", "bad", known.alias("literal"))
    rest = lambda c, f: F.col(c) - F.aggregate("literal", F.lit(0).cast("long"), lambda s, b: s + b[f])
    wild = F.struct(F.lit("*").alias("key"), F.lit("*").alias("name"), rest("labelled", "n").alias("n"), rest("bad", "x").alias("x"))
    node = node.select("at", F.array_append("literal", wild).alias("branches"))
    node = node.select("at", "branches", _merged(F.filter("branches", lambda b: b["n"] > 0)).alias("groups"))
    names = F.transform("groups", lambda g: F.array_sort(F.transform(g, lambda b: b["name"])))

    def step(b: Column) -> Column:
        group = F.get(F.filter(names, lambda g: F.array_contains(g, b["name"])), F.lit(0))
        return F.when(F.size(group) > 1, F.concat(F.lit("{"), F.array_join(group, "|"), F.lit("}"))).otherwise(b["name"])

    return node.select("at", F.map_from_entries(F.transform("branches", lambda b: F.struct(b["key"], step(b)))).alias("steps"))


def _generalised(urls: DataFrame) -> DataFrame:
    """urls(host, path, n, labelled, bad), one row per host and path -> with `templates`, from the host down.

    One round a level. Below a node with fewer than SUPPORT URLs all is variable, so its URLs are done at once, and the
    rounds are as many as the depth that SUPPORT URLs share.
    """
    live = urls.withColumn("segments", F.split(F.regexp_replace("path", r"\A/", ""), "/")).withColumn("templates", F.array("host"))
    done = None
    while True:
        live = live.withColumn("at", F.element_at("templates", -1)).withColumn("segment", F.get("segments", F.size("templates") - 1))
        nodes = materialize(_nodes(live.where("segment is not null")), "nodes")
        now = live.join(sized(nodes), "at", "left")
        left = F.col("segment").isNotNull()
        alone = left & F.col("steps").isNull()
        depth = F.size("segments") - F.size("templates") + 1
        stars = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat("at", F.repeat(F.lit("/*"), i)))
        key = F.concat(F.lit("/"), "segment")
        step = F.coalesce(F.try_element_at("steps", key), F.try_element_at("steps", F.lit("*")))
        templates = F.when(~left, F.col("templates")).when(alone, F.concat("templates", stars)).otherwise(F.array_append("templates", F.concat("at", F.lit("/"), step)))
        ended = ~left | alone | (F.size("templates") >= F.size("segments"))
        now = materialize(now.select("host", "path", "n", "labelled", "bad", "segments", templates.alias("templates"), ended.alias("ended")), "templates")
        ready = now.where("ended").drop("segments", "ended")
        done = ready if done is None else done.union(ready)
        live = now.where("not ended").drop("ended")
        if live.isEmpty():
            return done


def template_verdicts(urls: DataFrame) -> DataFrame:
    """urls(host, path, n, labelled, bad) -> host, path, template, rejected."""
    tree = _generalised(materialize(urls, "urls"))
    tree = tree.select("host", "path", F.element_at("templates", -1).alias("template"), "labelled", "bad")
    nodes = tree.groupBy("template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    bad = nodes.where((F.col("bad") + PRIOR / 2) / (F.col("labelled") + PRIOR) >= PURITY).select("template", F.lit(True).alias("rejected"))
    return tree.join(sized(bad), "template", "left").select("host", "path", "template", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template. labels(url, bad), or the rules' own."""
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", rule.alias("rule"), said.alias("said"))
    if labels is None:
        marks = seen.select("host", "path", F.lit(1).alias("n"), F.col("said").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("said") == "block", F.lit(False)).cast("int").alias("bad"))
    else:
        h, p = split_url(F.col("url"))
        given = labels.where("bad is not null").select(h.alias("host"), p.alias("path"), F.lit(0).alias("n"), F.lit(1).alias("labelled"), F.col("bad").cast("int").alias("bad"))
        marks = seen.select("host", "path", F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad")).union(given)
    urls = marks.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    found = template_verdicts(urls)
    return seen.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template"
    )
