"""Quality rules whose cutoffs are selected by risk control.

Each rule rejects a document when one measure exceeds a cutoff. A sequence of nested rule sets is designed on a quarter of
the labelled documents (by hash of doc_id): step by step the rule is added, or the cutoff moved, that rejects the most
further bad documents less WORTH times the good ones. The other labels are the holdouts. In each stratum (each language
that labelled documents have, null its own) the sequence is tested from its first set on: a set passes when the exact
(Clopper-Pearson) upper bound on the rate at which the whole set rejects good documents is at most `risk`, and the last
set before the first that fails is taken. Fixed-sequence testing spends one error level a stratum; `level` is divided
over the strata with labels enough that a set could pass at all (Bonferroni), which their sizes alone decide. So with
probability 1 - `level`, in no stratum more than `risk` of the good documents that pass the base rules are rejected. A
stratum with too few labels gets no rule and so loses nothing, nor does a language without labels.

One narrow Python pass measures every whole text; the labelled counts are one aggregation of bounded size.

Nulls: a null text counts as no words (base_failed); a null lang is a stratum of its own; null or clashing
columns are ignored; repeated rows give repeated results; labels with several rows for a document count each row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, discard, materialize, sized
from quillon.llm.text_scan import Scan

SYMBOLS = b"#*$%&|<>"
#: What the learned rules look at: each is a share or mean that grows as texts get worse.
MEASURES = ("symbol_rate", "upper_rate", "pipe_rate", "dup_line_rate", "repeat_rate", "bang_rate")
GRID = tuple(round(x, 3) for x in (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))
#: Bad documents that must go for each good one, and the least share of the bad ones that a step must add.
WORTH, LEAST_GAIN = 4, 0.01
REPEAT_WINDOW = 5

MEASURE_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"{m} double" for m in MEASURES)
)


def measure(text: str | None) -> tuple:
    """The base counts of a whole text, then the rates the learned rules use."""
    s = Scan(text)
    symbols, dup, rep = s.count(SYMBOLS), s.dup_lines, s.repeat_words(REPEAT_WINDOW)
    chars, words = max(s.chars, 1), max(s.n, 1)
    return (
        s.n, s.chars, symbols, dup, rep,
        symbols / chars, s.upper_words() / words, s.count(b"|") / words, dup / max(len(s.lines), 1),
        rep / words, s.count(b"!") / words,
    )


def measured(text):
    """Column: the measures of a text as a struct of MEASURE_SCHEMA."""

    @F.pandas_udf(MEASURE_SCHEMA)
    def run(col: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in MEASURE_SCHEMA.split(", ")]
        return pd.DataFrame([measure(x) for x in col], columns=names)

    return run(text)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the MEASURE_SCHEMA columns; one pass, no shuffle."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, measured(F.col(text)).alias("m")).select(*rest, "m.*")


def binomial_upper(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound: the largest p with P(Bin(n, p) <= bad) >= level, found by bisection on the exact tail."""
    if n == 0 or bad >= n:
        return 1.0
    logs = list(accumulate((math.log(n - i) - math.log(i + 1) for i in range(bad)), initial=0.0))

    def below(p: float) -> float:
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = bad / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0) or below(mid) < level:
            hi = mid
        else:
            lo = mid
    return hi


@dataclass(frozen=True)
class Cutoffs:
    """cuts[stratum][measure] = the cutoff; a document with a measure over its cutoff is rejected."""

    cuts: dict

    def rejects(self, lang=None, of=F.col):
        """Column: whether a document is rejected; `of` gives the column of a measure."""
        stratum = F.col("lang") if lang is None else lang
        out = F.lit(False)
        for s, by in self.cuts.items():
            for m, cut in by.items():
                out = out | (stratum.eqNullSafe(F.lit(s)) & (of(m) > F.lit(cut)))
        return out


def base_failed(of=F.col):
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def rule_sequence(design: DataFrame) -> list[tuple[str, float]]:
    """The steps (measure, cutoff) of nested rule sets, from design(quality, measures); a later cutoff of a measure replaces an earlier.

    One aggregation a step over what no earlier step rejects. Of equal gains the loosest cutoff, then the first measure is taken.
    """
    steps: list[tuple[str, float]] = []
    least = None
    while True:
        left = design
        for m, cut in steps:
            left = left.where(F.col(m) <= cut)
        counts = left.groupBy("quality").agg(F.count("*").alias("n"), *(F.count_if(F.col(m) > cut).alias(f"{m}@{i}") for m in MEASURES for i, cut in enumerate(GRID)))
        by = {r["quality"]: r for r in counts.collect()}
        if 0 not in by:
            return steps
        least = LEAST_GAIN * by[0]["n"] if least is None else least
        gain = lambda m, i: by[0][f"{m}@{i}"] - (WORTH * by[1][f"{m}@{i}"] if 1 in by else 0)
        best, i, k = max((gain(m, i), i, -k) for k, m in enumerate(MEASURES) for i in range(len(GRID)))
        if best <= 0 or best < least:
            return steps
        steps.append((MEASURES[-k], GRID[i]))


def testable(good: dict, risk: float, level: float) -> list:
    """The strata, of `good` holdouts each, that could pass with no rejection at their share of the level: as many as can."""
    order = sorted(good, key=lambda s: (-good[s], s is None, s or ""))
    for k in range(len(order), 0, -1):
        if binomial_upper(0, good[order[k - 1]], level / k) <= risk:
            return order[:k]
    return []


def select_cutoffs(measures_: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> Cutoffs:
    """Cutoffs per stratum from measures_(doc_id, lang, measures) and labels(doc_id, quality).

    What is collected are counts: 2 x measures x cutoffs a step, then strata x steps.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    held = measures_.where(~base_failed()).join(sized(known), "doc_id")
    held = materialize(held.select("lang", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("design"), *MEASURES), "labelled")
    steps = rule_sequence(held.where("design"))
    at = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        at = F.when(F.col(steps[k][0]) > steps[k][1], F.lit(k)).otherwise(at)
    lost: dict = {}
    for r in held.where("not design and quality = 1").groupBy("lang", at.alias("step")).count().collect():
        lost.setdefault(r["lang"], [0] * (len(steps) + 1))[r["step"]] = r["count"]
    cuts: dict = {}
    strata = testable({s: sum(by) for s, by in lost.items()}, risk, level)
    for stratum in strata:
        for (m, cut), rejected in zip(steps, accumulate(lost[stratum])):
            if binomial_upper(rejected, sum(lost[stratum]), level / len(strata)) > risk:
                break
            cuts.setdefault(stratum, {})[m] = cut
    discard(held)
    return Cutoffs(cuts)


def quality_rules(documents: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """documents(doc_id, text, lang) -> doc_id, n_words, the base counts, base_failed, kept, and the measures."""
    m = materialize(measures(documents.select("doc_id", "lang", "text")), "rules")
    cuts = select_cutoffs(m, labels, risk, level)
    failed = F.coalesce(base_failed(), F.lit(True))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~cuts.rejects()).alias("kept"), *MEASURES,
    )


def kept_documents(documents: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are read twice and never shuffled."""
    m = materialize(measures(documents.select("doc_id", "lang", "text")), "rules")
    cuts = select_cutoffs(m, labels, risk, level)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    seen = documents.select(row, measured(F.col("text")).alias("m"))
    of = lambda name: F.col(f"m.{name}")
    return seen.where(~base_failed(of) & ~cuts.rejects(F.col("row.lang"), of)).select("row.*")
