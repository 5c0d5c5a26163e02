"""Mixing sources to target weights by soft domain membership, with DataFrame functions only.

A naive Bayes classifier over hashed words is fitted on a labelled table (text, domain) and gives every document its
posterior over the K domains of the targets. Rates r_d >= 0 are then fitted so that the expected domain token totals
sum_d r_d * tokens_d * p_dk meet the targets T_k: projected gradient on (Ar - T)' inv(G) (Ar - T) / 2 with G = AA',
for which the step length is 1, from r = 1. A step is r <- max(0, r - tokens * p . l), l = inv(G)(Ar - T) holding K
numbers, so r is a fold over the few l so far: no document's rate is ever stored or collected until the end. Once rates
sit at zero, G is taken over the positive ones (a projected Newton step); a step that does not lessen the objective is
dropped and made with the whole G instead.

What reaches the driver: BUCKETS x K word counts once, K + K*K sums a step. Passes over the narrow table (doc, tokens,
posteriors), written once, are one aggregation each.

Nulls: a null or empty text has 0 tokens, the prior as posterior and rate 1. Labelled rows with null or unknown domain
are not used. A domain without any labelled row keeps a smoothed likelihood. A target no document can supply leaves a
residual: the rates are then the least-squares fit, and a warning tells its size. Repeated rows get equal rates; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

BUCKETS = 1024
STEPS = 40
TOLERANCE = 1e-6


def words(text: Column) -> Column:
    """Words of a text between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\x0B\f]+"), lambda w: w != "")


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def _array(xs) -> Column:
    return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in xs) + ")")


def fit_domains(labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log priors (K) and log likelihoods (K, BUCKETS) from labelled(text, domain); Laplace smoothing."""
    known = labelled.where(F.col("domain").isin(domains))
    counts = known.select("domain", F.explode(buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count().collect()
    docs = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    table = np.ones((len(domains), BUCKETS))
    for r in counts:
        table[domains.index(r["domain"]), r["b"]] += r["count"]
    prior = np.array([docs.get(d, 0) + 1.0 for d in domains])
    return np.log(prior / prior.sum()), np.log(table / table.sum(1, keepdims=True))


def posteriors(documents: DataFrame, prior: np.ndarray, likelihood: np.ndarray, temper: float = 0.5) -> DataFrame:
    """documents with `tokens` and `p` (array of K posteriors) instead of text.

    Word evidence is not independent: a document's summed log likelihood ratio is tempered to tokens ** temper words' worth.
    """
    K = len(prior)
    rest = [c for c in documents.columns if c != "text"]
    seen = documents.select(*rest, buckets(F.col("text")).alias("b"))
    ratio = likelihood - likelihood.mean(0)
    add = lambda logs: lambda acc, b: acc + F.get(logs, b)
    logs = [F.aggregate("b", F.lit(0.0), add(_array(row))) for row in ratio]
    scale = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), temper - 1)).otherwise(0.0)
    names = [f"quillon_s{k}" for k in range(K)]
    seen = seen.select(*rest, F.size("b").cast("long").alias("tokens"), *[x.alias(c) for x, c in zip(logs, names, strict=True)])
    seen = seen.select(*rest, "tokens", *[(F.col(c) * scale + float(q)).alias(c) for c, q in zip(names, prior, strict=True)])
    top = F.greatest(*names) if K > 1 else F.col(names[0])
    seen = seen.select(*rest, "tokens", *[F.exp(F.col(c) - top).alias(c) for c in names])
    total = reduce(lambda a, b: a + b, map(F.col, names))
    return seen.select(*rest, "tokens", F.array(*[F.col(c) / total for c in names]).alias("p"))


def rate(history: list[np.ndarray], K: int, unit: float) -> Column:
    """r after the steps so far: a fold of max(0, r - tokens/unit * p . l)."""
    t = F.col("tokens") / F.lit(unit)
    r = F.lit(1.0)
    if not history:
        return r
    steps = F.array(*[_array(x) for x in history])
    dot = lambda l: reduce(lambda a, b: a + b, [F.col("p")[k] * l[k] for k in range(K)])  # noqa: E731,E741
    return F.aggregate(steps, r, lambda acc, l: F.greatest(F.lit(0.0), acc - t * dot(l)))  # noqa: E741


def fit_rates(seen: DataFrame, weights: dict[str, float], budget: float | None = None, floor: bool = False) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Steps for seen(tokens, p): history, token unit, totals before, targets.

    budget: tokens wanted in all, by default those there are. floor=True raises it to the least budget with which no
    domain has to shrink.
    """
    K = len(weights)
    w = np.array(list(weights.values()), float)
    w = w / w.sum()
    sums = [F.sum(F.col("tokens") * F.col("p")[k]).alias(f"t{k}") for k in range(K)]
    grams = [F.sum(F.col("tokens").cast("double") ** 2 * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(K) for j in range(i, K)]
    row = seen.agg(F.count("*").alias("n"), *sums, *grams).first()
    total = np.array([row[f"t{k}"] or 0.0 for k in range(K)])
    want = w * (budget if budget is not None else float((total / w).max()) if floor else total.sum())
    if not total.sum():
        return [], 1.0, total, want
    unit = total.sum() / row["n"]
    def square(sums_) -> np.ndarray:
        out = np.zeros((K, K))
        for i in range(K):
            for j in range(i, K):
                out[i, j] = out[j, i] = (sums_[f"g{i}_{j}"] or 0.0) / unit**2
        return out + np.eye(K) * max(1e-9 * np.trace(out), 1e-12)

    whole = active = square(row)
    history: list[np.ndarray] = []
    now = total
    for _ in range(STEPS):
        if np.abs(now - want).max() <= TOLERANCE * want.sum():
            break
        r = rate([*history, np.linalg.solve(active, (now - want) / unit)], K, unit)
        seen_ = seen.withColumn("x", r)
        moved = seen_.agg(
            *[F.sum(F.col("x") * F.col("tokens") * F.col("p")[k]).alias(f"t{k}") for k in range(K)],
            *[F.sum(F.when(F.col("x") > 0, F.col("tokens").cast("double") ** 2 * F.col("p")[i] * F.col("p")[j])).alias(f"g{i}_{j}") for i in range(K) for j in range(i, K)],
        ).first()
        then = np.array([moved[f"t{k}"] for k in range(K)])
        gain = np.dot(now - want, np.linalg.solve(whole, now - want)) - np.dot(then - want, np.linalg.solve(whole, then - want))
        if gain <= 0 and active is not whole:
            active = whole
            continue
        history.append(np.linalg.solve(active, (now - want) / unit))
        before, now, active = now, then, square(moved)
        if np.abs(now - before).max() <= 0.1 * TOLERANCE * want.sum():
            break
    short = np.abs(now - want).max() / want.sum()
    if short > 1e-3:
        warnings.warn(f"the rates miss a target by {short:.2%} of all tokens: it cannot be met, or {STEPS} steps are too few", stacklevel=2)
    return history, unit, total, want


def mix(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, floor: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, tokens, p, rate; one row for each row, extra columns left out."""
    domains = list(weights)
    prior, likelihood = fit_domains(labelled, domains)
    seen = materialize(posteriors(documents.select("doc_id", "text"), prior, likelihood), "posteriors")
    history, unit, _, _ = fit_rates(seen, weights, budget, floor)
    return seen.withColumn("rate", rate(history, len(domains), unit))


def copies(rate_: Column, *keys: str) -> Column:
    """A whole number of copies whose mean is the rate: the fraction is settled by a hash of the row, so reruns agree."""
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate_) + (u < rate_ - F.floor(rate_)).cast("long")).cast("int")


def mix_rows(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], floor: bool = True) -> DataFrame:
    """The documents themselves, each as many times as its rate says. No text is shuffled.

    With floor=True no domain shrinks, and no document goes: each stays at least once.
    """
    domains = list(weights)
    prior, likelihood = fit_domains(labelled, domains)
    body = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    # Written with the rows: the fit reads the narrow columns only, and nothing below is evaluated over texts again.
    seen = materialize(posteriors(documents.select(body, "text"), prior, likelihood), "posteriors")
    history, unit, _, _ = fit_rates(seen.select("tokens", "p"), weights, None, floor)
    many = F.greatest(F.lit(int(floor)), copies(rate(history, len(domains), unit), "row"))
    kept = seen.select("row", many.alias("many")).where("many > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("many")))).select("row.*")
