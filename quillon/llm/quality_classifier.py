"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w.x, x its standardised features. The model says that of a good and a bad document the good
one wins with probability sigmoid(w.x_good - w.x_bad); w minimises the logistic loss over all pairs of a good and a bad
labelled row. Documents are then thresholded at a quantile of the strengths: the share of bad documents among the
labels. The reported score is sigmoid((strength - threshold) / scale + logit(cut)), so that score >= cut exactly when
the strength reaches that quantile.

One Python pass turns whole texts into FEATURES; those narrow rows are written once and serve training and scoring.
No row and no pair is left out of the fit, nor is any pair spelt out: strengths are binned, and within a bin the loss is a power
series in the distance from the middle, so sums over all pairs follow from ORDER power sums of each label and bin. Newton's
steps are two aggregations over the labelled rows each; the threshold is a rank, narrowed down by counts. What reaches
the driver are sums by bin, however many rows there are.

Nulls: a null text is an empty one and gets a score as well; labels with null quality are not used; without labels of
both kinds every document scores `cut`, predicted 1. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, discard, materialize, sized
from quillon.llm.text_scan import Scan

#: Width of a bin of strengths and terms of the series in it: the next term is below (BIN / pi) ** ORDER, 1e-10.
BIN, ORDER = 0.25, 9
#: Lengths of Newton's step that are tried together, and most steps.
LENGTHS, STEPS = (1.0, 2.0, 4.0, 0.25, 2.0**-6), 100
#: Preference pairs that `fit` draws.
PAIRS = 200_000
#: Documents with a score of at least CUT are predicted good.
CUT = 0.3

FEATURES = (
    "log_words", "word_len", "symbols", "punct", "bang", "pipe", "upper", "digits", "dup_lines", "repeats",
    "distinct", "line_words", "short_lines", "long_words", "top_word", "sentence_end", "non_ascii", "first_upper", "colon", "url", "entropy",
)


def features(text: str | None) -> list[float]:
    s = Scan(text)
    n, chars, size = max(s.n, 1), max(s.chars, 1), max(len(s.raw), 1)
    lines = s.lines or [""]
    if s.n:
        first, last, length = s.bytes[s.starts], s.bytes[s.ends - 1], s.ends - s.starts
        ends = float(np.isin(last, (33, 46, 63)).sum())
        capital, long, top = float(((first >= 65) & (first <= 90)).sum()), float((length > 25).sum()), float(np.bincount(s.ids).max())
    else:
        ends = capital = long = top = 0.0
    share = s.counts[s.counts > 0] / size
    return [
        np.log1p(s.n), chars / n, s.count(b"#*$%&|<>^~_=") / chars, s.count(b".,;:'\"()-") / n, s.count(b"!?") / n, s.count(b"|") / n,
        s.upper_words() / n, s.count(b"0123456789") / chars, s.dup_lines / len(lines), s.repeat_words() / n, s.n_ids / n,
        np.log1p(s.n / len(lines)), sum(1 for x in lines if len(x) < 30) / len(lines), long / n, top / n, ends / n,
        float(s.counts[128:].sum()) / chars, capital / n, s.count(b":;") / n, (s.text.count("http") + s.count(b"@")) / n,
        float(-(share * np.log(share)).sum()),
    ]


def feature_column(text):
    """Column: a text's FEATURES in order."""

    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in col])

    return run(text)


def featurize(df: DataFrame) -> DataFrame:
    """df without its text, with x array<double>."""
    bounded_batches(df.sparkSession)
    return df.select(*[c for c in df.columns if c != "text"], feature_column(F.col("text")).alias("x"))


@dataclass(frozen=True)
class Ranking:
    """strength = (expanded x - mean) / std . weights."""

    mean: list
    std: list
    weights: list
    threshold: float
    scale: float

    def strength(self, x):
        z = F.lit(0.0)
        for i, (m, s, w) in enumerate(zip(self.mean, self.std, self.weights, strict=True)):
            # square-rooted rates and plain ones: a rare sign of junk is not lost beside a frequent one
            v = x[i % len(FEATURES)]
            v = F.sqrt(F.abs(v)) if i >= len(FEATURES) else v
            z = z + (v - m) / s * w
        return z

    def score(self, x, cut: float = CUT):
        """The score as a column expression of the feature array: 0 to 1, at least `cut` from the threshold on."""
        z = (self.strength(x) - self.threshold) / self.scale
        score = F.lit(1.0) / (1 + F.exp(-(z + float(np.log(cut / (1 - cut))))))
        return F.when(z >= 0, F.greatest(score, F.lit(cut))).otherwise(score)


def expand(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.abs(x))])


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, steps: int = 300, ridge: float = 1e-4, seed: int = 7) -> Ranking:
    """The fit for arrays in memory: logistic loss on differences of drawn (good, bad) pairs, by Nesterov steps from zero. Tables: train()."""
    width = 2 * len(FEATURES)
    if not len(good) or not len(bad):
        return Ranking([0.0] * width, [1.0] * width, [0.0] * width, 0.0, 1.0)
    good, bad = expand(good), expand(bad)
    both = np.vstack([good, bad])
    mean, std = both.mean(0), both.std(0)
    std[std < 1e-9] = 1.0
    g, b = (good - mean) / std, (bad - mean) / std
    rng = np.random.default_rng(seed)
    d = g[rng.integers(0, len(g), pairs)] - b[rng.integers(0, len(b), pairs)]
    w = v = np.zeros(width)
    rate = 1.0 / (0.25 * np.linalg.norm(d.T @ d / pairs, 2) + ridge)
    for k in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ v, -50, 50)))
        new = v + rate * (d.T @ p / pairs - ridge * v)
        v, w = new + k / (k + 3) * (new - w), new
    s = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - bad_share) / len(g)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(s)
    at = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share)), len(s) - 2)
    threshold = float((s[order[at]] + s[order[at + 1]]) / 2)
    scale = float(max(np.median(np.abs(s - threshold)) / 3, 1e-6))
    return Ranking(mean.tolist(), std.tolist(), w.tolist(), threshold, scale)


def _by_bin(strengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each strength, and the powers h ** k / k! of its distance h from the middle."""
    at = np.floor(strengths / BIN).astype(np.int64)
    h = strengths - (at + 0.5) * BIN
    factors = np.hstack([np.ones((len(h), 1)), h[:, None] / np.arange(1, ORDER)])
    return at, np.cumprod(factors, axis=1)


def _standardised(batch, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and standardised features of an Arrow batch (quality, x)."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return batch.column("quality").to_numpy(zero_copy_only=False), (expand(x) - mean) / std


def _sums(rows: DataFrame, run, keys: str, width: int) -> pd.DataFrame:
    """The vectors v0, v1, ... that run() gives for each batch, added up by keys, in their order."""
    names, vectors = keys.replace(" long", "").split(", "), [f"v{k}" for k in range(width)]
    found = rows.mapInArrow(run, ", ".join([keys, *[f"{v} double" for v in vectors]]))
    return found.groupBy(*names).agg(*[F.sum(v).alias(v) for v in vectors]).toPandas().sort_values(names)


def _rows(keys: list, vectors: np.ndarray) -> pa.RecordBatch:
    n = vectors.shape[1]
    return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], *[pa.array(v) for v in vectors.T]], names=[*[f"k{i}" for i in range(len(keys))], *[f"v{k}" for k in range(n)]])


def _power_sums(rows: DataFrame, mean, std, tried: list[np.ndarray]) -> list[dict]:
    """For each weights in `tried`: label -> (bins, their power sums)."""

    def run(batches):
        for batch in batches:
            q, z = _standardised(batch, mean, std)
            for c, w in enumerate(tried):
                at, powers = _by_bin(z @ w)
                keys, of = np.unique(2 * at + q, return_inverse=True)
                v = np.column_stack([np.bincount(of, p, len(keys)) for p in powers.T])
                yield _rows([np.full(len(keys), c), keys & 1, keys >> 1], v)

    got = _sums(rows, run, "k0 long, k1 long, k2 long", ORDER)
    parts = [[got[(got.k0 == c) & (got.k1 == q)] for q in (0, 1)] for c in range(len(tried))]
    return [{q: (p.k2.to_numpy(), p[[f"v{k}" for k in range(ORDER)]].to_numpy()) for q, p in enumerate(both)} for both in parts]


def pair_sums(sums: dict) -> tuple[float, dict, np.ndarray]:
    """From power sums by label: the loss over all pairs; label -> bin -> series of the chance that a row loses, summed over
    the rows it is paired with; and the matrix of slopes of that chance between the middles of bins, good by bad."""
    (bad_at, bad), (good_at, good) = sums[0], sums[1]
    sign = (-1.0) ** np.arange(ORDER)
    bad = bad * sign
    loss, lose_good, lose_bad, slopes = 0.0, np.zeros_like(good), np.zeros_like(bad), []
    for k0 in range(0, len(good_at), 256):  # so many bins at a time
        part = slice(k0, k0 + 256)
        u = (good_at[part, None] - bad_at) * BIN
        p = np.exp(-np.logaddexp(0.0, u))  # that the bad one wins
        slopes.append(p - p * p)
        # the derivatives of order m: of the loss, and of p as polynomials of p, where d p / d u = p * p - p
        of_loss, polynomial = np.logaddexp(0.0, -u), np.polynomial.Polynomial([0.0, 1.0])
        for m in range(ORDER):
            of_p = polynomial(p)
            for k in range(m + 1):
                loss += good[part, k] @ of_loss @ bad[:, m - k]
                lose_good[part, k] += of_p @ bad[:, m - k]
                lose_bad[:, m - k] += good[part, k] @ of_p
            of_loss, polynomial = -of_p, polynomial.deriv() * np.polynomial.Polynomial([0.0, -1.0, 1.0])
    return float(loss), {0: lose_bad * sign, 1: lose_good}, np.vstack(slopes)


def _slopes(rows: DataFrame, mean, std, w: np.ndarray, sums: dict) -> tuple[np.ndarray, np.ndarray]:
    """Over all pairs, the sum of what raises w's fit, and a positive matrix near the second derivative: slopes between bins' middles."""
    _, lose, slope = pair_sums(sums)
    bins, width = {q: sums[q][0] for q in sums}, len(w)
    weight = {1: slope @ sums[0][1][:, 0], 0: sums[1][1][:, 0] @ slope}

    def run(batches):
        for batch in batches:
            q, z = _standardised(batch, mean, std)
            at, powers = _by_bin(z @ w)
            for label in (0, 1):
                of, mine = at[q == label], z[q == label]
                i = np.searchsorted(bins[label], of)
                chance = (lose[label][i] * powers[q == label]).sum(1)
                met, here = np.unique(of, return_inverse=True)
                by_bin = np.zeros((len(met), width))
                np.add.at(by_bin, here, mine)
                v = np.vstack([(chance if label else -chance) @ mine, mine.T @ (mine * weight[label][i][:, None]), by_bin])
                yield _rows([np.repeat([0, 1, 2 + label], [1, width, len(met)]), np.concatenate([[0], np.arange(width), met])], v)

    got = _sums(rows, run, "k0 long, k1 long", width)
    of = lambda kind: got[got.k0 == kind].drop(columns=["k0", "k1"]).to_numpy()
    both = of(3).T @ slope @ of(2)
    return of(0)[0], of(1) - both - both.T


def at_rank(values: DataFrame, rank: int) -> list[float]:
    """The values (v double) at `rank` and the next one in ascending order, from 0: exact, by counts over ever narrower ranges."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        at = F.least(F.floor((F.col("v") - low) / (high - low) * 1024), F.lit(1023))
        found = values.where(F.col("v").between(low, high)).groupBy(at.alias("at")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(found, key=lambda r: r["at"]):
            if below + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    up_to, following = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return [low, low if up_to > rank + 1 or following is None else following]


def train(feats: DataFrame, labels: DataFrame, ridge: float = 1e-4) -> Ranking:
    """Fit on all labelled rows and all their pairs; feats(doc_id, x), labels(doc_id, quality)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("long").alias("quality"))
    rows = materialize(feats.join(sized(known), "doc_id").select("quality", "x"), "labelled")
    n = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    width = 2 * len(FEATURES)
    if len(n) < 2:
        discard(rows)
        return Ranking([0.0] * width, [1.0] * width, [0.0] * width, 0.0, 1.0)
    v, root = F.col("v"), F.sqrt(F.abs("v"))
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg(v), F.avg(root), F.stddev_pop(v), F.stddev_pop(root)).orderBy("i").collect()
    # rounded, so that the order in which Spark adds up does not show
    mean, std = (np.array([float(f"{r[k + j]:.12g}") for j in (0, 1) for r in moments]) for k in (1, 3))
    std[std < 1e-9] = 1.0
    w, pairs = np.zeros(width), n[0] * n[1]
    sums = _power_sums(rows, mean, std, [w])[0]
    for _ in range(STEPS):
        up, bend = _slopes(rows, mean, std, w, sums)
        step = np.linalg.solve(bend / pairs + ridge * np.eye(width), up / pairs - ridge * w)
        if np.abs(step).max() < 1e-6:
            w = w + step
            break
        tried = [w + step * t for t in LENGTHS]
        found = _power_sums(rows, mean, std, tried)
        losses = [pair_sums(f)[0] / pairs + ridge / 2 * float(t @ t) for f, t in zip(found, tried, strict=True)]
        best = int(np.argmin(losses))
        best = best if losses[best] < losses[0] * (1 - 1e-6) else 0
        w, sums = tried[best], found[best]
    model = Ranking(mean.tolist(), std.tolist(), np.round(w, 9).tolist(), 0.0, 1.0)
    strengths = materialize(rows.select(model.strength(F.col("x")).alias("v")), "strengths")
    threshold = sum(at_rank(strengths, n[0] - 1)) / 2
    total = n[0] + n[1]
    middle = at_rank(strengths.select(F.abs(F.col("v") - threshold).alias("v")), (total - 1) // 2)
    discard(rows, strengths)
    median = middle[0] if total % 2 else sum(middle) / 2
    return Ranking(model.mean, model.std, model.weights, threshold, max(median / 3, 1e-6))


def in_fold(doc_id, folds: int = 5):
    """Whether a row is held out: crc32 of doc_id as text is divisible by `folds`. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_classifier(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, score, predicted. Held-out rows' labels are never read by the fit."""
    feats = materialize(featurize(documents.select("doc_id", "text")), "quality")
    model = train(feats, labels.where(~in_fold(F.col("doc_id"))))
    scored = feats.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), model.score(F.col("x"), cut).alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def kept_documents(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents predicted good, with all their columns. Texts are read twice and never shuffled."""
    feats = materialize(featurize(documents.select("doc_id", "text")), "quality")
    model = train(feats, labels.where(~in_fold(F.col("doc_id"))))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    seen = documents.select(row, feature_column(F.col("text")).alias("x"))
    return seen.where(model.score(F.col("x"), cut) >= cut).select("row.*")
