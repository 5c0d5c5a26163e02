"""Operators that work text by text: against the libraries' own tokenizers, and against plain definitions."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import bpe, html_extract, quality_classifier, quality_rules, text_scan, token_counts  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(4)
    out = ["", " ", "\n\n", "a", "Hello  world's  end.\n\n ", "ab" * 3000, "é" * 200, "x" * 64, "x" * 65, "日本語テキスト 123 ½", "​﻿\x00\x1c\x85 \x1f", "'s 're", "🙂🙂 á"]
    for _ in range(300):
        pick = r.choice([(32, 127), (0, 0x250), (0x300, 0x3000), (0x10000, 0x10FFFF)])
        out.append("".join(r.choice([chr(r.randrange(*pick)), " ", "e"]) for _ in range(r.randrange(60))))
    return out


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "no id", 7), (1000, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.bpe_digests(df, RANKS, P.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = df.select("doc_id", "text", bpe.bpe_decode(bpe.bpe_encode("text", RANKS, P.PATTERN), RANKS, P.PATTERN).cast("string").alias("b"))
    assert all(r.b == (r.text or "") for r in back.collect())


def test_bpe_cache_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    small, large = bpe.Codec(RANKS, P.PATTERN), bpe.Codec(RANKS, P.PATTERN)
    a = small.encode(texts())
    monkeypatch.undo()
    assert a == large.encode(texts())
    assert [small.decode(x).decode() for x in a] == texts()


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_the_library(fallback):
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, byte_fallback=fallback))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    text = [x for i, x in enumerate(pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    c = token_counts.Counter(text, fallback)
    some = [x for x in texts() if "\x00" not in x]
    assert [c.text(x) for x in some] == [len(t.encode(x, add_special_tokens=False).ids) for x in some]


def test_control_and_byte_pieces_do_not_match_text():
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    assert c.bytes and not {"<s>", "</s>", "<unk>", "<0x0A>"} & set(c.scores)
    # a best path over the text's own pieces, by trying all of them
    for x in ("▁a</s>b", "▁end<0x0A>z", "▁<s><unk>"):
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(x)
        for e in range(1, len(x) + 1):
            for b in range(e):
                if (s := c.scores.get(x[b:e])) is not None and best[b][0] + s > best[e][0]:
                    best[e] = best[b][0] + s, best[b][1] + 1
        assert c.word(x) == c.words_together([x])[0] == best[-1][1]


def test_token_count_ties_take_the_earlier_start():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0)]
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.Counter(pieces[1:])
    r = random.Random(1)
    for _ in range(300):
        x = "".join(r.choice("ab c") for _ in range(r.randrange(1, 12)))
        assert c.text(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).collect() == [] and bpe.bpe_digests(empty, RANKS, P.PATTERN).collect() == []


def test_token_counts_of_a_table(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in token_counts.token_counts(df, P.path("piece_bpe_32k.model")).collect())
    assert got[0] == (1, 0) and got[1] == (2, 0) and got[2] == got[3] and got[2][1] > 0


def plain_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit))


def samples():
    r = random.Random(8)
    out = [None, "", " \n", "one", "a b c d e a b c d e", "x " * 40, "a\na\n \n \na", "  \x1c\x85 é#*", "l1\r\nl1\r\n"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "b", "cé", "#", "\n", " ", " ", "\t"]) for _ in range(r.randrange(120))))
    return out


def test_measures_equal_plain_definitions():
    for x in samples():
        assert quality_rules.measure(x)[:5] == plain_measures(x)


def test_repeat_words_with_many_distinct_words():
    r = random.Random(2)
    words = [f"w{r.randrange(9000)}" for _ in range(12000)]
    words[6000:6010] = words[100:110]
    assert text_scan.Scan(" ".join(words)).repeat_words() >= 20


def test_binomial_bound_is_exact():
    from math import comb

    for bad, n, level in ((0, 50, 0.05), (3, 80, 0.01), (10, 200, 1e-4)):
        p = quality_rules.binomial_upper(bad, n, level)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1))
        assert abs(tail - level) < 1e-6 * max(1, level / 1e-6)
    assert quality_rules.binomial_upper(0, 0, 0.05) == 1.0 and quality_rules.binomial_upper(5, 5, 0.05) == 1.0


def corpus(spark, n=600):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(60)]
        docs.append((i, " ".join(w + "###" if bad else w for w in words), ["en", "fr", None][i % 3], 1))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_reject_junk_and_keep_good(spark):
    docs, labels = corpus(spark, 6000)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    good = [d for d in got if d % 6]
    assert sum(got[d].kept for d in good) >= 0.95 * len(good)
    assert sum(got[d].kept for d in got if d % 6 == 0) == 0
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in got if got[d].kept}


def test_each_language_is_a_stratum(spark):
    """Good ja texts are all over a cutoff that the many zh labels admit; null, zh and ja have cutoffs apart."""
    fields = {m: 0.0 for m in quality_rules.MEASURES} | {"n_words": 50, "n_repeat_words": 0}
    rows = [("zh", 1, 0.0)] * 2000 + [("zh", 0, 0.5)] * 200 + [("ja", 1, 0.5)] * 8 + [(None, 1, 0.0)] * 2000 + [(None, 0, 0.5)] * 200
    held = spark.createDataFrame([(i, lang, *(fields | {"symbol_rate": x}).values()) for i, (lang, _, x) in enumerate(rows)], "doc_id long, lang string, " + ", ".join(f"{m} double" for m in quality_rules.MEASURES) + ", n_words long, n_repeat_words long")
    labels = spark.createDataFrame([(i, q) for i, (_, q, _) in enumerate(rows)], "doc_id long, quality int")
    cuts = quality_rules.select_cutoffs(held, labels)
    assert set(cuts.cuts) == {"zh", None}
    lost = held.join(labels, "doc_id").where(cuts.rejects()).groupBy("lang", "quality").count().collect()
    assert sorted((r["lang"] or "", r["quality"], r["count"]) for r in lost) == [("", 0, 200), ("zh", 0, 200)]
    new = spark.createDataFrame([("ko", 0.5)], "lang string, symbol_rate double").select("lang", *(F.col("symbol_rate").alias(m) for m in quality_rules.MEASURES))
    assert new.where(cuts.rejects()).count() == 0


def plain_upper(bad, n, level):
    """Largest p with P(Bin(n, p) <= bad) >= level, by exact sums."""
    if bad >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1))
        lo, hi = (lo, p) if tail < level else (p, hi)
    return hi


def plain_cutoffs(rows, risk, level):
    """rows: (stratum, quality, in the design part, {measure: value})."""
    names, grid = quality_rules.MEASURES, quality_rules.GRID
    left, steps = [(q, v) for _, q, d, v in rows if d], []
    least = sum(q == 0 for q, _ in left) * quality_rules.LEAST_GAIN
    while True:
        gains = {(i, -k): sum((-quality_rules.WORTH if q else 1) for q, v in left if v[m] > cut) for k, m in enumerate(names) for i, cut in enumerate(grid)}
        (i, k), best = max(gains.items(), key=lambda x: (x[1], x[0]))
        if best <= 0 or best < least:
            break
        steps.append((names[-k], grid[i]))
        left = [(q, v) for q, v in left if not v[names[-k]] > grid[i]]
    good = {}
    for s, q, d, v in rows:
        if q and not d:
            good.setdefault(s, []).append(v)
    sizes = sorted((len(v) for v in good.values()), reverse=True)
    k = max((k for k in range(1, len(sizes) + 1) if plain_upper(0, sizes[k - 1], level / k) <= risk), default=0)
    cuts = {}
    for s, values in sorted(good.items(), key=lambda x: (-len(x[1]), x[0] is None, x[0] or ""))[:k]:
        for n in range(1, len(steps) + 1):
            lost = sum(any(v[m] > c for m, c in steps[:n]) for v in values)
            if plain_upper(lost, len(values), level / k) > risk:
                break
            cuts.setdefault(s, {})[steps[n - 1][0]] = steps[n - 1][1]
    return cuts


def test_cutoffs_equal_a_plain_version(spark):
    r = random.Random(12)
    names, rows = quality_rules.MEASURES, []
    for i in range(1800):
        lang, bad = r.choice(["en"] * 10 + ["fr"] * 6 + [None] * 2 + ["xx"] * 6 + ["yy"]), r.random() < 0.3
        v = {m: r.choice([0.0, 0.003, 0.04]) for m in names}
        if bad:
            v[r.choice(names[:3])] = r.random()
        elif r.random() < (0.2 if lang == "xx" else 0.01):
            v[r.choice(names)] = r.random()
        rows.append((i, lang, 0 if bad else 1, v))
    held = spark.createDataFrame([(i, s, 50, 0, *v.values()) for i, s, _, v in rows], "doc_id long, lang string, n_words long, n_repeat_words long, " + ", ".join(f"{m} double" for m in names))
    design = {x.doc_id for x in held.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()}
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, quality int")
    for risk, level in ((0.05, 0.05), (0.1, 0.01)):
        want = plain_cutoffs([(s, q, i in design, v) for i, s, q, v in rows], risk, level)
        assert want and quality_rules.select_cutoffs(held, labels, risk, level).cuts == want


def test_rules_without_labels_and_empty(spark):
    docs, labels = corpus(spark, 12)
    got = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert len(got) == 12 and all(r.kept for r in got)
    assert quality_rules.quality_rules(docs.limit(0), labels).collect() == []
    null = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert [(r.n_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(null, labels).collect()] == [(0, True, False)]


def test_classifier_on_held_out(spark):
    docs, labels = corpus(spark)
    got = quality_classifier.quality_classifier(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 60 < len(held) < 180
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == (1 if r.doc_id % 6 else 0) for r in held) >= 0.98 * len(held)
    kept = quality_classifier.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_ranking_equals_a_plain_fit_and_score(spark):
    r = np.random.default_rng(2)
    width = len(quality_classifier.FEATURES)
    good, bad = r.random((300, width)), r.random((200, width)) + np.eye(width)[3] * 0.4
    model = quality_classifier.fit(good, bad, 0.4, pairs=4000, ridge=0.05, steps=3000)
    # the plain way: the same pairs, Newton's steps on the whole loss
    both = np.hstack([np.vstack([good, bad]), np.sqrt(np.vstack([good, bad]))])
    z = (both - both.mean(0)) / both.std(0)
    draw = np.random.default_rng(7)
    d = z[:300][draw.integers(0, 300, 4000)] - z[300:][draw.integers(0, 200, 4000)]
    w = np.zeros(2 * width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / len(d) + 0.05 * np.eye(len(w)), d.T @ (p - 1) / len(d) + 0.05 * w)
    assert np.allclose(model.weights, w, atol=1e-4)
    s = z @ w
    assert abs(np.sum(s[:300] < model.threshold) / 300 * 0.6 + np.sum(s[300:] < model.threshold) / 200 * 0.4 - 0.4) < 0.01  # the quantile of the bad share
    df = spark.createDataFrame([(i, x) for i, x in enumerate(np.vstack([good, bad])[::50].tolist())], "i int, x array<double>").orderBy("i")
    got = [x[0] for x in df.select(model.score(F.col("x"))).collect()]
    want = 1 / (1 + np.exp(-((s[::50] - model.threshold) / model.scale + np.log(0.3 / 0.7))))
    assert np.allclose(got, want, atol=1e-3)


def test_ranking_is_fitted_on_all_rows_and_all_pairs(spark):
    r = np.random.default_rng(4)
    width, n, m = len(quality_classifier.FEATURES), 150, 111
    x = np.round(np.vstack([r.random((n, width)), r.random((m, width)) + np.eye(width)[3] * 0.7]), 2)
    x[-1, 5] = 400.0  # one far out
    df = spark.createDataFrame([(i, v, int(i < n)) for i, v in enumerate(x.tolist())], "doc_id long, x array<double>, quality int").repartition(3)
    model = quality_classifier.train(df.select("doc_id", "x"), df.select("doc_id", "quality"), ridge=1e-3)
    # the plain way: every pair spelt out, Newton's steps
    both = np.hstack([x, np.sqrt(x)])
    z = (both - both.mean(0)) / both.std(0)
    d = (z[:n, None] - z[None, n:]).reshape(-1, 2 * width)
    w = np.zeros(2 * width)
    for _ in range(40):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / len(d) + 1e-3 * np.eye(len(w)), d.T @ p / len(d) - 1e-3 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    s = np.sort(z @ w)
    assert np.isclose(model.threshold, (s[m - 1] + s[m]) / 2, atol=1e-5) and np.isclose(model.scale, np.median(np.abs(s - model.threshold)) / 3, atol=1e-5)


def test_rows_beyond_ten_thousand_of_a_label_count(spark):
    # two kinds of bad rows; of 21,000 each, none may be left out: mean, spread and threshold are those of all rows
    x = F.array(*[((F.col("id") * (k + 3)) % 101 / 101.0) + F.when((F.col("id") % 3 == 0) & (k == F.col("id") % 2), 1.0).otherwise(0.0) for k in range(len(quality_classifier.FEATURES))])
    df = spark.range(63_000).select(F.col("id").alias("doc_id"), x.alias("x"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    model = quality_classifier.train(df.select("doc_id", "x"), df.select("doc_id", "quality"))
    values = np.array([r.x for r in df.select("x").collect()])
    assert np.allclose(model.mean[: values.shape[1]], values.mean(0), atol=1e-9) and np.allclose(model.std[: values.shape[1]], values.std(0), atol=1e-9)
    s = np.sort((np.hstack([values, np.sqrt(values)]) - model.mean) / model.std @ np.array(model.weights))
    assert np.isclose(model.threshold, (s[20_999] + s[21_000]) / 2, atol=1e-9)


def test_values_at_ranks(spark):
    r = np.random.default_rng(3)
    for values in ([1.0], [2.0] * 5, [0.0, 1e-300, 1e300], np.round(r.normal(size=400), 1).tolist(), (r.normal(size=300) ** 9).tolist()):
        df, s = spark.createDataFrame([(v,) for v in values], "v double"), sorted(values)
        for rank in {0, len(s) // 2, max(len(s) - 2, 0)}:
            assert quality_classifier.at_rank(df, rank) == [s[rank], s[min(rank + 1, len(s) - 1)]]


def test_repeated_rows_labels_and_long_texts(spark):
    docs, labels = corpus(spark, 60)
    long = spark.createDataFrame([(7, "word " * 200_000, "en", 1), (7, "word " * 200_000, "en", 1)], docs.schema)
    more = labels.union(labels.where("doc_id < 30"))
    got = quality_rules.quality_rules(docs.union(long), more).collect()
    assert len(got) == 62 and sorted(r.n_words for r in got)[-2:] == [200_000] * 2 and not any(r.kept for r in got if r.n_words == 200_000)
    scored = quality_classifier.quality_classifier(docs.union(long), more).collect()
    assert len(scored) == 62 and len({r.score for r in scored if r.doc_id == 7}) == 2


def test_classifier_edge_cases(spark):
    docs, labels = corpus(spark, 12)
    odd = docs.union(spark.createDataFrame([(None, None, None, 1), (99, "", "en", 1)], docs.schema))
    got = quality_classifier.quality_classifier(odd, labels.limit(0)).collect()
    assert len(got) == 14 and all(r.predicted == 1 and abs(r.score - 0.3) < 1e-9 for r in got)
    assert quality_classifier.quality_classifier(docs.limit(0), labels).collect() == []


PAGES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    ("plain &amp; text", "plain & text"),
    ("<article><h1> T\n\n t </h1><p>a<b>b</b>c &lt;x&gt;<p>d</article>", "T t\nabc <x>\nd"),
    ("<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>Words here.</p><div class=\"ad\">Buy</div><p>More.</p></article><div id='comments'><p>me too</p></div><footer>f</footer>", "Head\nWords here.\nMore."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><main><p>yes</p></main>", "yes"),
    ("<article><p>one<!-- no --> two</p><form><p>mail</p></form></article>", "one two"),
]


def test_html_cases(spark):
    df = spark.createDataFrame([(i, "u", p, 3) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.html_extract(df).collect())
    assert got == [(i, t, len(t)) for i, (_, t) in enumerate(PAGES)]


WRAPPED = [
    *((f"<div class='{c}'><article><h1>T</h1><p>one two</p></article></div>", "T\none two") for c in ("content has-sidebar", "with-comments", "widget-area-wrapper", "page-with-menu", "no-share", "content sidebar")),
    ("<div id=sidebar><div><main><p>one two</p></main></div><p>side</p></div>", "one two"),
    ("<main><div class=sidebar><article><p>one two</p></article></div></main>", "one two"),
    ("<article><p>one two</p><p title='the hidden valley'>three four</p><p hidden>no</p><p class='x' HIDDEN=''>no</p><p style='color:red;display : none'>no</p><p data-x='display:none' data-id='menu'>five</p></article>", "one two\nthree four\nfive"),
    ("<article><p>one two</p><div class='post sidebar'>no</div><div id=comment-12>no</div><div class=related><article>no</article></div><p>three</p></article>", "one two\nthree"),
    ("<article><p>one two</p></article><ol class=comments><li><article class=comment><p>no no no no no no</p></article></li></ol>", "one two"),
    ("<nav><article><p>no</p></article></nav><article><p>one</p></article>", "one"),
    ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><object data=x><p>in words</p></object><p>end</p></article>", "If x=1 holds\nin words\nend"),
]


UNCLOSED = [
    ("<nav><a href=x>Home</a><article><h1>T</h1><p>one two</p></article>", "T\none two"),
    ("<body><aside class=x>see <ul><li>that</li></ul><main><p>one</p><p>two</p></main></body>", "one\ntwo"),
    ("<head><title>t</title><body><article><p>one</p></article></body>", "one"),
    ("<article><p>one</p><div class=ad>buy<p>two</p><p>three</p></article>", "one\ntwo\nthree"),
    ("<nav>a</nav><nav>b<p>one two three</p>", "one two three"),
    ("<div>" * 3000 + "<p>deep words here</p>" + "</div>" * 3000, "deep words here"),
    ("<article>" + "<p>word</p>" * 30_000 + "</article>", "\n".join(["word"] * 30_000)),
]


def test_html_elements_without_end_do_not_swallow_the_page():
    weights = html_extract.default_weights()
    for page, text in UNCLOSED:
        assert html_extract.extract(page, weights) == text, page[:200]


def test_html_weights_are_learnt_from_pages(spark):
    page = "<body><div>Menu of words</div><article><h1>T</h1><p>one two three</p></article><div>foot</div></body>"
    df = spark.createDataFrame([(1, page, "u"), (1, page, "u"), (2, "<article></article><article>two</article>", "u"), (3, None, None)], "page_id long, html string, url string")
    own = html_extract.article_counts(page)
    assert own["word:article"] == [4, 0] and own["word:plain"] == [4, 8] and html_extract.article_counts("<article>a</article><article>b</article>") == {}
    base = html_extract.marked_counts(html_extract.TRAINING)
    want = {k: [base.get(k, [0, 0])[i] + 2 * own.get(k, [0, 0])[i] for i in (0, 1)] for k in base.keys() | own.keys()}
    got = html_extract.learned(df)
    assert got.keys() == html_extract.weigh(want).keys() and all(abs(got[k] - w) < 1e-12 for k, w in html_extract.weigh(want).items())
    assert html_extract.html_extract(df.limit(0)).collect() == []
    assert sorted((r.page_id, r.text) for r in html_extract.html_extract(df).collect()) == [(1, "T\none two three")] * 2 + [(2, "two"), (3, "")]


def test_html_wrappers_attributes_and_formulas():
    weights = html_extract.default_weights()
    for page, text in WRAPPED:
        assert html_extract.extract(page, weights) == text, page


def test_html_of_the_table(spark, sf_dir):
    import html as entities

    for r in html_extract.html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_best_region_is_maximal():
    r = random.Random(6)
    for _ in range(200):
        x = [r.randrange(-5, 5) for _ in range(r.randrange(12))]
        a, b = html_extract.best_region(x)
        assert sum(x[a:b]) == max([0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])
