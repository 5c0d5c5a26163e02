"""Mixing and URL filters: against small plain versions; both run without Python on the executors."""

import re

import numpy as np

from quillon.llm import mixing, url_filter

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def rule(url):
    host, path = split(url)
    fits = []
    for verdict, text in RULES:
        at, _, tail = text.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme/com/en/", "http://A.Example.COM/en/7?x=1", "https://x.com/en/", "http://com/en/1", "http://xcom/en/1", "http://com", "ftp://b.example.net/de/81#f", "http://b.example.net/de/7/8",
    "http://q.org/es/", "http://q.org/ES/", "http://É.org/es/1", "a://b://c.com/en/", "http://h.net?u=/de/", "http://h.net#/de/", "http://line\nbreak.net/de/\n8", "x://", "x:///p",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.url_filter(df, RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        said, verdict = rule(u)
        assert (got[i].host, got[i].path) == split(u), u
        assert got[i].rule == said
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://bad.test/buy/{i}") for i in range(40)] + [(100 + i, f"http://good.test/news/{i}") for i in range(40)] + [(200 + i, f"http://both.test/{'ok' if i % 2 else 'junk'}/{i}") for i in range(80)] + [(300, "http://new.test/z")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(u, ("bad.test" in u or "junk" in u)) for i, u in rows[:160:2] + rows[81:160:2] if "new" not in u], "url string, bad boolean")
    got = {r.page_id: r for r in url_filter.url_filter(pages, [], labels).collect()}
    assert all(got[i].verdict == "block" for i in range(40)) and all(got[100 + i].verdict == "allow" for i in range(40))
    assert all(got[200 + i].verdict == ("allow" if i % 2 else "block") for i in range(80))
    assert got[300].verdict == "allow" and got[0].template == "bad.test/buy/*"


def branches(host, *shares):
    """URLs of branches a, b, ... of a host with (bad, all) labels each, and pages without a label."""
    rows = [(f"http://{host}/{'abcdef'[k]}/{i}", i < bad if i < n else None) for k, (bad, n) in enumerate(shares) for i in range(max(n, 50) + 2)]
    return rows


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, [], spark.createDataFrame([x for x in rows if x[1] is not None], "url string, bad boolean")).collect()}
    return {u: got[i] for i, (u, _) in enumerate(rows)}


def test_url_branches_merge_with_those_alike_only(spark):
    got = judged(spark, branches("h.test", (0, 50), (60, 60), (0, 2)))
    assert {u.split("/")[3]: r.template for u, r in got.items()} == {"a": "h.test/{a|c}/*", "b": "h.test/b/*", "c": "h.test/{a|c}/*"}
    assert {u.split("/")[3]: r.verdict for u, r in got.items()} == {"a": "allow", "b": "block", "c": "allow"}
    # the closest go first: 0 of 3 is alike to 20 of 40, but not to 26 of 40
    got = judged(spark, branches("i.test", (26, 40), (20, 40), (0, 3), (0, 0)))
    assert {u.split("/")[3]: r.template for u, r in got.items()} == {"a": "i.test/{a|b}/*", "b": "i.test/{a|b}/*", "c": "i.test/c/*", "d": "i.test/d/*"}


def test_url_templates_reach_the_deepest_segment(spark):
    rows = [(f"http://d.test/2024/05/12/news/{x}/{i}", x == "casino") for x in ("casino", "sport") for i in range(20)] + [("http://d.test/2024/05/12/*/x/y/z", None)]
    got = judged(spark, rows)
    assert all(got[u].verdict == ("block" if bad else "allow") for u, bad in rows if bad is not None)
    assert got[rows[0][0]].template == "d.test/2024/05/12/news/casino/*" and got[rows[-1][0]].template == "d.test/2024/05/12/*/*/*/*"


def test_url_filter_empty_and_repeated(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
    twice = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_filter.url_filter(twice, RULES).collect()) == [(0, "allow"), (1, "block"), (1, "block")]


def fitted(tokens, p, want, steps=200):
    """Projected gradient in NumPy, the plain way."""
    A = p * tokens[:, None]
    r = np.ones(len(tokens))
    G = np.linalg.inv(A.T @ A + np.eye(p.shape[1]) * 1e-9 * np.trace(A.T @ A))
    for _ in range(steps):
        r = np.maximum(0, r - A @ (G @ (A.T @ r - want)))
    return r


def test_rates_meet_targets_and_equal_plain_fit(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 400, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    df = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    for weights in ({"a": 0.34, "b": 0.33, "c": 0.33}, {"a": 0.9, "b": 0.05, "c": 0.05}):
        history, unit, _, want = mixing.fit_rates(df, weights)
        got = {r.doc_id: r.rate for r in df.withColumn("rate", mixing.rate(history, 3, unit)).collect()}
        r = np.array([got[i] for i in range(300)])
        assert (r >= 0).all()
        assert np.abs((p * tokens[:, None]).T @ r - want).max() < 1e-3 * want.sum()
        if weights["a"] < 0.5:  # with rates at zero the fit is not unique
            assert np.abs(r - fitted(tokens.astype(float), p, want)).max() < 0.05


def documents(spark):
    rows = [(i, ("the and of house " if i % 3 else "der und das haus ") * (1 + i % 7), "en" if i % 3 else "de", 1) for i in range(120)]
    rows += [(500, None, "en", 1), (501, "", None, 1), (3, rows[3][1], "de", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, tokens int")


def test_mix_of_documents(spark):
    docs = documents(spark)
    labelled = docs.selectExpr("text", "lang as domain")
    got = mixing.mix(docs.select("doc_id", "text"), labelled, {"en": 0.5, "de": 0.5}).collect()
    assert len(got) == 123
    total = sum(r.tokens for r in got)
    for k in range(2):
        assert abs(sum(r.tokens * r.rate * r.p[k] for r in got) / total - 0.5) < 1e-3
    for r in got:
        if r.doc_id in (500, 501):
            assert r.tokens == 0 and r.rate == 1.0
        elif r.tokens:
            assert (r.p[1] > 0.5) == (r.doc_id % 3 == 0)


def test_mixed_rows_keep_every_document(spark):
    docs = documents(spark)
    out = mixing.mix_rows(docs, docs.selectExpr("text", "lang as domain"), {"en": 0.5, "de": 0.5})
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and len(rows) > 123
    assert mixing.mix_rows(docs.limit(0), docs.selectExpr("text", "lang as domain"), {"en": 0.5, "de": 0.5}).collect() == []


def test_no_python_on_the_executors(spark):
    docs = documents(spark)
    out = mixing.mix_rows(docs, docs.selectExpr("text", "lang as domain"), {"en": 0.5, "de": 0.5})
    pages = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    for df in (out, url_filter.url_filter(pages, RULES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def plain_templates(urls):
    """The whole template method over [(host, path, n, labelled, bad)], one row per host and path: {(host, path): (template, rejected)}."""

    def alike(a, b):
        pooled = (a[1] + b[1]) / (a[0] + b[0])
        spread = (pooled * (1 - pooled) * (1 / a[0] + 1 / b[0])) ** 0.5
        return spread == 0 or abs(a[1] / a[0] - b[1] / b[0]) < url_filter.Z * spread

    def names(branches):
        """branches {name: (labels, bad)} -> {name: name of its group}"""
        groups = [[k] for k in sorted((k for k in branches if branches[k][0]), key=lambda k: (branches[k][1] / branches[k][0], k))]
        share = lambda g: sum(branches[k][1] for k in g) / sum(branches[k][0] for k in g)
        while True:
            near = [(share(groups[i + 1]) - share(groups[i]), i) for i in range(len(groups) - 1) if all(alike(branches[a], branches[b]) for a in groups[i] for b in groups[i + 1])]
            if not near:
                break
            i = min(near)[1]
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
        return {k: "{" + "|".join(sorted(g)) + "}" for g in groups if len(g) > 1 for k in g}

    done, live = {}, [(host, re.sub(r"\A/", "", path).split("/"), host, 0, row) for row in urls for host, path in [row[:2]]]
    while live:
        at = {}
        for x in live:
            at.setdefault(x[2], []).append(x)
        live = []
        for node, rows in at.items():
            total = {}
            for _, segments, _, depth, row in rows:
                t = total.setdefault(segments[depth], [0, 0, 0])
                for k in range(3):
                    t[k] += row[2 + k]
            whole = sum(t[0] for t in total.values())
            literal = {s for s, t in total.items() if t[0] >= url_filter.SUPPORT and t[0] >= url_filter.SHARE * whole}
            escaped = {s: re.sub(r"([\\*|{}])", r"\\\1", s) for s in literal}
            branches = {escaped[s]: tuple(total[s][1:]) for s in literal}
            branches["*"] = tuple(sum(t[k] for s, t in total.items() if s not in literal) for k in (1, 2))
            group = names(branches)
            for host, segments, _, depth, row in rows:
                if whole < url_filter.SUPPORT:
                    done[row[:2]] = node + "/*" * (len(segments) - depth)
                    continue
                name = escaped.get(segments[depth], "*")
                now = f"{node}/{group.get(name, name)}"
                if depth + 1 == len(segments):
                    done[row[:2]] = now
                else:
                    live.append((host, segments, now, depth + 1, row))
    count = {}
    for row in urls:
        c = count.setdefault(done[row[:2]], [0, 0])
        c[0] += row[3]
        c[1] += row[4]
    return {k: (t, (count[t][1] + 2) / (count[t][0] + 4) >= url_filter.PURITY) for k, t in done.items()}


def test_templates_equal_a_plain_version(spark):
    r = np.random.default_rng(8)
    urls = {}
    for _ in range(1500):
        host = r.choice(["a.test", "b.test", "c.test"], p=[0.6, 0.3, 0.1])
        path = "/" + "/".join(str(r.choice(["x", "y", "*", "a|b", "z", str(r.integers(1000))], p=[0.3, 0.2, 0.05, 0.05, 0.1, 0.3])) for _ in range(int(r.integers(1, 5))))
        n, labelled = int(r.integers(1, 4)), int(r.integers(0, 3))
        bad = labelled if "/y" in path or r.random() < 0.1 else 0
        urls[host, path] = (n, labelled, bad)
    urls = [(*k, *v) for k, v in urls.items()]
    df = spark.createDataFrame(urls, "host string, path string, n long, labelled long, bad long")
    got = {(x.host, x.path): (x.template, x.rejected) for x in url_filter.template_verdicts(df).collect()}
    want = plain_templates(urls)
    assert got == want and 0 < sum(v for _, v in want.values()) < len(want)


def test_template_with_only_good_labels_or_none_is_allowed(spark):
    rows = [(f"http://good.test/{i}", False if i < 1 else None) for i in range(30)] + [(f"http://bad.test/a/{i}", True) for i in range(40)] + [(f"http://bad.test/b/{i}", None) for i in range(10)]
    got = judged(spark, rows + [("http://none.test/" + "x" * 100_000, None)])
    assert {u.split("/")[2] + u.split("/")[3][:1]: r.verdict for u, r in got.items() if "bad" in u} == {"bad.testa": "block", "bad.testb": "allow"}
    assert all(r.verdict == "allow" for u, r in got.items() if "bad" not in u)


def test_posteriors_equal_a_plain_naive_bayes(spark):
    from pyspark.sql import functions as F

    labelled = [("a b c a", "x"), ("b b d", "y"), ("e", "y"), (None, "x"), ("zz", "other"), ("q", None)]
    docs = [(1, "a a b"), (2, "d  e\tf"), (3, ""), (4, None), (5, "a " * 5000)]
    domains = ["x", "y", "z"]
    prior, likelihood = mixing.fit_domains(spark.createDataFrame(labelled, "text string, domain string"), domains)
    seen = {r.doc_id: r for r in mixing.posteriors(spark.createDataFrame(docs, "doc_id long, text string"), prior, likelihood).collect()}
    words = sorted({w for t, _ in labelled + [(t, 0) for _, t in docs] for w in (t or "").split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.hash("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    counts = {d: [1.0] * mixing.BUCKETS for d in domains}
    for t, d in labelled:
        for w in (t or "").split() if d in counts else ():
            counts[d][bucket[w]] += 1
    n = {d: 1 + sum(x == d for _, x in labelled) for d in domains}
    for doc, t in docs:
        ws = (t or "").split()
        logs = [sum(np.log(counts[d][bucket[w]] / sum(counts[d])) for w in ws) * (len(ws) ** -0.5 if ws else 0) + np.log(n[d] / sum(n.values())) for d in domains]
        p = np.exp(np.array(logs) - max(logs))
        assert seen[doc].tokens == len(ws) and np.allclose(seen[doc].p, p / p.sum(), atol=1e-9)


def test_unreachable_targets_warn(spark):
    import pytest

    df = spark.createDataFrame([(i, 10, [1.0, 0.0]) for i in range(5)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss a target"):
        mixing.fit_rates(df, {"a": 0.5, "b": 0.5})
