import random
import time
from fractions import Fraction
from pathlib import Path

import pytest

from quillon.llm import ngram_join as N
from quillon.llm.common import CLEANUP

SPACE = " \t\n\r\x0b\x0c"


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in SPACE:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, size, t):
    sets = [shingles(x, size) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and t.denominator * len(a & b) >= t.numerator * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(n):
        base = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.choice([1, 2, 3, 4, 9, 10, 11, 12, 20, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                i = r.randrange(max(len(w), 1))
                w[i : i + 1] = r.choice([[], ["x%d" % r.randrange(9)], w[i : i + 1] * 2])
            rows.append((k, r.choice([" ", "\n", "\t "]).join(w).title() if r.random() < 0.2 else " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize(("size", "t", "seed"), [(3, Fraction(9, 10), 1), (5, Fraction(4, 5), 2), (2, Fraction(1, 2), 3)])
def test_components_equal_brute_force(spark, size, t, seed):
    rows = corpus(seed) + [(9001, None), (9002, ""), (9003, " \n"), (None, "q w e r t y u i o p"), (9004, "q w e r t y u i o p")]
    rows += [rows[5], rows[5], (9005, "word " * 3000), (9006, "word " * 2900), (9007, "é à b c")]
    df = spark.createDataFrame([(d, x, "n", 1) for d, x in rows], "doc_id long, text string, node string, tile int")
    got = sorted((tuple(r) for r in N.ngram_components(df, size, t).collect()), key=str)
    assert got == brute(rows, size, t)


def test_large_group_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "SMALL_TILE", 0)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(60)] = f"z{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in N.ngram_components(df, 3, Fraction(9, 10)).collect())
    assert got == sorted(brute(rows, 3, Fraction(9, 10)))


def test_empty_table(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffle_files_go_with_each_table(spark, monkeypatch):
    """Those of one step must not lie beside those of the next, whenever the driver collects its garbage."""
    folders = [Path(str(x)) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    before, kept, left, plain = files(), spark.conf.get(CLEANUP), {}, N.materialize

    def watched(df, name):
        out = plain(df, name)
        until = time.time() + 5  # Spark removes them in the background
        while (now := files() - before) and time.time() < until:
            time.sleep(0.05)
        left[name] = len(now)
        return out

    monkeypatch.setattr(N, "materialize", watched)
    rows = corpus(4)
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5))
    assert {"met", "shared", "left"} <= set(left)
    assert {k: left[k] for k in ("met", "shared", "left")} == {"met": 0, "shared": 0, "left": 0}
    assert spark.conf.get(CLEANUP) == kept
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, 5, Fraction(4, 5)))
