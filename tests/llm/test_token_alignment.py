import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quillon.llm import token_alignment as A  # noqa: E402

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PIECES = list("abcXYZ'sstreveldm019 .,!?-_|<>\n\t\r\x0b\x0c\x1c\x85\xa0 　▁") + [" "] * 8 + [
    "  ", "   ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "é", "ß", "œ", "́", " ́", "中", "한", "٣", "½", "😀", "‍", "﻿", "\x00", "\x7f", "ﬁ",
]


def texts(n):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["a▁▁b", "a ▁b", "a ", " ", " a", "  a  b", "x" * 3000, "den der die das und " * 900]


def plain(text, a, b):
    """(A ids, B ids, groups, links) by sets of byte offsets, from the whole text."""
    if not text:
        return [], [], [], []
    letters = {c: i for i, c in enumerate(A.byte_letters())}
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(t for _, t in x) != (" " + text).encode() or b"".join(t for _, t in y) != (" " + text).encode():
        return [], [], [], []
    ends = []
    for side in (x, y):
        at, here = 0, {}
        for k, (_, t) in enumerate(side):
            at += len(t)
            here[at] = k
        ends.append(here)
    groups, links, s, t = [], [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        u, v = ends[0][e] + 1, ends[1][e] + 1
        groups.append(",".join(str(i) for i, _ in x[s:u]) + "|" + ",".join(str(i) for i, _ in y[t:v]))
        links.append((x[u - 1][0], y[v - 1][0]))
        s, t = u, v
    return x, y, groups, links


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def test_runs_give_what_whole_texts_give(libraries, monkeypatch):
    aligner = A.Aligner(*PATHS)
    assert aligner.by_runs
    monkeypatch.setattr(A, "CACHE", 500)
    for text, row in zip(texts(2000), aligner.texts(texts(2000), False), strict=True):
        x, y, groups, links = plain(text, *libraries)
        assert row[:5] == (len(x), len(y), len(groups), len(links), ";".join(groups)), text
        assert list(zip(np.frombuffer(row[5], "<u4").tolist(), np.frombuffer(row[6], "<u4").tolist(), strict=True)) == links


def test_whole_texts_too(libraries):
    aligner = A.Aligner(*PATHS)
    aligner.by_runs = False
    for text, row in zip(texts(200), aligner.texts(texts(200), False), strict=True):
        assert row[4] == ";".join(plain(text, *libraries)[2])


def test_a_worker_remembers_compactly_and_what_comes_again(monkeypatch):
    aligner = A.Aligner(*PATHS)
    rows = [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(50)]
    tracemalloc.start()
    aligner.texts(rows, True)
    runs = [r for t in rows for r in t.split(" ")]
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(aligner.known) == len(set(runs)) and kept / len(aligner.known) < 300
    monkeypatch.setattr(A, "CACHE", 400)
    monkeypatch.setattr(A, "CHUNK", 1)
    learnt, learn = Counter(), aligner._learn
    monkeypatch.setattr(aligner, "_learn", lambda runs: (learnt.update(runs), learn(runs))[1])
    aligner.known.clear()
    got = aligner.texts([f"the {t} end" for t in rows], False)
    assert [r[4] for r in got] == [";".join(r[4] for r in aligner.texts(["the", t, "end"], False)) for t in rows]
    assert learnt["the"] == 1 and len(aligner.known) + len(aligner.elder) <= 400


def test_overlaps_are_those_of_a_plain_scan():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(np.append(rnd.integers(1, 40, 9), 40)) for _ in range(2))
        first, last = A.overlaps(a, b)
        begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        for i in range(len(a)):
            shared = [j for j in range(len(b)) if begin_b[j] < a[i] and b[j] > begin_a[i]]
            assert (first[i], last[i]) == (shared[0], shared[-1])


def test_counts_over_the_corpus(spark, libraries):
    rows = [(k, t) for k, t in enumerate(texts(300))] + [(900, None), (901, ""), (7, "again and again"), (7, "again and again"), (None, "the end")]
    found = [(k, *plain(t, *libraries)) for k, t in rows]
    count = Counter(p for *_, links in found for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    want = [
        (k, len(x), len(y), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for k, x, y, g, links in found
    ]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, groups string, n_a int").repartition(3)
    got = A.alignment_digests(df, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment_digests(df, *PATHS).collect() == []
    assert A.aligned(df, *PATHS).collect() == []
