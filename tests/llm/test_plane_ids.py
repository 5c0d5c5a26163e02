import glob
import json
import os
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard

P = pytest.importorskip("public_tokenizers")

from quillon.llm import plane_ids as I  # noqa: E402

WORDS = P.path("word_bpe_49k.json")
PIECES = list("abcXYZ'sstreveldm019 .,!?-_|<>\n\t\r\x0b\x0c\x1c\x85\xa0 　▁") + [
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "É", "ß", "ẞ", "ÿ", "×", "ª", "µ", "œ", "ΑΣ", "Σ ", "é", "́", " ́", "İ", "中", "ᄒ", "ᅡ", "٣", "½", "😀", "‍", "﻿", "\x00", "\x7f", "\xad",
]


def texts(n=3000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def library(values, end=2):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, end], "<u4") for e in Tokenizer.from_file(WORDS).encode_batch([v or "" for v in values], add_special_tokens=False)]


def test_encoder_equals_the_library(monkeypatch):
    want = [x.astype("<u2").tobytes() for x in library(texts())]
    assert I.Encoder(WORDS, 2).texts(texts()) == want
    monkeypatch.setattr(I, "CHUNK", 50)  # texts cut at spaces
    monkeypatch.setattr(I, "CACHE", 40)  # all forgotten again and again
    assert I.Encoder(WORDS, 2).texts(texts()) == want


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    e = I.Encoder(path, None)
    assert not e.by_words
    assert e.texts(["a  b", None]) == [np.array(Tokenizer.from_file(path).encode("a  b").ids, e.kind).tobytes(), b""]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for kind in ("<u1", "<u2", "<u4", "<i8"):
        for n in (0, 1, 7, 8, 1000):
            v = np.random.default_rng(n).integers(0, 200, n).astype(kind)
            parts = I.planes(v, bits)
            assert len(parts) == v.dtype.itemsize * (8 if bits else 1)
            assert I.joined(parts, n, kind, bits).tolist() == v.tolist()


def documents(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(3)


def want(rows):
    out, at = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (key, _), ids in zip(ordered, library([t for _, t in ordered]), strict=True):
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_equal_the_library(spark, monkeypatch):
    rows = list(zip(random.Random(1).sample(range(-500, 5000), 600), texts(600), strict=True)) + [(9000, None), (9001, ""), (9002, "long word " * 30_000)]
    got = I.token_files(documents(spark, rows), WORDS).collect()
    assert sorted(map(tuple, got)) == want(rows)


def test_repeated_and_null_keys(spark):
    rows = [(None, "same"), (None, "same"), (4, "x y"), (4, "x y"), (1, None)]
    got = sorted(map(tuple, I.token_files(documents(spark, rows), WORDS).collect()), key=str)
    assert got == sorted(want(rows), key=str)


def test_empty_table(spark):
    assert I.token_files(documents(spark, []), WORDS).collect() == []


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_blocks_splits_and_pruning(spark, tmp_path, planes):
    """Documents over many blocks, of no ids, and many in one block; any split gives the same rows."""
    lengths = [0, 5, 70_000, 0, 0, 200_000, 1, 65_536, 65_536, 0, 3] + [2] * 500
    data = [(k, np.random.default_rng(k).integers(0, 49_408, n).astype("<u4").tobytes()) for k, n in enumerate(lengths)]
    path = f"file://{tmp_path}/d"
    I.write_ids(spark.createDataFrame(data, "doc_id long, ids binary"), path, planes=planes)
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    for split in (1, 65_536, 1 << 23):
        got = sorted(map(tuple, I.read_ids(spark, path, split=split).collect()))
        assert [r[:3] for r in got] == [(k, s, n) for k, (s, n) in enumerate(zip(starts, lengths, strict=False))]
        assert [bytes(r[3]) for r in got] == [x for _, x in data]
    assert [r.ids for r in I.read_ids(spark, path, ids=False).collect()] == [None] * len(data)


def test_unlisted_files_are_no_part(spark, tmp_path):
    path = f"{tmp_path}/d"
    I.write_ids(spark.createDataFrame([(1, b"\1\0\0\0")], "doc_id long, ids binary"), f"file://{path}")
    listed = [f[0] for f in json.load(open(f"{path}/_index.json"))["files"]]
    with open(f"{path}/part-000000-0000-left.ids", "wb") as f:  # of an attempt that was lost
        f.write(b"cut off")
    assert len(glob.glob(f"{path}/*.ids")) == len(listed) + 1
    assert I.read_ids(spark, f"file://{path}").count() == 1


def test_damage_is_seen(spark, tmp_path):
    path = f"{tmp_path}/d"
    I.write_ids(spark.createDataFrame([(1, np.arange(5000, dtype="<u4").tobytes())], "doc_id long, ids binary"), f"file://{path}")
    (name,) = glob.glob(f"{path}/*.ids")
    data = bytearray(open(name, "rb").read())
    data[60] ^= 255
    os.chmod(name, 0o644)
    open(name, "wb").write(bytes(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        I.File(pafs.LocalFileSystem().open_input_file(name), "<u4", False).ids(0)
