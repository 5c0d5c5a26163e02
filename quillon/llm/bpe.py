"""Byte-level BPE encoding and decoding by a segment tree.

A piece (one match of the pre-tokenisation pattern) starts as one part per byte. A segment tree over the byte
positions stores at each leaf the rank of the pair that starts there, joined with the position, so that its root is
the leftmost pair of least rank. A merge kills the right part, and updates at most three leaves (the merged part, its
dead neighbour, its live left neighbour), each in logarithmic time: a piece of n bytes takes O(n log n), however long.

Most pieces are short and many are new, so the trees of all short pieces of a batch advance together, one merge each
per step, as NumPy arrays (`merge_together`); longer pieces take `segment_tree_merge` one at a time.

Tokens travel as little-endian unsigned 32-bit integers in a binary column. Pieces repeat, so each Python worker keeps
the tokens of up to CACHE short pieces; memory per worker is bounded by it and by CHUNK characters of text (or the one
text that is longer). Whole texts are encoded, row by row, no shuffle.

Nulls and empty texts encode to no tokens; decoding null gives null. Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

#: Short pieces a worker remembers; a short piece has at most SHORT bytes.
CACHE = 300_000
SHORT = 64
#: Characters of text that are split into pieces at a time.
CHUNK = 500_000
_NONE = 1 << 62


def segment_tree_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of least rank until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    shift = n.bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours, by the byte a part starts at
    mask = (1 << shift) - 1
    while (top := tree[1]) != _NONE:
        i = top & mask
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        changed = [(i, _NONE)]
        if k < n and (r := get(piece[i : after[k]])) is not None:
            changed = [(i, r << shift | i)]
        if j < n - 1:
            changed.append((j, _NONE))
        if (h := before[i]) >= 0:
            r = get(piece[h:k])
            changed.append((h, _NONE if r is None else r << shift | h))
        for at, key in changed:
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                key = a if a < b else b
                if tree[at] == key:
                    break
                tree[at] = key
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """Ranks of all pairs of tokens whose bytes joined are a token, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_together(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Packed token ids of each piece; pieces have 2 to SHORT bytes. One segment tree per piece, a row of an array."""
    count, lengths = len(pieces), np.array([len(p) for p in pieces], np.int64)
    width = 1 << int(lengths.max() - 1).bit_length()
    at = np.arange(width)
    live = at < lengths[:, None]
    tok = np.zeros((count, width), np.int64)
    tok[live] = single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.broadcast_to(at + 1, (count, width)).copy()
    before = np.broadcast_to(at - 1, (count, width)).copy()
    tree = np.full((count, 2 * width), _NONE, np.int64)

    def put(rows, pos, rank):
        tree[rows, width + pos] = np.where(rank < 0, _NONE, rank << 8 | pos)

    first, where = np.nonzero(live[:, 1:])
    put(first, where, pairs(tok[first, where], tok[first, where + 1]))
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        top = tree[rows, 1]
        i, rank = top & 255, top >> 8
        j = after[rows, i]
        k = after[rows, j]
        tok[rows, i], after[rows, i], live[rows, j] = rank, k, False
        put(rows, i, np.full(len(rows), -1))
        put(rows, j, np.full(len(rows), -1))
        right = k < lengths[rows]
        r, ri, rk = rows[right], i[right], k[right]
        before[r, rk] = ri
        put(r, ri, pairs(tok[r, ri], tok[r, rk]))
        h = before[rows, i]
        left = h >= 0
        r, rh = rows[left], h[left]
        put(r, rh, pairs(tok[r, rh], rank[left]))
        for pos in (i, j, np.maximum(h, 0)):
            node = (width + pos) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1
        rows = rows[tree[rows, 1] != _NONE]
    flat, ends = tok[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


#: Characters whose letter, number and space classes need no Unicode tables: ASCII but for its separators, Latin letters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{_LETTERS}]*")


def splitter(pattern: str):
    """findall of a pattern. Texts of plain characters only go to a pattern with the classes written out: it is faster."""
    full = regex.compile(pattern).findall
    written = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: m[0] if m[0][0] == "[" else f"[{m[0]}]", pattern)
    written = written.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", "0-9")
    if r"\p" in written.lower():
        return full
    quick = re.compile(written).findall
    return lambda text: quick(text) if _PLAIN.fullmatch(text) else full(text)


class Codec:
    """Ranks of one vocabulary file, with the worker's cache of pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        self.find = splitter(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Tokens of new pieces. Short ones are remembered, long ones only returned."""
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        long, groups = {}, {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                long[p] = np.array(segment_tree_merge(raw, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in groups.values():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                self.known.update(zip((p for p, _ in part), merge_together([r for _, r in part], self.single, self.pairs), strict=True))
        return long

    def encode(self, texts) -> list[bytes]:
        out: list[bytes] = []
        chunk: list[list[str]] = []
        size = 0

        def flush():
            need = set().union(*chunk)
            new = need - self.known.keys()
            if len(self.known) + len(new) > CACHE:  # learn() forgets all then, so all are to be learnt
                new = need
            extra = self.learn(new)
            get = self.known.__getitem__ if not extra else (lambda p: extra.get(p) or self.known[p])
            out.extend(b"".join(map(get, pieces)) for pieces in chunk)
            chunk.clear()

        for text in texts:
            chunk.append(self.find(text or ""))
            size += len(text or "")
            if size > CHUNK:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def bpe_encode(col, path: str, pattern: str):
    """Column expression: text -> binary of token ids."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series(c.encode(texts), dtype=object)

    return run(col)


def bpe_decode(col, path: str, pattern: str):
    """Column expression: binary of token ids -> the bytes they stand for."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([None if x is None else c.decode(x) for x in ids], dtype=object)

    return run(col)


def tokenized(documents: DataFrame, path: str, pattern: str, *columns: str) -> DataFrame:
    """documents(text, ...) -> the columns asked for, n_tokens, ids, ids_sha256, decoded_sha256.

    Encoding and decoding run in one pass of a worker, and the decoded bytes themselves never cross back to the JVM.
    """
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path, pattern), []
        for ids in c.encode(texts):
            rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return documents.select(*columns, run("text").alias("quillon_t")).select(*columns, "quillon_t.*")


def bpe_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return tokenized(documents, path, pattern, "doc_id").drop("ids")
