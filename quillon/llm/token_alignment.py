"""Alignment of the tokens of two tokenizers over the same bytes.

The B tokens of a text lie end to end, so their ends are a static interval index: two bisections find, for the bytes of an A
token, the list of B tokens that it overlaps. A gap between tokens that no token of either side spans is a group boundary;
there an A and a B token end together, and these two are linked. Both tokenizers are first applied to the text as a whole or, where
that cannot differ, to the runs of a text that begin at a space after a character that is no white space: byte-level BPE
splits there, and no piece of the other model has a space after anything else (looked up in the model; if one has, whole texts
are encoded). Runs repeat, so a worker keeps tokens and groups of up to CACHE of them, each packed into one byte string, in two
generations: when the younger is full it becomes the elder, and what is met again moves from there into the next.

How often a pair of ids is linked is counted over all documents. Linked tokens end at the same byte, so the bytes of one are a suffix
of the other's: pairs are at most about as many as the vocabularies have bytes, however large the corpus is. That bounds
what is broadcast.

A is a `tokenizers` file of byte-level BPE and encodes a space and the text; B is a SentencePiece model, which adds that space
itself. A null or empty text, and one that the tokens of either do not spell byte for byte (B reads U+2581 as a space), has no
tokens. Repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, discard, materialize
from quillon.llm.plane_ids import byte_letters

SPACE = "▁"
#: Runs a worker remembers, their characters, characters of text at a time, and runs encoded at a time.
CACHE, CACHE_CHARS, CHUNK, LEARN = 500_000, 64, 1 << 20, 4_000
_AFTER_SPACE = re.compile(r"\s ").search

DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links_a binary, links_b binary"


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it shares bytes with. Tokens lie end to end from byte 0."""
    begins = np.concatenate([[0], a_ends[:-1]])
    return np.searchsorted(b_ends, begins, "right"), np.searchsorted(b_ends, a_ends, "left")


def packed(n_a: int, n_b: int, groups: str, a: bytes, b: bytes) -> bytes:
    """One run: counts of its tokens and links, the ids of the links, its groups with a semicolon behind each."""
    return np.array([n_a, n_b, len(a) // 4], "<u4").tobytes() + a + b + groups.encode() + b";"


def unpacked(runs: list[bytes]) -> tuple[int, int, bytes, bytes, bytes]:
    """n_a, n_b, groups, a, b of runs in a row."""
    sizes, data = np.fromiter(map(len, runs), np.int64, len(runs)), np.frombuffer(b"".join(runs), np.uint8)
    head = data[(np.cumsum(sizes) - sizes)[:, None] + np.arange(12)].view("<u4").astype(np.int64)
    ids = 4 * head[:, 2]
    part = np.repeat(np.tile(np.arange(4, dtype=np.uint8), len(runs)), np.column_stack([np.full(len(runs), 12), ids, ids, sizes - 12 - 2 * ids]).ravel())
    a, b, groups = (data[part == k].tobytes() for k in (1, 2, 3))
    return int(head[:, 0].sum()), int(head[:, 1].sum()), groups[:-1], a, b


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        lone = self.b.piece_to_id(SPACE)
        self.lone = [lone] if self.b.id_to_piece(lone) == SPACE else None
        self.by_runs = self.lone is not None and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, bytes | None] = {}
        self.elder: dict[str, bytes | None] = {}

    def _split(self, text: str) -> list[str]:
        """The runs of a text, each without the one space that it begins with."""
        if not self.by_runs:
            return [text]
        parts = text.split(" ")
        if not _AFTER_SPACE(" " + text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if (out[-1] or " ")[-1].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _learn(self, runs: list[str]) -> list[bytes | None]:
        """Tokens and groups of runs, packed; None where the tokens do not spell the run."""
        a_ids = [e.ids for e in self.a.encode_batch([" " + r for r in runs], add_special_tokens=False)]
        b_ids = self.b.encode(runs, num_threads=1)
        out: list[bytes | None] = [None] * len(runs)
        good, a_of, b_of = [], [], []
        for k, (r, x, y) in enumerate(zip(runs, a_ids, b_ids, strict=True)):
            y = y or self.lone
            want = b" " + r.encode()
            if y and b"".join([self.a_bytes[i] for i in x]) == want and b"".join([self.b_bytes[i] for i in y]) == want:
                good.append(k)
                a_of.append(x)
                b_of.append(y)
        if not good:
            return out
        a, b = np.array([i for x in a_of for i in x]), np.array([i for y in b_of for i in y])
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        _, last = overlaps(a_ends, b_ends)
        met = b_ends[last] == a_ends  # no token spans the gap after this A token
        a_cut, b_cut = np.flatnonzero(met) + 1, last[met] + 1  # ends of the groups
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, s, t = [], 0, 0
        for u, v in zip(a_cut.tolist(), b_cut.tolist(), strict=True):
            groups.append(f"{a_text[s]}|{b_text[t]}" if u - s == 1 == v - t else ",".join(a_text[s:u]) + "|" + ",".join(b_text[t:v]))
            s, t = u, v
        link_a, link_b = a[a_cut - 1].astype("<u4").tobytes(), b[b_cut - 1].astype("<u4").tobytes()
        of = np.searchsorted(a_cut, np.cumsum([len(x) for x in a_of]), "right").tolist()  # runs end at boundaries
        first = 0
        for k, x, y, g in zip(good, a_of, b_of, of, strict=True):
            out[k] = packed(len(x), len(y), ";".join(groups[first:g]), link_a[4 * first : 4 * g], link_b[4 * first : 4 * g])
            first = g
        return out

    def _many(self, parts: list[list[str]]) -> list[list[bytes | None]]:
        need = set().union(*parts)
        new = [r for r in need if r not in self.known]
        if len(new) + len(self.known) > CACHE // 2:
            self.elder, self.known, new = self.known, {}, list(need)
        met = [r for r in new if r in self.elder]
        self.known.update(zip(met, map(self.elder.__getitem__, met), strict=True))
        listed = [r for r in new if r not in self.elder]
        for k in range(0, len(listed), LEARN):
            self.known.update(zip(listed[k : k + LEARN], self._learn(listed[k : k + LEARN]), strict=True))
        get = self.known.__getitem__
        out = [list(map(get, p)) for p in parts]
        for r in listed:
            if len(r) > CACHE_CHARS:
                del self.known[r]
        return out

    def texts(self, texts, digest: bool) -> list[tuple]:
        """Rows (n_a, n_b, n_groups, n_links, groups, links_a, links_b); with `digest`, groups is their SHA-256."""
        out, waiting, size = [], [], 0

        def flush() -> None:
            for runs in self._many(waiting):
                if not runs or None in runs:
                    out.append((0, 0, 0, 0, "", b"", b""))
                    continue
                n_a, n_b, groups, a, b = unpacked(runs)
                n = len(a) // 4
                out.append((n_a, n_b, n, n, hashlib.sha256(groups).hexdigest() if digest else groups.decode(), a, b))
            waiting.clear()

        for text in texts:
            waiting.append(self._split(text) if text else [])
            size += len(text or "")
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(documents: DataFrame, a_path: str, b_path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """documents(key, text) -> rows of DOC: `groups` as `a1,a2|b1;a3|b2,b3` (or its SHA-256), the ids of the links as
    little-endian unsigned 32-bit integers. A group ends where a link is, so these are as many."""
    bounded_batches(documents.sparkSession)
    rest = DOC.partition(", ")[2]

    @F.pandas_udf(f"struct<{rest.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = aligner(a_path, b_path).texts(texts, digest)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in rest.split(", ")])

    return documents.select(F.col(key).cast("long").alias("doc_id"), run("text").alias("r")).select("doc_id", "r.*")


def link_counts(found: DataFrame) -> DataFrame:
    """Rows of DOC -> a, b, count: how many links hold the pair. Each task counts its own first."""

    def count(batches):
        keys, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            a, b = np.frombuffer(b"".join(pdf.links_a), "<u4"), np.frombuffer(b"".join(pdf.links_b), "<u4")
            k, n = np.unique(a.astype(np.int64) << 32 | b, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            numbers = np.bincount(at, np.concatenate([numbers, n]), len(keys)).astype(np.int64)
        if len(keys):
            yield pd.DataFrame({"a": keys >> 32, "b": keys & 0xFFFFFFFF, "n": numbers})

    bounded_batches(found.sparkSession)
    return found.select("links_a", "links_b").mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))


def alignment_digests(documents: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Texts are encoded once, and their links written."""
    spark = documents.sparkSession
    found = materialize(aligned(documents, a_path, b_path, key, digest=True), "alignment")
    pairs = link_counts(found).toPandas().astype("int64")  # bounded by the vocabularies, see above
    keys = pairs["a"].to_numpy() << 32 | pairs["b"].to_numpy()
    order = np.argsort(keys)
    most = pairs["count"] == pairs.groupby("b")["count"].transform("max")
    shared = spark.sparkContext.broadcast((keys[order], pairs["count"].to_numpy()[order], most.to_numpy(dtype=bool)[order]))

    @F.pandas_udf("struct<n_best:long,count_sum:long>")
    def score(links_a: pd.Series, links_b: pd.Series) -> pd.DataFrame:
        keys, count, most = shared.value
        sizes = links_a.map(len).to_numpy() // 4
        a, b = np.frombuffer(b"".join(links_a), "<u4"), np.frombuffer(b"".join(links_b), "<u4")
        at = np.searchsorted(keys, a.astype(np.int64) << 32 | b)
        ends = np.cumsum(sizes)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        return pd.DataFrame({"n_best": total(most[at].astype(np.int64)), "count_sum": total(count[at])})

    scored = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", score("links_a", "links_b").alias("s"))
    out = materialize(scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "s.n_best", "s.count_sum", F.col("groups").alias("groups_sha256")), "alignment-digests")
    discard(found)
    return out
