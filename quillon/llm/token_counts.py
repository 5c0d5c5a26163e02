"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match of a word in one pass; dynamic programming carries, for
each end position, the best score and the number of pieces of the path that has it. No path is ever rebuilt. Tie rule
of the reference tokenizer: a path replaces another only when its score is strictly greater, starts being tried from
left to right, so of equal scores the one whose last piece starts first stays. Where no one-character piece begins at
a position, the character may be taken as unknown at the least score minus UNK_PENALTY; with byte fallback it then
counts one token for each UTF-8 byte.

The short words of a batch go through the automaton as one string, and their dynamic programs advance together, one end
position a step, as NumPy arrays (`words_together`); longer words are settled one by one (`word`).

Words are the metaspace pieces of a text: it gets a leading marker, spaces become markers, and a word starts at each
marker. Words repeat, so a worker keeps the counts of up to CACHE words. Whole texts, row by row, no shuffle.

Nulls and empty texts have 0 tokens. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

MARK = "▁"
UNK_PENALTY = 10.0
CACHE = 600_000
CACHE_CHARS = 64
#: Characters of text that are split into words at a time.
CHUNK = 500_000


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        """pieces: (text, score), what text can be split into; a repeated text keeps its last score."""
        self.scores = dict(pieces)
        self.auto = ahocorasick.Automaton()
        self.lengths, self.values = np.zeros(len(self.scores), np.int64), np.zeros(len(self.scores))
        for i, (text, score) in enumerate(self.scores.items()):
            if text:
                self.auto.add_word(text, i)
                self.lengths[i], self.values[i] = len(text), score
        self.auto.make_automaton()
        self.each = list(zip(self.lengths.tolist(), self.values.tolist(), strict=True))
        used = set().union(*self.scores)
        self.gap = next(chr(c) for c in range(1, 0x110000) if chr(c) not in used)  # no piece spans it
        self.unk = min(self.scores.values()) - UNK_PENALTY
        self.bytes = byte_fallback
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n, unk, low = len(word), self.unk, float("-inf")
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        fused = set()  # ends whose path's last token is an unknown one; neighbouring unknowns are one token
        end, top, at, single = 1, low, 0, False
        for last, piece in chain(self.auto.iter(word), [(n, None)]):  # by end; there the longest first
            length, score = (1, low) if piece is None else self.each[piece]
            while end <= last:  # settle `end`: its last character may be unknown where no one-character piece ends
                if single or top >= best[end - 1] + unk:
                    best[end], count[end] = top, count[at] + 1
                else:
                    best[end] = best[end - 1] + unk
                    if self.bytes:
                        count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        count[end] = count[end - 1] + (end - 1 not in fused)
                        fused.add(end)
                end, top, single = end + 1, low, False
            s = best[end - length] + score
            if s > top:
                top, at = s, end - length
            single = single or length == 1
        return count[n]

    def words_together(self, words: list[str]) -> list[int]:
        """The counts of many words. Positions are those of the words joined by a character that no piece has."""
        joined = self.gap.join(words)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        found = list(self.auto.iter(joined))
        ends = np.fromiter((m[0] for m in found), np.int64, len(found)) + 1
        piece = np.fromiter((m[1] for m in found), np.int64, len(found))
        length, score = self.lengths[piece], self.values[piece]
        inside = ends - begin[np.searchsorted(begin, ends, "left") - 1]
        order = np.argsort(inside, kind="stable")  # by end in the word, then by place, there the longest first
        ends, length, score = ends[order], length[order], score[order]
        steps = np.searchsorted(inside[order], np.arange(int(size.max()) + 2))
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        units = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        best = np.full(len(joined) + 1, -np.inf)
        count, single, fused = np.zeros(len(joined) + 1, np.int64), np.zeros(len(joined) + 1, bool), np.zeros(len(joined) + 1, bool)
        best[begin] = 0.0
        for e in range(1, int(size.max()) + 1):
            a, b = steps[e], steps[e + 1]
            if b > a:
                at, start = ends[a:b], ends[a:b] - length[a:b]
                s = best[start] + score[a:b]
                group = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                top = np.maximum.reduceat(s, group)
                number = np.repeat(np.arange(len(group)), np.diff(np.append(group, b - a)))
                first = np.minimum.reduceat(np.where(s == top[number], np.arange(b - a), b - a), group)
                here = at[group]
                best[here], count[here] = top, count[start[first]] + 1
                single[here] = length[a:b][np.append(group[1:], b - a) - 1] == 1
            here = begin[size >= e] + e
            lone = best[here - 1] + self.unk
            here = here[~single[here] & (lone > best[here])]
            best[here] = best[here - 1] + self.unk
            count[here] = count[here - 1] + (units[here - 1] if self.bytes else ~fused[here - 1])
            fused[here] = True
        return count[begin + size].tolist()

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of new words (without their marker). Short ones are remembered, long ones only returned."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        short = [w for w in words if len(w) <= CACHE_CHARS]
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            self.known.update(zip(part, self.words_together([MARK + w for w in part]), strict=True))
        return {w: self.word(MARK + w) for w in words if len(w) > CACHE_CHARS}

    def texts(self, texts) -> list[int]:
        out: list[int] = []
        chunk: list[list[str]] = []
        size = 0

        def flush() -> None:
            need = set().union(*chunk)
            new = need - self.known.keys()
            if len(self.known) + len(new) > CACHE:  # learn() forgets all then, so all are to be learnt
                new = need
            extra = self.learn(new)
            get = self.known.__getitem__ if not extra else (lambda w: extra[w] if w in extra else self.known[w])
            out.extend(sum(map(get, words)) for words in chunk)
            chunk.clear()

        for text in texts:
            chunk.append((text or "").replace(" ", MARK).removeprefix(MARK).split(MARK) if text else [])
            size += len(text or "")
            if size > CHUNK:
                flush()
                size = 0
        flush()
        return out

    def text(self, text: str | None) -> int:
        return self.texts([text])[0]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A counter over the pieces and scores of a SentencePiece model file.

    Control, unknown, unused and byte pieces are no text: what spells them, such as </s> or <0x0A>, is split like any other.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(m.get_piece_size())
    plain = [i for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
    return Counter([(m.id_to_piece(i), m.get_score(i)) for i in plain], any(m.is_byte(i) for i in every))


def token_counts(documents: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """documents(key, text) -> key, n_tokens."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series(c.texts(texts), dtype="int64")

    return documents.select(key, run("text").alias("n_tokens"))
