"""One scan of a whole text into NumPy arrays over its words, shared by the quality operators."""

from __future__ import annotations

import numpy as np

#: White space between words: the ASCII characters 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\r\x0b\x0c"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE.encode())] = True


class Scan:
    """Words are maximal runs of other than SPACE. Invalid surrogates are encoded as they are; null is empty."""

    __slots__ = ("text", "raw", "n", "chars", "starts", "ends", "bytes", "counts", "ids", "n_ids", "lines")

    def __init__(self, text: str | None):
        self.text = text = text or ""
        self.raw = text.encode("utf-8", "surrogatepass")
        words = self.raw.split()
        self.n = len(words)
        seen: dict[bytes, int] = {}
        self.ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, self.n)
        self.n_ids = len(seen)
        self.bytes = b = np.frombuffer(self.raw, np.uint8)
        space = np.concatenate([[True], _IS_SPACE[b], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.counts = np.bincount(b, minlength=256) if len(b) else np.zeros(256, np.int64)
        self.chars = len(text) - int(self.counts[list(SPACE.encode())].sum())
        self.lines = [x for x in text.split("\n") if x.strip(SPACE)]

    def count(self, chars: bytes) -> int:
        return int(self.counts[list(chars)].sum())

    @property
    def dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        return len(self.lines) - len(set(self.lines))

    def upper_words(self) -> int:
        """Words of two bytes or more with a capital and no small letter of A-Z."""
        if not self.n:
            return 0
        up = np.concatenate([[0], np.cumsum((self.bytes >= 65) & (self.bytes <= 90))])
        low = np.concatenate([[0], np.cumsum((self.bytes >= 97) & (self.bytes <= 122))])
        s, e = self.starts, self.ends
        return int(((up[e] > up[s]) & (low[e] == low[s]) & (e - s > 1)).sum())

    def repeat_words(self, window: int = 5) -> int:
        """Words in a `window`-word window that occurs at least twice in the text, the first occurrence included."""
        n = self.n - window + 1
        if n < 2:
            return 0
        key, span = self.ids[:n], self.n_ids
        for i in range(1, window):
            if span > (1 << 62) // self.n_ids:  # exact: keys are renumbered densely before they could overflow
                _, key = np.unique(key, return_inverse=True)
                span = int(key.max()) + 1
            key = key * self.n_ids + self.ids[i : n + i]
            span *= self.n_ids
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        if not same.any():
            return 0
        at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        edge = np.bincount(at, minlength=self.n + 1) - np.bincount(at + window, minlength=self.n + 1)
        return int((np.cumsum(edge[:-1]) > 0).sum())
