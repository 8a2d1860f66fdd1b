"""An n-gram trie in Elias-Fano form, in memory-mapped levels that are asked context by context."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

import numpy as np

#: Elements that are decoded together.
RUN = 1 << 16
#: log10 values from -SPAN to SPAN have 16 bits: even steps of under 0.0005.
SPAN = 16.0


def to_codes(log_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log_p + SPAN) * (65535 / (2 * SPAN))), 0, 65535).astype(np.uint16)


def from_codes(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * (2 * SPAN / 65535) - SPAN


def mapped(folder: str, name: str, kind: type = np.uint8) -> np.ndarray:
    path = Path(folder, name)
    return np.memmap(path, kind, "r") if path.stat().st_size else np.zeros(0, kind)


class EliasFano:
    """A non-decreasing sequence below ``universe``: the low bits of each element as they are, the high bits as gaps in unary."""

    def __init__(self, values: np.ndarray, universe: int, folder: str, name: str):
        self.n = n = len(values)
        self.bits = max(0, int(math.log2(universe / n))) if n and universe > n else 0
        high = (values >> self.bits) + np.arange(n)
        set_bits = np.zeros(int(high[-1]) + 1 if n else 0, bool)
        set_bits[high] = True
        self.begin = high[::RUN].copy()
        Path(folder, f"{name}.high").write_bytes(np.packbits(set_bits).tobytes())
        with Path(folder, f"{name}.low").open("wb") as f:
            for a in range(0, n, RUN):  # a run fills whole bytes, as RUN is a multiple of 8
                part = values[a : a + RUN]
                f.write(np.packbits((part[:, None] >> np.arange(self.bits)) & 1).astype(np.uint8).tobytes())
        self.high, self.low = (mapped(folder, f"{name}.{x}") for x in ("high", "low"))

    def run(self, k: int) -> np.ndarray:
        """Elements k * RUN to (k + 1) * RUN."""
        a, size = k * RUN, min(RUN, self.n - k * RUN)
        start = int(self.begin[k])
        end = int(self.begin[k + 1]) if k + 1 < len(self.begin) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8 : -(-end // 8)])[start % 8 :]
        out = (np.flatnonzero(bits)[:size] + start - np.arange(a, a + size)) << self.bits
        if self.bits:
            low = np.unpackbits(self.low[a * self.bits // 8 : -(-((a + size) * self.bits) // 8)])[: size * self.bits].reshape(size, self.bits)
            for k in range(self.bits):
                out |= low[:, k].astype(np.int64) << k
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Elements start to stop, decoded run by run."""
        stop = min(stop, self.n)
        if stop <= start:
            return np.zeros(0, np.int64)
        first = start // RUN
        own = np.concatenate([self.run(k) for k in range(first, (stop - 1) // RUN + 1)])
        return own[start - first * RUN : stop - first * RUN]

    def at(self, places: np.ndarray) -> np.ndarray:
        """Elements at sorted places."""
        out = np.zeros(len(places), np.int64)
        edges = np.searchsorted(places, np.arange(len(self.begin) + 1) * RUN)
        for k in range(len(self.begin)):
            if edges[k] < edges[k + 1]:
                out[edges[k] : edges[k + 1]] = self.run(k)[places[edges[k] : edges[k + 1]] - k * RUN]
        return out


class Level:
    """The successors of each context: monotone pointers to a context's range, in it the words in order, beside each a 16-bit value.

    A word is searched in the range that its context's pointers give, by halving that range;
    no other context's words are compared. Stored words go up through the whole level, as each stands
    above the words of the contexts before, so that Elias-Fano can hold them.
    """

    #: Elements of the level that are decoded for one round of searches, unless one context has more.
    STRETCH = 1 << 18

    def __init__(self, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, contexts: int, words: int, folder: str, name: str):
        """``context``, ``word``: sorted distinct pairs of numbers; ``log_p``: of each."""
        self.words = max(1, words)
        ends = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=contexts))]).astype(np.int64)
        self.pointers = EliasFano(ends, len(context) + 1, folder, f"{name}.pointers")
        self.values = EliasFano(context.astype(np.int64) * self.words + word, max(1, contexts) * self.words, folder, f"{name}.words")
        Path(folder, f"{name}.p").write_bytes(to_codes(log_p).tobytes())
        self.codes = mapped(folder, f"{name}.p", np.uint16)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word in its context's own range, or -1. ``context`` is sorted."""
        lo, hi = self.pointers.at(context), self.pointers.at(context + 1)
        out, a = np.full(len(context), -1, np.int64), 0
        while a < len(context):
            e = max(a + 1, int(np.searchsorted(hi, lo[a] + self.STRETCH, "right")))
            start = int(lo[a])
            own = self.values.slice(start, int(hi[e - 1]))
            wanted = context[a:e].astype(np.int64) * self.words + word[a:e]
            left, right = lo[a:e] - start, hi[a:e] - start
            end = right.copy()
            open_ = np.flatnonzero(left < right)
            while len(open_):
                mid = (left[open_] + right[open_]) // 2
                below = own[mid] < wanted[open_]
                left[open_[below]] = mid[below] + 1
                right[open_[~below]] = mid[~below]
                open_ = open_[left[open_] < right[open_]]
            hit = np.flatnonzero(left < end)
            hit = hit[own[left[hit]] == wanted[hit]]
            out[a + hit] = left[hit] + start
            a = e
        return out

    def log_p(self, places: np.ndarray) -> np.ndarray:
        return from_codes(self.codes[places])


class Trie:
    """Three levels: a word; what was seen before it and after it; what was seen after both.

    ``after``: words after a word, with the log10 probability of each. ``before``: words before
    it, each the longer context (before, word), with that context's log10 back-off weight.
    ``last``: words after such a context, whose number is its place in ``before``.
    """

    def __init__(self, words: int, bigrams: tuple, contexts: tuple, trigrams: tuple):
        """bigrams: (word, next, log_p); contexts: (word, before, log back-off); trigrams: (place of the context, next, log_p); each sorted."""
        self.folder = tempfile.TemporaryDirectory(prefix="trie-")
        f = self.folder.name
        self.after = Level(*bigrams, words, words, f, "after")
        self.before = Level(*contexts, words, words, f, "before")
        self.last = Level(*trigrams, len(contexts[0]), words, f, "last")

    def lookup(self, word: np.ndarray, before: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams sorted by (word, before, next): log10 of the trigram's probability or of the back-off weight, whether the trigram was seen, and the context's place or -1."""
        context = self.before.find(word, before)
        known = np.flatnonzero(context >= 0)
        place = np.full(len(word), -1, np.int64)
        place[known] = self.last.find(context[known], nxt[known])
        value, seen = np.zeros(len(word)), place >= 0
        value[seen] = self.last.log_p(place[seen])
        missed = known[~seen[known]]
        value[missed] = self.before.log_p(context[missed])
        return value, seen, context

    def close(self) -> None:
        self.after = self.before = self.last = None
        self.folder.cleanup()
