"""Vectorised view of a batch of texts: words, lines and 64-bit hashes of any span, without a Python loop per word.

A word is a maximal run of bytes other than space and tab to carriage return. Hashes are polynomials modulo
2**64 over random byte values, finalised with a full-avalanche mixer; two spans get the same hash when their
bytes are the same, and otherwise with a probability of about 2**-64.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = 12

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """base**i modulo 2**64 from two small tables."""

    def __init__(self, base: int):
        self.base = base
        self.low = self._run(base, 1 << _LOW)
        self.high = self._run(pow(base, 1 << _LOW, 1 << 64), 64)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)

    def at(self, i: np.ndarray) -> np.ndarray:
        top = (int(i.max()) >> _LOW) + 1 if len(i) else 0
        if top > len(self.high):
            self.high = self._run(pow(self.base, 1 << _LOW, 1 << 64), 2 * top)
        return self.low[i & ((1 << _LOW) - 1)] * self.high[i >> _LOW]

    def first(self, n: int) -> np.ndarray:
        blocks = (n >> _LOW) + 1
        self.at(np.array([n]))
        return (self.high[:blocks, None] * self.low[None, :]).ravel()[:n]


_UP, _DOWN = Powers(_BASE), Powers(_INVERSE)


class Scan:
    """The words of a list of texts (None counts as empty).

    data: UTF-8 bytes, each text followed by a line feed. doc_start, doc_end: the texts' bounds in it.
    word_start, word_end, word_doc: the words' bounds and their text's index.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, space: np.ndarray = SPACE):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter((len(x) + 1 for x in raw), dtype=np.int64, count=len(raw))
        self.doc_end = np.cumsum(sizes) - 1
        self.doc_start = self.doc_end - sizes + 1
        gap = space[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.gap = gap
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.word_doc = np.searchsorted(self.doc_end, self.word_start)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.doc_start)

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, dtype=U)
            np.cumsum(_VALUE[self.data] * _UP.first(n), out=self._sums[1:])
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _DOWN.at(start) + (end - start).astype(U))

    def words(self) -> np.ndarray:
        """A hash of each word."""
        return self.hashes(self.word_start, self.word_end)

    def word_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) word of each text."""
        return np.searchsorted(self.word_doc, np.arange(len(self))), np.searchsorted(self.word_doc, np.arange(len(self)), side="right")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line (split at line feeds)."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(self.doc_end, end)


def pieces(text: str, size: int, gaps: str, words: str, keep: int) -> Iterator[tuple[str, int]]:
    """A text in pieces of about ``size`` characters, cut at ``gaps`` only, each behind the last ``keep`` words of what came before; and their number."""
    if len(text) <= size:
        yield text, 0
        return
    at, gap, word = 0, re.compile(gaps), re.compile(words)
    before: deque[str] = deque(maxlen=keep)
    while at < len(text):
        cut = gap.search(text, min(at + size, len(text)))
        end = cut.start() if cut else len(text)
        yield " ".join([*before, text[at:end]]), len(before)
        if keep:
            before.extend(m.group() for m in word.finditer(text, at, end))
        at = end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    h = np.full(n, size, dtype=U)
    for i in range(size):
        h = (h ^ words[i : i + n]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    return mix(h)


def shingle_sets(scan: Scan, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; a text with fewer words has its whole sequence as its only one."""
    words = scan.words()
    first, last = scan.word_bounds()
    full = shingle_hashes(words, size)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        n = b - a
        if n >= size:
            own = np.sort(full[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(shingle_hashes(words[a:b], n))
        else:
            out.append(words[:0])
    return out
