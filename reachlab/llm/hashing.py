"""Vectorised 64-bit hashes of words and word shingles over UTF-8 buffers.

Everything is exact integer arithmetic modulo 2**64 and depends on nothing but
the bytes, so any task on any machine gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first n values of a splitmix64 stream."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) + _GOLDEN * np.arange(1, n + 1, dtype=U64))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = stream(1, 256)
_BYTE[SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = U64(0xD6E8FEB86659FD93)
_POSITION = stream(2, 64)  # weights of the places of a shingle


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    out[0] = 1
    out[1:] = _BASE
    return np.multiply.accumulate(out)


class Words:
    """Words (runs without U+0020, U+0009-U+000D) of a batch of texts.

    ``start``/``end`` are byte positions in ``data``; ``doc`` is the text's
    number; ``first`` has the number of the first word of each text, and one
    more entry at its end.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        data, n = self.data, len(self.data)
        inside = ~SPACE[data]
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edge = np.unique(self.offsets[(self.offsets > 0) & (self.offsets < n)])
            opens[edge] = inside[edge]
            closes[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` treats A-Z as a-z."""
        if not len(self.start):
            return np.empty(0, dtype=U64)
        lengths = self.end - self.start
        # bytes of the words only, each with its place in its word
        place = np.arange(int(lengths.sum()), dtype=np.int64)
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place -= np.repeat(heads, lengths)
        values = (_FOLDED if fold else _BYTE)[self.data[~SPACE[self.data]]]
        with np.errstate(over="ignore"):
            values = values * _powers(int(lengths.max()))[place]
            return mix(np.add.reduceat(values, heads) + lengths.astype(U64) * _GOLDEN)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every k-word shingle, in text order, with repeats.

    A text of 1 to k-1 words gives its whole word sequence as one shingle.
    """
    n = len(hashes)
    with np.errstate(over="ignore"):
        whole, docs = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
        if n >= k:
            total = hashes[: n - k + 1] * _POSITION[0]
            for j in range(1, k):
                total = total + hashes[j: n - k + 1 + j] * _POSITION[j]
            same = words.doc[: n - k + 1] == words.doc[k - 1:]
            whole = mix(total[same] + U64(k))
            docs = words.doc[: n - k + 1][same]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            total = np.zeros(len(short), dtype=U64)
            for j in range(k - 1):
                has = counts[short] > j
                total[has] += hashes[words.first[short[has]] + j] * _POSITION[j]
            whole = np.concatenate([whole, mix(total + counts[short].astype(U64))])
            docs = np.concatenate([docs, short])
            order = np.argsort(docs, kind="stable")
            whole, docs = whole[order], docs[order]
    return whole, docs


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z read as a-z."""
    words = Words(texts)
    values, docs = shingles(words, words.hashes(fold=True), k)
    cuts = np.searchsorted(docs, np.arange(len(texts) + 1))
    return [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(texts: list[bytes], limit: int = 500_000) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes, so that work arrays stay small.

    The arrays take some 100 bytes for each byte of text; a text above the limit
    is a slice of its own.
    """
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))
