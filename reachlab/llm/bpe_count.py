"""Token counts by byte-pair merging with a heap and a linked list, without token ids.

A pre-token starts as one symbol per byte. A heap holds the ranks of adjacent
pairs, a doubly linked list the symbols left; the lowest rank (leftmost on ties)
is popped and merged until no pair has a rank. The count is the number of bytes
minus the number of merges: n log n however long a pre-token is.

Merges never cross a pre-token, and a single space between two characters that
are not white space always begins one. So texts are cut there, and the count of
a piece is remembered (bounded) per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# Pieces and pre-tokens that a worker remembers, and characters of a text worked on at a
# time (memory only; the counts depend on neither).
REMEMBERED = 300_000
SLICE = 1 << 20

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x7E\t\n\r{_LATIN}]*")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the pre-token pattern of the vocabulary file, limited to plain text.
_PRETOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[int, str]:
    """The vocabulary's letter for each byte: visible Latin-1 characters stand for
    themselves, the other bytes in ascending order for U+0100 onwards."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def merged_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left of ``symbols`` after all merges."""
    n = left_over = len(symbols)
    at = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank_at = [*map(ranks.get, zip(at, at[1:])), None]  # of the pair that begins here, if it has one
    heap = [rank * n + i for i, rank in enumerate(rank_at) if rank is not None]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        if rank_at[i] != rank:  # stale: one of the two has been merged with another symbol
            continue
        j = after[i]
        merged = at[i] = at[i] + at[j]
        left_over -= 1
        rank_at[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank_at[i] = found = ranks.get((merged, at[k]))
            if found is not None:
                heappush(heap, found * n + i)
        else:
            rank_at[i] = None
        h = before[i]
        if h >= 0:
            rank_at[h] = found = ranks.get((at[h], merged))
            if found is not None:
                heappush(heap, found * n + h)
    return left_over


class Counter:
    """``count(text)``: the number of tokens by a byte-level vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r
                      for r, m in enumerate(told["model"]["merges"])}
        special = [t["content"] for t in told["added_tokens"]]
        # added tokens are found in a text before anything else, the longest of those that begin alike
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.letters = byte_symbols()
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self._pretoken = lru_cache(remembered)(self._merge)
        self._after_space = lru_cache(remembered)(self._spaced)

    def count(self, text: str) -> int:
        return sum(map(self._slice, slices(text)))

    def _slice(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))

    def _ordinary(self, text: str) -> int:
        first, *rest = text.split(" ")
        counts = list(map(self._after_space, rest))
        if None not in counts and not (rest and (not first or first[-1].isspace())):
            return self._piece(first) + sum(counts)
        first, *rest = _BETWEEN_WORDS.split(text)  # white space beside a space
        return self._piece(first) + sum(self._piece(" " + p) for p in rest)

    def _spaced(self, piece: str) -> int | None:
        """Tokens of a space and ``piece``; None if the space touches other white space."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self._piece(" " + piece)

    def _piece(self, text: str) -> int:
        if _PLAIN.fullmatch(text):
            return sum(map(self._pretoken, _PRETOKENS.findall(text)))
        return sum(merged_length(p, self.ranks) for p, _ in self.pre_tokenizer.pre_tokenize_str(text))

    def _merge(self, pretoken: str) -> int:
        return merged_length(pretoken.encode().decode("latin-1").translate(self.letters), self.ranks)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before a space between words."""
    at = 0
    while len(text) - at > size and (cut := _BETWEEN_WORDS.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``: doc_id, text.

    ``n_tokens`` is what the ``tokenizers`` library gives for the byte-level
    vocabulary file (default: public_tokenizers' byte_bpe_50k.json) without
    begin, end or added special tokens: a special token's string inside a text
    is one token, as is the library's default. No text is cut or padded.

    Null and empty texts have 0 bytes and 0 tokens; rows that repeat, also with
    one id, and null ids give a row each; extra columns play no part; an empty
    table gives none. One scan without shuffle. Texts go through Python in
    batches of 500, a long one in slices of about a million characters (more
    only where it has no single space between words).
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in small_batches(batches):
            found = [tokens.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64()),
                 pa.array([n > limit for n in found], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return rows_of(docs, ["doc_id", "text"]).select(
        "doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
