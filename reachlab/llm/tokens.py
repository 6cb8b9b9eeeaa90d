"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library.

The library spends several microseconds on each word it has not just seen. A text
is therefore cut at single spaces between words (neither vocabulary merges
across them) and the pieces' ids are remembered per worker. A new piece of plain
Latin characters is cut at the vocabulary's own pre-token pattern, and each new
pre-token goes through the library's model once; any other new piece goes
through the whole tokenizer as it is, and so does a text that may hold the string of
an added token (which the library gives that token's id).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# How many pieces and pre-tokens a worker remembers for good, and how many more
# pre-tokens for the texts just read (memory only; the ids do not depend on either).
REMEMBERED = 400_000
RARE = 50_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x7E\t\n\r{_LATIN}]*")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# The pre-token patterns of the two vocabulary files, limited to plain text.
# (Letters stand first, which no contraction begins with, since they are the usual case.)
_WORD_PATTERN = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_BYTE_PATTERN = re.compile(
    rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The word vocabulary drops white space; the byte vocabulary keeps it.
        self.keeps_space = self.tokenizer.normalizer is None
        self.remembered = remembered
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0]
                        for c in (*range(0x20, 0x7F), 9, 10, 13, *range(0xC0, 0x100))}

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if "<|" in text:  # the strings of the added tokens begin like this
                out.append(self._library(text))
                continue
            first, *rest = text.split(" ")
            found = list(map(self.pieces.get, rest))
            if None in found:
                for i, piece in enumerate(rest):
                    if found[i] is None:
                        found[i] = self._piece(piece)
            if self.keeps_space and (None in found or _edge_space(first) or not first and rest):
                out.append(self._whole(text))  # white space beside a space
            else:
                out.append(self._encode(first) + b"".join(found))
            if len(self.rare) > RARE:
                self.rare = {}
        return out

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and a piece after it; None if white space touches that space."""
        if piece in self.pieces:
            return self.pieces[piece]
        if self.keeps_space:
            if not piece or _edge_space(piece):
                return None
            raw = self._encode(" " + piece)
        else:
            raw = self._encode(piece)
        if len(self.pieces) < self.remembered:
            self.pieces[piece] = raw
        return raw

    def _whole(self, text: str) -> bytes:
        pieces = _BETWEEN_WORDS.split(text)
        return b"".join(self._encode(" " + p if i else p) for i, p in enumerate(pieces))

    def _encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self._pretoken(text)
        found = _BYTE_PATTERN.findall(text) if self.keeps_space else _WORD_PATTERN.findall(text.lower())
        return b"".join(map(self._pretoken, found))

    def _pretoken(self, pretoken: str) -> bytes:
        raw = self.known.get(pretoken) or self.rare.get(pretoken)
        if raw is None:
            if _PLAIN.fullmatch(pretoken):
                found = [t.id for t in self.tokenizer.model.tokenize(pretoken.translate(self.letters))]
            else:
                found = self.tokenizer.encode(pretoken, add_special_tokens=False).ids
            raw = array("I", found).tobytes()
            (self.known if len(self.known) < self.remembered else self.rare)[pretoken] = raw
        return raw


def _edge_space(piece: str) -> bool:
    return piece[:1].isspace() or piece[-1:].isspace()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")
