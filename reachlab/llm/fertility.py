"""Quality rules: text shape, and tokeniser fertility by public vocabularies.

Fertility of a document: characters per token under two public vocabularies, the
share of byte-fallback tokens, and the entropy of its tokens. A document is
rejected outside a band, which is set per language from its distinct texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, small_batches
from .hashing import SPACE, U64, Words, mix, slices

MIN_WORDS = 50
REPEAT_WINDOW = 3
MAX_REPEAT_PERCENT = 50
REMEMBERED = 500_000  # words a worker remembers the tokens of (memory only)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_MEASURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("lang", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in
      ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_bytes", "n_tokens")],
    T.StructField("entropy", T.DoubleType()),
])


def shape(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = Words(texts)
    n = len(texts)
    counts = np.diff(words.first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[words.offsets[1:]] - run[words.offsets[:-1]]

    data = words.data
    out = {"n_words": counts.astype(np.int64),
           "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80)),
           "n_symbols": per_text(_SYMBOL[data]),
           "n_dup_lines": np.fromiter((_repeated_lines(t) for t in texts), np.int64, n)}
    covered = np.zeros(len(words.doc) + 1, dtype=np.int64)
    w = REPEAT_WINDOW
    if len(words.doc) >= w:
        h = words.hashes()
        with np.errstate(over="ignore"):
            total = h[: len(h) - w + 1].copy()
            for j in range(1, w):
                total = mix(total) + h[j: len(h) - w + 1 + j]
            at = np.flatnonzero(words.doc[: len(h) - w + 1] == words.doc[w - 1:])
            # the text's number is part of the value, as windows count within a text
            value = mix(total[at] ^ mix(words.doc[at].astype(U64)))
        _, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
        for i in range(w):
            covered[at[times[inverse] > 1] + i] = 1
    run = np.concatenate([[0], np.cumsum(covered[:-1])])
    out["n_repeat_words"] = run[words.first[1:]] - run[words.first[:-1]]
    return out


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Fertility:
    """Tokens of words by a sentencepiece model and a tiktoken rank file.

    A document's tokens are those of its words, each encoded alone. Words get
    numbers; their tokens stand in arrays by these numbers.
    """

    def __init__(self, piece_path: str, rank_path: str, remembered: int = REMEMBERED):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        size = self.pieces.get_piece_size()
        self.is_byte = np.fromiter((self.pieces.is_byte(i) for i in range(size)), bool, size)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remembered = remembered
        self.number: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint16)  # piece ids of all known words in a row
        self.begin = np.zeros(1, np.int64)  # where each word's ids begin, and the end
        self.tokens = np.empty(0, np.int64)  # number of rank tokens of each word

    def measure(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, byte-fallback pieces, rank tokens, and entropy of the pieces in bits, per text."""
        cut = [t.split() for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for c in cut for w in c]
        numbers = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            numbers[new] = [self.number[words[i]] for i in new]
        sizes = self.begin[numbers + 1] - self.begin[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begin[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        edges = np.concatenate([[0], np.cumsum(counts)])
        cuts = ends[edges]
        run = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        n_bytes = run[cuts[1:]] - run[cuts[:-1]]
        run = np.concatenate([[0], np.cumsum(self.tokens[numbers])])
        n_tokens = run[edges[1:]] - run[edges[:-1]]
        entropy = np.fromiter((_entropy(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)),
                              np.float64, len(cut))
        if len(self.number) > self.remembered:
            for w in list(self.number)[self.remembered:]:
                del self.number[w]
            self.begin = self.begin[: self.remembered + 1]
            self.ids, self.tokens = self.ids[: self.begin[-1]], self.tokens[: self.remembered]
        return np.diff(cuts), n_bytes, n_tokens, entropy

    def _learn(self, new: list[bytes]) -> None:
        spelled = [w.decode() for w in new]
        found = self.pieces.encode(spelled, num_threads=1)
        ranks = self.ranks.encode_ordinary
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, *(np.array(x, np.uint16) for x in found)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.tokens = np.concatenate([self.tokens, np.fromiter((len(ranks(" " + s)) for s in spelled), np.int64, len(new))])


def _entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    ids = np.sort(ids, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    counts = np.sort(np.diff(cuts)).astype(float)  # sorted: the sum does not depend on the ids
    return max(0.0, float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)))


_FERTILITY: dict[tuple[str, str], Fertility] = {}


def _measures(piece_path: str, rank_path: str):
    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (piece_path, rank_path)
        if key not in _FERTILITY:
            _FERTILITY[key] = Fertility(*key)
        fertility = _FERTILITY[key]
        for batch in small_batches(batches):
            texts = [(t or "").encode() for t in batch.column(3).to_pylist()]
            for part in slices(texts):
                some = texts[part]
                columns = shape(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(part.start, len(some)) for i in range(3)]
                    + [pa.array(columns[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words")]
                    + [pa.array(c) for c in fertility.measure(some)], names=_MEASURES.names)
    return measures


@dataclass(frozen=True)
class Band:
    """How far a measure may lie from its language's median.

    ``deviations`` counts robust standard deviations (interquartile range /
    1.349); ``least`` is the least half-width, as a share of the median if
    ``relative``. ``bin`` is the grid on which the quartiles are taken.
    """

    deviations: float
    least: float
    relative: bool
    bin: float
    below: bool = True
    above: bool = True


# Parameters of the method.
BANDS = {
    "chars_per_piece": Band(5.0, 0.10, True, 0.002),
    "chars_per_token": Band(5.0, 0.10, True, 0.002),
    "byte_share": Band(5.0, 0.05, False, 0.001, below=False),
    "entropy": Band(5.0, 1.0, False, 0.005, above=False),
}


def _quartiles(measured: DataFrame) -> DataFrame:
    """Median and quartiles of each measure per language, from counts on a fixed grid.

    The counts cover all documents that pass the base rules, do not depend on
    the order of rows, and are a bounded number of rows per language. A text
    counts once per language, however many rows hold it (told by ``row``).
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.round(F.col(name) / band.bin).cast("long").alias("at"))
        for name, band in BANDS.items()])).alias("m")
    texts = measured.where("not base_failed").groupBy("lang_key", "row").agg(*[F.min(c).alias(c) for c in BANDS])
    counts = texts.select("lang_key", pairs).groupBy(
        "lang_key", "m.measure", "m.at").agg(F.count(F.lit(1)).alias("n"))
    # a short sorted list per language and measure: the grid bounds its length
    grid = counts.groupBy("lang_key", "measure").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("grid"), F.sum("n").alias("total"))

    def quantile(share: float):
        def step(state, x):
            run = state["run"] + x["n"]
            return F.struct(run.alias("run"), F.when(
                state["at"].isNull() & (run >= F.ceil(F.col("total") * F.lit(share))), x["at"]
            ).otherwise(state["at"]).alias("at"))
        start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("at"))
        return F.aggregate("grid", start, step)["at"]

    return grid.select("lang_key", "measure", quantile(0.25).alias("q_1"), quantile(0.5).alias("q_2"),
                       quantile(0.75).alias("q_3"))


def _limits(quartiles: DataFrame) -> DataFrame:
    """One row per language with the limits of every band."""
    columns = []
    for name, band in BANDS.items():
        of = {q: F.max(F.when(F.col("measure") == name, F.col(q) * F.lit(band.bin))) for q in ("q_1", "q_2", "q_3")}
        least = of["q_2"] * F.lit(band.least) if band.relative else F.lit(band.least)
        half = F.greatest((of["q_3"] - of["q_1"]) / F.lit(1.349) * F.lit(band.deviations), least)
        columns += [(of["q_2"] - half).alias(f"{name}_low"), (of["q_2"] + half).alias(f"{name}_high")]
    return quartiles.groupBy(F.col("lang_key").alias("band_lang")).agg(*columns)


def quality(documents: DataFrame, piece_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """Base rules and fertility verdict of every row of documents (doc_id, text, lang).

    doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, the four measures (chars_per_piece, chars_per_token,
    byte_share, entropy), kept; and ``row``, a hash of the text, which tells
    rows that repeat a doc_id apart.

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows. Otherwise ``kept`` says whether every measure lies in
    its language's band. Null texts have no words and fail; a missing language
    is a language of its own. The bands count each distinct text of a language
    once; rows that repeat are judged, and returned, as often as they occur.
    Columns other than the three play no part. An empty table gives an empty one.
    """
    if piece_path is None or rank_path is None:
        import public_tokenizers
        piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
        rank_path = rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
                            F.col("lang").cast("string").alias("lang"), "text")
    measured = materialise(docs.mapInArrow(_measures(piece_path, rank_path), _MEASURES), "measures")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    measured = measured.select(
        "*", F.coalesce("lang", F.lit("")).alias("lang_key"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .alias("base_failed"),
        share("word_chars", "n_pieces").alias("chars_per_piece"), share("word_chars", "n_tokens").alias("chars_per_token"),
        share("n_bytes", "n_pieces").alias("byte_share"))
    limits = _limits(_quartiles(measured))
    fits = F.lit(True)
    for name, band in BANDS.items():
        if band.below:
            fits = fits & (F.col(name) >= F.col(f"{name}_low"))
        if band.above:
            fits = fits & (F.col(name) <= F.col(f"{name}_high"))
    joined = measured.join(limits, F.col("lang_key") == F.col("band_lang"), "left")
    return joined.select(
        "doc_id", "row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        *BANDS, F.when(F.col("base_failed"), False).otherwise(fits).alias("kept"))


def keep_good_documents(documents: DataFrame, **paths: str) -> DataFrame:
    """Documents without those that ``quality`` rejects; same columns."""
    gone_id, gone_row = free_name(documents, "_gone_id"), free_name(documents, "_gone_row")
    gone = quality(documents, **paths).where(~F.col("kept")).select(
        F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)).distinct()
    return documents.join(gone, documents["doc_id"].eqNullSafe(F.col(gone_id))
                          & (F.xxhash64(documents["text"]) == F.col(gone_row)), "left_anti")
