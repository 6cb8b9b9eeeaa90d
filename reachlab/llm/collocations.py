"""Phrase collocations from count streams in prefix and suffix order.

One stream holds, for each place in a text, the words that begin there (five at
most, within a piece). Sorted, all windows that begin with the same words lie
together: one pass of running totals gives the count of every phrase of one to five
words, with as many open runs as words. Ranges of the sorted stream are read apart;
only the runs that touch an end of a range are added up afterwards.

The phrases that are frequent enough form a second, much smaller stream. In prefix
order it is merged in lockstep with the stream of what phrases begin with, which
tells a phrase the counts of its first parts, and a part those of its extensions to
the right; in suffix order (words reversed) the same pass gives the last parts and
the extensions to the left. Both are sort-merge joins of sorted streams, no lookups.

Windows stop where no frequent phrase can go on: pairs of words are counted in a
table of buckets, whose count is never below that of a pair in it. The table saves
work, it decides nothing; once the pairs overfill it, windows are just longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, rows_of

LONGEST = 5
LEAST = 100
TOP = 2000
# Bytes of text for one bucket, and the least and most buckets there are (2^28 bits are 32 MB).
BYTES_PER_BUCKET = 48
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 28
BLOCK = 1 << 16  # buckets of one block of the table
TOKENS = 1_500_000  # tokens that are counted together before they go on
SLICE = 1 << 20  # bytes of a text that are cut into words at a time
SALTS = 64
FEW_LANGUAGES = 10_000  # rows of the table of languages that go to every task
RANGE_BYTES = 16 << 20  # of the stream, about, in one range

# Words are lower-case (A-Z only); pieces end at the characters of the rule.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
# A phrase's key is its language and words, joined by tabs. Below a tab there is nothing:
# smaller bytes (in a language also tab and line feed) are escaped by a line feed.
_LOW = range(11)
_ESCAPES = {bytes([b]): b"\n" + bytes([0x40 + b]) for b in _LOW}
_END = 0  # the id between pieces


def _escape(word: bytes) -> bytes:
    if any(b < 11 for b in word):
        return b"".join(_ESCAPES.get(word[i:i + 1], word[i:i + 1]) for i in range(len(word)))
    return word


def _unescaped(c: Column) -> Column:
    for b in _LOW:  # line feeds last: what they give cannot begin another escape
        c = F.replace(c, F.lit("\n" + chr(0x40 + b)), F.lit(chr(b)))
    return c


class _Words(dict):
    """Word -> id from 1, in the order met; ``hashes`` and ``names`` by id."""

    def __init__(self):
        super().__init__({b"\n": _END})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.names)
        self.names.append(word)
        return found

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.names), dtype=np.uint64, count=len(self.names))


class _Chunk:
    """Tokens of some texts as ids, each with its language; flushed at TOKENS of them."""

    def __init__(self):
        self.words, self.langs = _Words(), {}
        self.ids: list[np.ndarray] = []
        self.lang: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: bytes, tokens: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        self.lang.append((self.langs.setdefault(lang, len(self.langs)), len(tokens)))
        self.size += len(tokens)

    def tail(self, k: int) -> list[bytes]:
        """At most ``k`` words at the end that belong to a piece still open."""
        found: list[bytes] = []
        for ids in reversed(self.ids):
            for i in reversed(ids[-k:].tolist()):
                if i == _END or len(found) == k:
                    return found[::-1]
                found.append(self.words.names[i])
        return found[::-1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and languages, with LONGEST ends behind them."""
        ids = np.concatenate([*self.ids, np.zeros(LONGEST, np.int64)])
        code, n = np.array(self.lang or [(0, 0)]).T
        return ids, np.concatenate([np.repeat(code, n), np.zeros(LONGEST, np.int64)])


def _tokens(text: str) -> Iterator[list[bytes]]:
    """Words and piece ends (b"\\n") of ``text``, about SLICE bytes at a time."""
    raw = text.encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield list(filter(None, raw[at:end].replace(b"\n", b" \n ").split(b" ")))
        at = end
    yield [b"\n"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, int]]:
    """Chunks of the partition's texts, and in how many of its last places no window begins yet.

    A chunk that is flushed within a piece hands the piece's last words on to the next one.
    """
    chunk = _Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = _escape(lang.as_py().encode())
            for tokens in _tokens(text.as_py()):
                chunk.add(lang, tokens)
                if chunk.size >= TOKENS:
                    tail = chunk.tail(LONGEST - 1)
                    yield chunk, len(tail)
                    chunk = _Chunk()
                    chunk.add(lang, tail)
    if chunk.size:
        yield chunk, 0


def _pair_buckets(chunk: _Chunk, ids: np.ndarray, lang: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the pair of words that begins at each place but the last."""
    h = chunk.words.hashes()[ids]
    of_lang = np.array([xxhash.xxh64_intdigest(b, 1) for b in chunk.langs] or [0], dtype=np.uint64)
    mixed = (h[:-1] ^ of_lang[lang[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _pairs(buckets: int, least: int) -> Callable:
    """(block, places, counts) of the buckets that a chunk's pairs fall into; counts end at ``least``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in _chunks(batches):
            ids, lang = chunk.arrays()
            n = len(ids) - LONGEST - held
            bucket = _pair_buckets(chunk, ids, lang, buckets)[:n]
            bucket, found = np.unique(bucket[(ids[:n] != _END) & (ids[1:n + 1] != _END)], return_counts=True)
            block, starts = np.unique(bucket // BLOCK, return_index=True)
            places = np.split((bucket % BLOCK).astype("<u2"), starts[1:])
            counts = np.split(np.minimum(found, least).astype("<u2"), starts[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int32()), pa.array([p.tobytes() for p in places[:len(block)]], pa.binary()),
                 pa.array([c.tobytes() for c in counts[:len(block)]], pa.binary())], names=["block", "places", "counts"])
    return count


def _full_buckets(least: int) -> Callable:
    """(block, bits): which buckets of a block reach ``least``; a block lies in one partition."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = total.setdefault(block, np.zeros(BLOCK, np.uint16))
                at = np.frombuffer(places, "<u2")
                t[at] = np.minimum(t[at] + np.frombuffer(counts, "<u2").astype(np.int64), least)
        blocks = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([np.packbits(total[b] >= least).tobytes() for b in blocks], pa.binary())],
            names=["block", "bits"])
    return add


def frequent_pairs(texts: DataFrame, least: int) -> tuple[int, np.ndarray]:
    """How many buckets there are, and a bit for each that may hold a pair of ``least`` occurrences."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (size // BYTES_PER_BUCKET).bit_length()))
    spark = texts.sparkSession
    n = min(buckets // BLOCK, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = texts.mapInArrow(_pairs(buckets, least), "block int, places binary, counts binary") \
        .repartition(n, "block").mapInArrow(_full_buckets(least), "block int, bits binary")
    bits = np.zeros(buckets // 8, np.uint8)
    for r in rows.collect():  # MOST_BUCKETS bits at most, whatever the input
        at = r["block"] * (BLOCK // 8)
        bits[at:at + BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return buckets, bits


def _windows(buckets: int, bits) -> Callable:
    """(key, n): the distinct windows of a chunk, cut where a pair of words is too rare, in order."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for chunk, held in _chunks(batches):
            ids, lang = chunk.arrays()
            n = len(ids) - LONGEST - held
            bucket = _pair_buckets(chunk, ids, lang, buckets)
            goes_on = (ids[:-1] != _END) & (ids[1:] != _END) & \
                ((table[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1).astype(bool)
            goes_on = np.concatenate([goes_on, np.zeros(LONGEST, bool)])
            first = np.flatnonzero(ids[:n] != _END)
            cols, on = [ids[first]], np.ones(len(first), bool)
            for d in range(1, LONGEST):
                on = on & goes_on[first + d - 1]
                cols.append(np.where(on, ids[first + d], _END))
            yield from _distinct(chunk, lang[first], cols)
    return windows


def _distinct(chunk: _Chunk, lang: np.ndarray, cols: list[np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    bits = max(1, len(chunk.words.names).bit_length())
    a = (lang << (2 * bits)) | (cols[0] << bits) | cols[1]
    b = (cols[2] << (2 * bits)) | (cols[3] << bits) | cols[4]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else [])
    counts = np.diff(np.append(starts, len(a)))
    at = order[starts]
    names = np.array([_escape(w) for w in chunk.words.names], dtype=object)
    langs = np.array(list(chunk.langs), dtype=object)
    depth = sum((c[at] != _END).astype(np.int64) for c in cols)
    for d in range(1, LONGEST + 1):
        of, n = at[depth == d], counts[depth == d]
        for i in range(0, len(of), rows):
            part = of[i:i + rows]
            keys = list(map(b"\t".join, zip(langs[lang[part]], *(names[c[part]] for c in cols[:d]), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n[i:i + rows], pa.int64())],
                                             names=["key", "n"])


def _runs(least: int) -> Callable:
    """(key, n) of each beginning of the windows of a sorted range that occurs ``least`` times.

    The language alone, and runs that touch an end of the range, are given whatever their count.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous: list[bytes] = []
        opened: list[tuple[int, bool]] = []  # the total before a run, and whether it touches the range's start
        total, seen = 0, False
        keys: list[bytes] = []
        found: list[int] = []

        def close(depth: int, last: bool = False) -> None:
            while len(opened) > depth:
                before, edge = opened.pop()
                if edge or last or not opened or total - before >= least:
                    keys.append(b"\t".join(previous[:len(opened) + 1]))
                    found.append(total - before)

        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields = key.split(b"\t")
                same = 0
                for x, y in zip(fields, previous):  # noqa: B905
                    if x != y:
                        break
                    same += 1
                close(same)
                opened += [(total, not seen)] * (len(fields) - len(opened))
                previous, seen = fields, True
                total += n
            if len(keys) > 10_000:
                yield _counted(keys, found)
                keys.clear()
                found.clear()
        close(0, last=True)
        yield _counted(keys, found)
    return runs


def _counted(keys: list[bytes], found: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.int64())], names=["key", "n"])


def phrase_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, f) of every phrase of 1 to LONGEST words with f >= ``least``, and of no words
    (how many there are) per language; ``texts``: lang, text. Words and languages are escaped."""
    spark = texts.sparkSession
    buckets, table = frequent_pairs(texts, least)
    bits = spark.sparkContext.broadcast(table)  # MOST_BUCKETS bits at most
    stream = materialise(texts.mapInArrow(_windows(buckets, bits), "key binary, n long"), "windows")
    size = stream.agg(F.sum(F.octet_length("key") + F.lit(8))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    found = stream.repartitionByRange(ranges, "key").sortWithinPartitions("key") \
        .mapInArrow(_runs(least), "key binary, n long").groupBy("key").agg(F.sum("n").alias("f"))
    fields = F.split(F.col("key").cast("string"), "\t")
    out = materialise(found.select(fields[0].alias("lang"), F.slice(fields, 2, LONGEST).alias("words"), "f")
                      .where((F.size("words") == 0) | (F.col("f") >= least)), "phrases")
    discard(stream)
    return out


def _lockstep(phrases: DataFrame, side: str) -> DataFrame:
    """Facts (lang, words, f, side, k, count) from one order of words.

    The stream of what phrases begin with, in the order of these beginnings, is merged
    with the stream of phrases. A phrase learns how often its first ``k`` words occur;
    a phrase of two words or more, how often one with a word more does (``k`` is 0).
    """
    n = F.size("words")
    begun = phrases.where(n > 1).select(
        F.col("lang").alias("l2"), F.col("words").alias("w2"), F.col("f").alias("f2"),
        F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice("words", 1, k))).alias("begin"))
    both = begun.join(phrases.hint("merge"), (F.col("l2") == F.col("lang")) & (F.col("begin") == F.col("words")))
    fact = lambda words, f, k, count: F.struct(
        F.col("lang"), F.col(words).alias("words"), F.col(f).alias("f"), k.alias("k"), F.col(count).alias("count"))
    longer = (n > 1) & (F.size("w2") == n + 1)
    facts = F.array(fact("w2", "f2", n, "f"), F.when(longer, fact("words", "f", F.lit(0), "f2")))
    return both.select(F.explode(facts).alias("x")).where(F.col("x").isNotNull()).select(
        "x.lang", "x.words", "x.f", F.lit(side).alias("side"), "x.k", "x.count")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    ``docs``: text, lang (further columns play no part). Texts are lower-cased (A-Z),
    cut into pieces at [.,;:!?] and line ends, pieces into words at spaces and tabs.
    Candidates are phrases of 2 to LONGEST words with a >= ``least`` occurrences
    within pieces of one language; score, the least floor(1000 a n / (l r)) of a
    phrase's cuts into two parts with l and r occurrences (the first cut on ties), n
    being the language's words. A candidate that lies in a longer one as frequent
    as itself is dropped: as counts fall with length, it is enough to look one word
    further. Order: score, a (both descending), phrase (byte order).

    A null language counts as ``und``; null and empty texts and texts without
    words add nothing; repeated rows count each time; ids play no part; an empty
    table gives none. Counts are exact up to 10^15.
    """
    texts = rows_of(docs, ["lang", "text"]).where(F.col("text").isNotNull()).withColumn(
        "lang", F.coalesce("lang", F.lit("und")))
    phrases = phrase_counts(texts, least)
    words = phrases.where(F.size("words") > 0)
    back = lambda df: df.withColumn("words", F.reverse("words"))
    facts = _lockstep(words, "begins").unionByName(back(_lockstep(back(words), "ends")))
    count = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("count")))
    both = facts.groupBy("lang", "words", "f").agg(
        F.coalesce(F.max(F.when(F.col("k") == 0, F.col("count"))), F.lit(0)).alias("longer"),
        F.array(*[count("begins", k) for k in range(1, LONGEST)]).alias("parts"),
        F.array(*[count("ends", k) for k in range(1, LONGEST)]).alias("ends")).where(F.col("longer") < F.col("f"))
    total = phrases.where(F.size("words") == 0).select(F.col("lang").alias("l3"), F.col("f").alias("n"))
    few = total.count() <= FEW_LANGUAGES
    both = both.join(F.broadcast(total) if few else total.hint("merge"), F.col("lang") == F.col("l3"))
    whole = lambda c: c.cast("decimal(15,0)")
    cut = lambda k: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(F.col("f")) * whole(F.col("n")),
                        whole(F.col("parts")[k - 1]) * whole(F.col("ends")[F.size("words") - k - 1])).alias("score"),
        k.alias("k"), F.col("parts")[k - 1].alias("l"), F.col("ends")[F.size("words") - k - 1].alias("r"))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    scored = both.select(_unescaped(F.col("lang")).alias("lang"), _unescaped(F.array_join("words", " ")).alias("phrase"),
                         F.col("f").alias("a"), "n", best.alias("b")).select(
        "lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of some parts of a language, then the best of those
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))) \
        .where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
