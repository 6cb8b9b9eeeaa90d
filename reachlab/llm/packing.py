"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised where they lie; only (document, piece, length) rows
move. They are dealt into shards, and each shard's packing is searched by a few
islands: populations of packings whose genes are whole sequences. Crossover
injects well-filled sequences of one parent into the other, drops the sequences
that hold a document twice, and best-fits the displaced documents. After each
epoch every island gets the elite of its neighbour. The sequences of the best
packing that are not well filled are pooled over fewer shards and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .tokens import encoder

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
SHARD_PIECES = 8192
ISLANDS = 2
EPOCHS = 2  # migrations between them: one less
POPULATION = 4
GENERATIONS = 64  # per epoch, in shards of every size; fewer once no packing can be better
WELL_FILLED = 0.98
SEED = 1

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def _pieces(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, raw in zip(doc_ids, ids_of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at: at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                names=_PIECES.names)
    return pieces


class _Bins:
    """Bins by the room left in them; best fit in constant time per document."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r

    def add(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.rooms |= 1 << room

    def best_fit(self, size: int) -> tuple[int, int] | None:
        fitting = self.rooms >> size
        if not fitting:
            return None
        room = (fitting & -fitting).bit_length() - 1 + size
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        return found, room


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, n_bins: int, capacity: int) -> int:
    """Put the documents ``order`` into ``bins`` in place, each where it leaves least room.

    ``bins`` has each document's bin, or -1; returns the number of bins.
    """
    free = _Bins(capacity)
    placed = bins >= 0
    if placed.any():
        fill = np.bincount(bins[placed], weights=sizes[placed], minlength=n_bins).astype(np.int64)
        for b in np.flatnonzero(fill < capacity):
            free.add(int(b), capacity - int(fill[b]))
    for i in order.tolist():
        size = int(sizes[i])
        found = free.best_fit(size)
        if found is None:
            found = (n_bins, capacity)
            n_bins += 1
        bins[i] = found[0]
        if found[1] > size:
            free.add(found[0], found[1] - size)
    return n_bins


def _by_size(sizes: np.ndarray, which: np.ndarray, rng: np.random.Generator, noise: float = 0.0) -> np.ndarray:
    """Descending sizes; with ``noise``, each compared after a random change of that share."""
    weight = sizes[which] * (1 + noise * rng.standard_normal(len(which)))
    return which[np.argsort(-weight, kind="stable")]


def _fill(sizes: np.ndarray, bins: np.ndarray, n_bins: int) -> np.ndarray:
    return np.bincount(bins, weights=sizes, minlength=n_bins)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven ones (a nearly empty bin is easier to empty)."""
    n = int(bins.max()) + 1 if len(bins) else 0
    return -n, float(((_fill(sizes, bins, n) / capacity) ** 2).sum())


def crossover(sizes: np.ndarray, one: np.ndarray, two: np.ndarray, capacity: int,
              rng: np.random.Generator) -> np.ndarray:
    """Inject whole well-filled bins of ``one`` into ``two``.

    Bins of ``two`` that hold an injected document go; their other documents
    are displaced and best-fitted, the largest first.
    """
    n_one, n_two = int(one.max()) + 1, int(two.max()) + 1
    fill = _fill(sizes, one, n_one) / capacity
    chosen = (fill >= min(WELL_FILLED, np.quantile(fill, 0.5))) & (rng.random(n_one) < rng.uniform(0.2, 0.8))
    injected = chosen[one]
    touched = np.bincount(two[injected], minlength=n_two) > 0
    # bins that are not well filled give their documents up as well
    touched |= _fill(sizes, two, n_two) / capacity < WELL_FILLED
    child = np.full(len(sizes), -1, dtype=np.int64)
    child[injected] = (np.cumsum(chosen) - 1)[one[injected]]
    n_bins = int(chosen.sum())
    stays = ~injected & ~touched[two]
    child[stays] = n_bins + (np.cumsum(~touched) - 1)[two[stays]]
    n_bins += int((~touched).sum())
    displaced = np.flatnonzero(child < 0)
    best_fit(sizes, _by_size(sizes, displaced, rng, 0.02), child, n_bins, capacity)
    return _packed(child)


def _packed(bins: np.ndarray) -> np.ndarray:
    """Number the bins that are in use from 0."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def evolve(sizes: np.ndarray, capacity: int, rng: np.random.Generator, elite: np.ndarray | None = None,
           own: np.ndarray | None = None) -> np.ndarray:
    """One epoch of an island; starts from its own best and a neighbour's elite, if there are."""
    everything = np.arange(len(sizes))
    population = [x for x in (own, elite) if x is not None]
    while len(population) < POPULATION:
        bins = np.full(len(sizes), -1, dtype=np.int64)
        best_fit(sizes, _by_size(sizes, everything, rng, 0.02 if population else 0.0), bins, 0, capacity)
        population.append(bins)
    least = -(-int(sizes.sum()) // capacity)
    score = [fitness(sizes, x, capacity) for x in population]
    for _ in range(GENERATIONS):
        if -max(score)[0] <= least:
            break  # no packing has fewer
        ranked = sorted(range(len(population)), key=lambda i: score[i], reverse=True)
        one, two = population[ranked[0]], population[ranked[1 + int(rng.integers(0, len(ranked) - 1))]]
        if rng.random() < 0.5:
            one, two = two, one
        child = crossover(sizes, one, two, capacity, rng)
        population[ranked[-1]], score[ranked[-1]] = child, fitness(sizes, child, capacity)
    return population[max(range(len(population)), key=lambda i: score[i])]


def _epoch(capacity: int, seed: int, epoch: int):
    """An island's epoch over one shard: rows in, the island's best bins out."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(k) for k in key)
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, epoch, shard, island])
        first = epoch == 0
        bins = evolve(sizes, capacity, rng, None if first else pdf["elite"].to_numpy(np.int64),
                      None if first else pdf["bin"].to_numpy(np.int64))
        return pd.DataFrame({"shard": shard, "island": island, "uid": pdf["uid"], "length": sizes, "bin": bins})
    return run


_ISLAND_ROWS = "shard long, island long, uid long, length long, bin long"


def _search(pieces: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(shard, uid, length, bin) of the best packing of each shard."""
    keys = ["shard", "island"]
    rows = pieces.select("shard", "uid", "length", F.explode(
        F.array(*[F.lit(i).cast("long") for i in range(ISLANDS)])).alias("island"))
    now = materialise(rows.groupBy(*keys).applyInPandas(_epoch(capacity, seed, 0), _ISLAND_ROWS), "islands")
    for epoch in range(1, EPOCHS):
        # migration: island i receives the elite of island i - 1
        elite = now.select(F.col("shard").alias("s"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("i"),
                           F.col("uid").alias("u"), F.col("bin").alias("elite"))
        met = now.join(elite, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i"))
                       & (F.col("uid") == F.col("u"))).drop("s", "i", "u")
        now = materialise(met.groupBy(*keys).applyInPandas(_epoch(capacity, seed, epoch), _ISLAND_ROWS), "islands")
    filled = now.groupBy(*keys, "bin").agg((F.sum("length") / F.lit(capacity)).alias("fill"))
    score = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum(F.col("fill") * F.col("fill")), 6).alias("sum"))
    best = score.groupBy(F.col("shard").alias("s")).agg(F.min(F.struct("n", -F.col("sum"), "island"))["island"].alias("i"))
    return now.join(best, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i"))).select(
        "shard", "uid", "length", "bin")


def _dealt(pieces: DataFrame, shards: int) -> DataFrame:
    return pieces.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, seed: int = SEED) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, length), each at most ``capacity`` long.

    Whole-length pieces are sequences of their own. The others are packed in
    shards of about SHARD_PIECES; sequences that are filled to less than
    WELL_FILLED there are pooled, a shard of them at a time, and packed again.
    """
    full = pieces.where(F.col("length") == capacity)
    open_ = materialise(pieces.where(F.col("length") < capacity), "open")
    done = full.select("uid", "length", F.col("uid").alias("sequence_id"))  # uids are below 2**56
    for level in (1, 2, 3):
        n = open_.count()
        shards = max(1, -(-n // SHARD_PIECES))
        found = materialise(_search(_dealt(open_, shards), capacity, seed + level), "packed")
        named = found.select("uid", "length", "shard", "bin",
                             (F.lit(level << 56).cast("long") + F.shiftleft("shard", 24) + F.col("bin")).alias("sequence_id"))
        if level == 3 or shards == 1:
            done = done.union(named.select("uid", "length", "sequence_id"))
            break
        fill = found.groupBy(F.col("shard").alias("s"), F.col("bin").alias("b")).agg(F.sum("length").alias("fill"))
        met = materialise(named.join(fill, (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("b"))), "met")
        well = F.col("fill") >= F.lit(WELL_FILLED * capacity)
        done = done.union(met.where(well).select("uid", "length", "sequence_id"))
        open_ = met.where(~well).select("uid", "length")
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid") \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    return done.select("uid", "sequence_id", (F.sum("length").over(before) - F.col("length")).alias("offset"))


def pack(documents: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its text's ids by the vocabulary file, then id 0; null texts
    count as empty (one token). Only documents longer than a sequence are cut,
    into whole-length pieces and a last one. Per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset; pieces fill a sequence from offset 0
    without gaps. Rows that repeat (and rows without a doc_id) are documents of
    their own. Further columns play no part; an empty table gives no pieces.
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(docs.mapInArrow(_pieces(vocabulary, capacity), _PIECES)
                         .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(pieces.select("uid", "length"), capacity)
    return pieces.join(placed.withColumnRenamed("uid", "u"), F.col("uid") == F.col("u")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
