"""Mix sources to target weights, by blocks.

A source's words, in a fixed order of its documents, are cut into blocks of one
length. Output shards draw multinomial counts of blocks per source; the counts
are reconciled to each source's quota. A source's slots, numbered over the
shards, go through a keyed pseudorandom permutation of its block numbers, epoch
by epoch, and meet the blocks by a join on the number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD, free_name, materialise
from .hashing import U64, mix

BLOCK_WORDS = 256
LEAST_BLOCKS = 64  # that a source and its target are cut into, if they have as many words
SHARD_SLOTS = 4096  # block slots of an output shard
WEIGHTS = (1, 2, 3)  # repeated over the sources by code point, null last
MOST_EPOCHS = 3
CHUNK_SLOTS = 16_384  # slots of one source that are dealt at a time
SEED = 20

_WORD = re.compile(WORD)


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, the number of each source by code point, null last.

    Sorted in ranges, counted per range; only the counts of the ranges come to
    the driver.
    """
    ranged = materialise(sources.orderBy(F.col("source").asc_nulls_last())
                         .withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before += [F.lit(p), F.lit(total)]
        total += n
    base = F.create_map(*before)[part] if before else F.lit(0)
    return ranged.withColumn("place", base + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    All sizes together are shared by weight; a share stops at MOST_EPOCHS times
    its source's size, and the excess is shared again among the others, until
    none is above. Each round is one aggregate over the sources.
    """
    per_source = _numbered(sizes.groupBy("source").agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int"))
    now = materialise(per_source.select("source", "place", "source_size", weight.cast("double").alias("weight")),
                      "weights")
    most = F.col("source_size") * F.lit(float(MOST_EPOCHS))
    first = now.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("open")).first()
    total = first["total"] or 0
    level, stopped = (total / first["open"] if first["open"] else 0.0), 0
    while total:
        full = F.col("weight") * F.lit(level) > most
        r = now.agg(F.count_if(full).alias("n"), F.sum(F.when(full, most).otherwise(0.0)).alias("used"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r["n"] == stopped or not r["open"]:
            break
        level, stopped = (total - r["used"]) / r["open"], r["n"]
    return now.select("source", "place", "source_size",
                      F.least(F.col("weight") * F.lit(float(level)), most).alias("target"))


def permuted(slot: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 per key, at ``slot`` (< n).

    Four Feistel rounds over the least square of a power of two that holds n;
    values outside walk on along their cycle, which leads back inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)
    out = slot.astype(U64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(4):
                f = mix(right ^ key[todo] ^ mix(np.full(1, r + 1, U64))[0]) & mask[todo]
                left, right = right, left ^ f
            out[todo] = (left << half[todo]) | right
            todo = todo[out[todo] >= n[todo].astype(U64)]
    return out.astype(np.int64)


def _slot_rows(shards: int, seed: int):
    """Deal each chunk of a source's slots to output shards and blocks."""
    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, r.place, r.chunk])
                # uniform draws in order: the multinomial counts of this chunk per shard
                shard = np.sort(rng.integers(0, shards, size=r.n))
                slot = np.arange(r.first, r.first + r.n)
                epoch = slot // r.n_blocks
                with np.errstate(over="ignore"):
                    key = mix(epoch.astype(U64) + mix(np.array([r.place], U64) ^ mix(np.array([seed], U64))))
                block = permuted(slot % r.n_blocks, np.full(r.n, r.n_blocks), key)
                yield pd.DataFrame({"shard": shard, "place": r.place, "slot": slot, "epoch": epoch, "block": block})
    return rows


class Mix:
    """Tables of one mix; all are written in the shared folder or cheap to derive.

    ``sources``: source, place, source_size, target, block_words (a block's length: at
    most the parameter, and a 64th of the source or its target), n_blocks, quota (slots).
    ``documents``: doc_id, row (hash of the text), size, the source's columns,
    and begin, the number of the first word in the source.
    ``slots``: shard, place, slot, epoch, block: the block each slot takes.
    """

    def __init__(self, documents: DataFrame, block_words: int = BLOCK_WORDS,
                 shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        sized = materialise(documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")
        length = F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(
            F.least(F.col("source_size"), F.col("target")) / F.lit(LEAST_BLOCKS)))).cast("long")
        n_blocks = F.ceil(F.col("source_size") / F.col("block_words")).cast("long")
        # as many blocks as make the target at the source's mean block length
        quota = F.when(F.col("source_size") == 0, 0).otherwise(F.least(
            F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") * MOST_EPOCHS))
        self.sources = materialise(targets(sized).withColumn("block_words", length).withColumn("n_blocks", n_blocks)
                                   .withColumn("quota", quota.cast("long")), "quotas")
        self.documents = self._placed(sized)
        self.slots = self._slots(shard_slots, seed)

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Give each document the number of its first word in its source.

        A source's documents are dealt into buckets by a hash, so that many
        tasks number one source; with the root of the number of documents as
        the number of buckets, both a bucket and the list of them stay short.
        """
        buckets = max(1, math.ceil(math.sqrt(sized.count())))
        keyed = sized.join(self.sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))) \
            .drop("s").withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "doc_id", "row"), F.lit(buckets)))
        order = W.partitionBy("p").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
        starts = keyed.groupBy(F.col("place").alias("p"), F.col("bucket").alias("b")).agg(F.sum("size").alias("words")) \
            .select("p", "b", (F.sum("words").over(order) - F.col("words")).alias("start"))
        inside = W.partitionBy("place", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "row") \
            .rowsBetween(W.unboundedPreceding, W.currentRow)
        return materialise(
            keyed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
            .join(starts, (F.col("place") == F.col("p")) & (F.col("bucket") == F.col("b")))
            .withColumn("begin", F.col("start") + F.col("inside")).drop("p", "b", "start", "inside", "bucket"), "placed")

    def _slots(self, shard_slots: int, seed: int) -> DataFrame:
        total = self.sources.agg(F.sum("quota")).first()[0] or 0
        shards = max(1, -(-total // shard_slots))
        chunks = self.sources.where("quota > 0").select("place", "quota", "n_blocks", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.lit(CHUNK_SLOTS)))).alias("chunk"))
        chunks = chunks.select(
            "place", "chunk", "n_blocks", (F.col("chunk") * CHUNK_SLOTS).alias("first"),
            F.least(F.lit(CHUNK_SLOTS).cast("long"), F.col("quota") - F.col("chunk") * CHUNK_SLOTS).alias("n"))
        return materialise(chunks.repartition("place", "chunk").mapInPandas(
            _slot_rows(shards, seed), "shard long, place long, slot long, epoch long, block long"), "slots")

    def _parts(self) -> DataFrame:
        """The part of each document in each block of its source: from_word, words."""
        b = F.col("block_words")
        parts = self.documents.where("size > 0").withColumn("in_block", F.explode(F.sequence(
            F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))))
        low = F.greatest(F.col("begin"), F.col("in_block") * b)
        high = F.least(F.col("begin") + F.col("size"), (F.col("in_block") + 1) * b)
        return parts.withColumn("from_word", low - F.col("begin")).withColumn("words", high - low)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, first_shard): the words the mix takes of each
        document, and the least output shard that they go to (null: none)."""
        drawn = self.slots.groupBy(F.col("place").alias("p"), F.col("block").alias("b")).agg(
            F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
        parts = self._parts().join(drawn, (F.col("place") == F.col("p")) & (F.col("in_block") == F.col("b")), "left")
        some = parts.groupBy("doc_id", "row", "place", "begin", "size", "source_size", "target").agg(
            F.sum(F.coalesce(F.col("times") * F.col("words"), F.lit(0))).cast("long").alias("taken"),
            F.min("shard").alias("first_shard"))
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")) \
            .withColumn("first_shard", F.lit(None).cast("long"))
        columns = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
        return some.select(*columns).union(none.select(*columns))

    def shards(self) -> DataFrame:
        """(shard, source, slot, doc_id, row, from_word, words): what each output shard holds.

        A shard is its slots in order, each the words of a block, which may be of several documents.
        """
        slots = self.slots.select("shard", F.col("place").alias("p"), "slot", F.col("block").alias("b"))
        return self._parts().join(slots, (F.col("place") == F.col("p")) & (F.col("in_block") == F.col("b"))) \
            .select("shard", "source", "slot", "doc_id", "row", "from_word", "words")

    def pieces(self) -> DataFrame:
        """(doc_id, row, source, ranges): the word ranges taken, as (epoch, from_word, words)."""
        drawn = self.slots.select(F.col("place").alias("p"), F.col("block").alias("b"), "epoch")
        parts = self._parts().join(drawn, (F.col("place") == F.col("p")) & (F.col("in_block") == F.col("b")))
        # rows that repeat a document have the same text, so their ranges may stand together
        return parts.groupBy("doc_id", "row", "source").agg(F.sort_array(F.collect_list(
            F.struct("begin", "epoch", "from_word", "words"))).alias("ranges"))


def mix_sources(documents: DataFrame, **parameters: int) -> Mix:
    """Mix documents (doc_id, text, source) to target weights; see ``Mix``.

    A document's size is its number of words. Sources by code point, null last,
    weigh 1, 2, 3, repeating; targets are shares of all words, none above three
    times its source's size. Each source takes whole passes over its blocks and
    a part of one more, so that no block, and no document, is taken more than
    three times. Null and empty texts have size 0 and nothing is taken; a table
    without words takes nothing; an empty table gives empty tables. Rows that
    repeat are documents of their own. Further columns play no part. The same
    rows give the same mix on every run.
    """
    return Mix(documents, **parameters)


def _cut(schema: pa.Schema, ranges_name: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (text, ranges) in enumerate(zip(batch.column("text").to_pylist(),
                                                   batch.column(ranges_name).to_pylist(), strict=True)):
                words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                for low, high in _merged(ranges):
                    whole = low == 0 and high == len(words)
                    rows.append(i)
                    texts.append(text if whole else text[words[low][0]: words[high - 1][1]])
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = []
            for name in schema.names:
                if name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif name == "n_chars":
                    columns.append(pa.array([len(t) for t in texts], pa.int64()).cast(schema.field(name).type))
                else:
                    columns.append(taken.column(name).cast(schema.field(name).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return cut


def _merged(ranges: list[dict]) -> Iterator[tuple[int, int]]:
    """Word ranges of one pass over one row that touch, as one (low, high) each."""
    now: tuple | None = None
    for r in ranges:
        key, low, high = (r["begin"], r["epoch"]), r["from_word"], r["from_word"] + r["words"]
        if now and now[0] == key and now[2] == low:
            now = (key, now[1], high)
        else:
            if now:
                yield now[1], now[2]
            now = (key, low, high)
    if now:
        yield now[1], now[2]


def mixed_documents(documents: DataFrame, **parameters: int) -> DataFrame:
    """The mix as documents, with the columns of the input.

    One row for each stretch of words that one pass takes of a document: the
    whole text where the pass takes all its blocks, else the text from the
    first to the last word of the stretch (``n_chars``, if there is such a
    column, follows). What the mix does not take is left out.
    """
    ranges, row, source, p_id, p_row, p_source = (
        free_name(documents, n) for n in ("_ranges", "_row", "_source", "_id", "_r", "_s"))
    pieces = Mix(documents, **parameters).pieces().select(
        F.col("doc_id").alias(p_id), F.col("row").alias(p_row), F.col("source").alias(p_source),
        F.col("ranges").alias(ranges))
    # the ranges of rows that repeat a document are together, so one of them carries the text
    texts = documents.withColumn(row, F.xxhash64("text")).withColumn(source, F.col("source").cast("string")) \
        .dropDuplicates(["doc_id", row, source])
    both = texts.join(pieces, F.col("doc_id").eqNullSafe(F.col(p_id)) & (F.col(row) == F.col(p_row))
                      & F.col(source).eqNullSafe(F.col(p_source)))
    schema = to_arrow_schema(documents.schema)
    both = both.select(*[F.col(f"`{c}`") for c in documents.columns], ranges)
    return both.mapInArrow(_cut(schema, ranges), documents.schema)
