"""Near-duplicate groups of documents by SuperMinHash signatures.

Method: every distinct shingle draws a pseudorandom permutation of the signature
slots together with a rank per step; a slot keeps the smallest (step, rank) it
was drawn with, and a document stops as soon as all its slots are filled. Bands
of slots give buckets. Links are confirmed on the full shingle sets and grouped
by union of links.

How buckets are searched without pairing everything in them: exact copies fold
into one representative first. In each bucket the documents are compared with
one hub; what joins a hub's component needs no further comparison inside it.
Only documents of one bucket that are still in different components are then
compared with each other, block by block. The documents of large buckets of
mostly unlike texts meet by their rarest shingles instead, which similar texts
cannot but share. No similar pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, materialise, rows_of, small_batches
from .components import components
from .hashing import U64, Words, mix, shingle_sets, shingles, slices, stream

SHINGLE_WORDS = 5
SIMILARITY = 75  # per cent
SLOTS = 128
BAND_SLOTS = 4  # 32 bands: a pair at 0.75 shares none with probability 5e-6
# How what is left in a bucket is compared (see ``_compared``).
SMALL_BUCKET = 8
BLOCK_ROWS = 128
CUT_STRAYS = 512

_STEP_BITS = U64(56)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_DRAW = stream(3, SLOTS)
_BAND = stream(4, SLOTS)


def signatures(values: np.ndarray, docs: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` unsigned 64-bit values per document.

    ``values`` are the shingle hashes, ``docs`` their documents' numbers. A slot
    holds step * 2**56 + rank of the least (step, rank) with which one of the
    document's shingles drew it. Documents without shingles keep empty slots.
    """
    out = np.full(n_docs * slots, _EMPTY, dtype=U64)
    h, doc = values, docs
    order: np.ndarray | None = None  # each active shingle's permutation so far
    drawn: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for step in range(slots):
            if not len(h):
                break
            draw = mix(h ^ _DRAW[step])
            pick = step + (draw % U64(slots - step)).astype(np.int64)
            rank = (draw >> U64(8)) | (U64(step) << _STEP_BITS)
            if step == 0:
                slot = pick
            elif step == 1:
                slot = np.where(pick == drawn[0], 0, pick)
            else:
                rows = np.arange(len(h))
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
                    for i, p in enumerate(drawn):
                        order[rows, i], order[rows, p] = order[rows, p], order[rows, i].copy()
                slot = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, step]
                order[:, step] = slot
            np.minimum.at(out, doc * slots + slot, rank)
            # early stop: later steps cannot beat a filled slot
            open_docs = (out.reshape(n_docs, slots) == _EMPTY).any(axis=1)
            active = open_docs[doc]
            if step < 2:
                drawn = [d[active] for d in (*drawn, pick)]
            if order is not None:
                order = order[active]
            h, doc = h[active], doc[active]
    return out.reshape(n_docs, slots)


def band_keys(signature: np.ndarray, band_slots: int = BAND_SLOTS) -> np.ndarray:
    """One 64-bit key per band of each signature row."""
    n, slots = signature.shape
    with np.errstate(over="ignore"):
        mixed = mix(signature * _BAND[:slots] + _BAND[::-1][:slots])
        return mix(mixed.reshape(n, slots // band_slots, band_slots).sum(axis=2, dtype=U64))


_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_1", T.LongType()), T.StructField("set_2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        ids = batch.column(0)
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for part in slices(texts):
            some = texts[part]
            words = Words(some)
            values, docs = shingles(words, words.hashes(fold=True), SHINGLE_WORDS)
            cuts = np.searchsorted(docs, np.arange(len(some) + 1))
            sets = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            counts = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            flat = np.concatenate(sets) if sets else values
            docs = np.repeat(np.arange(len(some)), counts)
            with np.errstate(over="ignore"):
                edges = np.concatenate([[0], np.cumsum(counts)])
                sums = []
                for seed in (5, 6):
                    run = np.concatenate([np.zeros(1, U64), np.cumsum(mix(flat ^ stream(seed, 1)[0]))])
                    sums.append((run[edges[1:]] - run[edges[:-1]]).view(np.int64))
            keys = band_keys(signatures(flat, docs, len(some))).view(np.int64)
            full = counts > 0
            ends = np.concatenate([[0], np.cumsum(np.where(full, keys.shape[1], 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel()),
                                             mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.start, len(some)).cast(pa.int64()), pa.array(counts),
                 *map(pa.array, sums), bands], names=_FEATURES.names)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (row, doc_id, n, shingle) per distinct shingle of a text with n of them."""
    for batch in small_batches(batches):
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        for part in slices(texts):
            sets = shingle_sets(texts[part], SHINGLE_WORDS)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            row, doc = (batch.column(i).slice(part.start, len(sets)).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(row, sizes)), pa.array(np.repeat(doc, sizes)), pa.array(np.repeat(sizes, sizes)),
                 pa.array(np.concatenate(sets).view(np.int64))], names=["row", "doc_id", "n", "shingle"])


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(doc_id, key): the rarest shingles of each text (doc_id, text) that other texts hold too.

    Shingles are ordered by the number of texts that hold them. Similar texts
    share at least SIMILARITY per cent of the larger set, so the first
    n - ceil(SIMILARITY * n / 100) + 1 of n shingles of one hold one of the other's.
    A shingle of one text only takes its place in that order but gives no row.
    """
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text") \
        .mapInArrow(_shingle_rows, "row long, doc_id long, n long, shingle long")
    rows = materialise(rows, "shingles")
    held = rows.groupBy(F.col("shingle").alias("s")).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    met = rows.join(held, F.col("shingle") == F.col("s")).select("row", "doc_id", "n", "shingle", "texts")
    own = W.partitionBy("row")
    first = F.col("n") - F.floor((SIMILARITY * F.col("n") + 99) / 100) + 1
    rank = F.row_number().over(own.orderBy("texts", "shingle")) + F.col("n") - F.count(F.lit(1)).over(own)
    found = materialise(met.withColumn("rank", rank).where(F.col("rank") <= first)
                        .select("doc_id", F.col("shingle").alias("key")).distinct(), "rare")
    discard(rows)
    return found


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        left = [(t or "").encode() for t in batch.column(2).to_pylist()]
        right = [(t or "").encode() for t in batch.column(3).to_pylist()]
        keep = np.zeros(len(left), dtype=bool)
        for part in slices(left):
            known: dict[bytes, np.ndarray] = {}
            texts = list({*left[part], *right[part]})
            for some in slices(texts):
                known.update(zip(texts[some], shingle_sets(texts[some], SHINGLE_WORDS), strict=True))
            for i in range(part.start, part.start + len(left[part])):
                a, b = known[left[i]], known[right[i]]
                if len(a) > len(b):
                    a, b = b, a
                if not len(a) or 100 * len(a) < SIMILARITY * len(b):
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= SIMILARITY * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as a table."""
    pairs = materialise(pairs, "pairs")
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    out = materialise(both.mapInArrow(_confirm, "a long, b long"), "links")
    discard(pairs)
    return out


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links)


def _with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "key", F.coalesce("component", "doc_id").alias("component"))


def _compared(texts: DataFrame, now: DataFrame, cut: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Links between components that meet in a bucket, and the buckets left to cut.

    ``now``: (key, doc_id, component), each once. Buckets of one component are done. In a
    bucket of at most SMALL_BUCKET documents each pair across components is
    compared (buckets of the same documents once). Larger buckets are taken
    together if their largest component is the same: the documents outside it
    (strays) meet all documents, block by block (``_strays``). If ``cut``, a
    bucket that is mostly strays, and more than CUT_STRAYS, is left to be cut.
    """
    parts = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(F.col("key").alias("k")).agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"),
        F.count(F.lit(1)).alias("parts")).where("parts > 1").select(
        "k", "size", F.col("top.component").alias("largest"), (F.col("size") - F.col("top.n")).alias("strays"))
    left = materialise(now.join(mixed, F.col("key") == F.col("k")).drop("k"), "mixed")
    small = left.where(F.col("size") <= SMALL_BUCKET)
    # buckets of the same documents (bands of one pair) fold into the first
    once = small.groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("members")) \
        .groupBy("members").agg(F.min("key").alias("k"))
    small = small.join(once, F.col("key") == F.col("k"), "left_semi")
    other = small.select(F.col("key").alias("k"), F.col("doc_id").alias("b"), F.col("component").alias("c_b"))
    pairs = small.join(other, (F.col("key") == F.col("k")) & (F.col("doc_id") > F.col("b"))
                       & (F.col("component") != F.col("c_b"))).select(F.col("doc_id").alias("a"), "b").distinct()
    many = (F.col("strays") > CUT_STRAYS) & (2 * F.col("strays") > F.col("size")) if cut else F.lit(False)
    large = left.where((F.col("size") > SMALL_BUCKET) & ~many)
    links = [_confirmed(texts, pairs), _strays(texts, large.select("largest", "doc_id", "component").distinct())]
    return links, left.where((F.col("size") > SMALL_BUCKET) & many).select("key", "doc_id") if cut else None


def _strays(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between strays and documents of other components.

    ``rows``: (largest, doc_id, component). Documents are dealt into blocks, and
    strays once more as strays; each block of strays meets each block of
    documents, so that a task holds two blocks at a time.
    """
    rows = materialise(rows, "large")
    stray = F.col("component") != F.col("largest")
    sizes = rows.groupBy(F.col("largest").alias("g")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("long").alias("blocks"),
        F.ceil(F.count_if(stray) / F.lit(BLOCK_ROWS)).cast("long").alias("stray_blocks")).where("stray_blocks > 0")
    met = rows.join(sizes, F.col("largest") == F.col("g"))
    at = F.xxhash64("doc_id")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    base = [F.col("g"), F.col("doc_id"), F.col("component")]
    members = met.select(*base, F.lit(False).alias("stray"), F.pmod(at, "blocks").alias("block"),
                         F.explode(each("stray_blocks")).alias("stray_block"))
    strays = met.where(stray).select(*base, F.lit(True).alias("stray"), F.explode(each("blocks")).alias("block"),
                                     F.pmod(at, "stray_blocks").alias("stray_block"))
    dealt = members.union(strays.select(*members.columns))
    whole = dealt.join(texts.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).drop("d")
    return materialise(whole.groupBy("g", "block", "stray_block").applyInPandas(_compare_strays, "a long, b long"), "links")


def _compare_strays(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["stray", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    texts = [(t or "").encode() for t in pdf["text"]]
    sets: list[np.ndarray] = []
    for part in slices(texts):
        sets += shingle_sets(texts[part], SHINGLE_WORDS)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets) if sets else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    component = pdf["component"].to_numpy(np.int64).copy()
    ids = pdf["doc_id"].to_numpy(np.int64)
    found: list[tuple[int, int]] = []
    for i in range(int(pdf["stray"].sum())):
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        times = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        alike = np.flatnonzero(100 * both >= SIMILARITY * (sizes[i] + sizes - both))
        for j in alike[component[alike] != component[i]].tolist():
            if component[j] != component[i] and ids[i] != ids[j]:
                found.append((int(ids[i]), int(ids[j])))
                component[component == component[j]] = component[i]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text).

    ``n_shingles``: size of the set of five-word shingles of the lower-cased
    (A-Z) text. Documents are linked if 100 * intersection >= 75 * union;
    ``component_id`` is the smallest doc_id that links reach; ``kept`` marks it.

    Null, empty and blank texts have no shingles and no links; texts of one to
    four words count as one shingle. Rows that repeat a doc_id share one node
    (and so ``kept``). Rows without a doc_id have no component and are kept.
    Further columns play no part. An empty table gives an empty table.
    """
    docs = rows_of(documents, ["doc_id", "text"])
    features = materialise(docs.mapInArrow(_features, _FEATURES), "features")
    usable = features.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("set_1", "set_2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    shared = classes.where("rep < last").select(
        F.col("set_1").alias("s_1"), F.col("set_2").alias("s_2"), F.col("n_shingles").alias("n"), "rep")
    copies = materialise(
        usable.join(shared, (F.col("set_1") == F.col("s_1")) & (F.col("set_2") == F.col("s_2"))
                    & (F.col("n_shingles") == F.col("n"))).where("doc_id <> rep")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")

    bands = usable.join(classes.select(F.col("rep").alias("r")), F.col("doc_id") == F.col("r"), "left_semi") \
        .select("doc_id", "bands")
    # rows that repeat a doc_id are one member of a bucket
    rows = bands.select("doc_id", F.explode("bands").alias("key")).distinct()
    buckets = rows.groupBy(F.col("key").alias("k")).agg(
        F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    rows = materialise(rows.join(buckets, F.col("key") == F.col("k")).select("doc_id", "key", "hub"), "buckets")
    meeting = rows.select(F.col("doc_id").alias("d")).distinct()
    texts = materialise(docs.join(meeting, F.col("doc_id") == F.col("d"), "left_semi"), "texts")

    # a doc_id on rows with different texts ties their groups together
    again = copies.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("a").alias("x")).union(
        copies.select(F.col("a").alias("x")).join(classes.select(F.col("rep").alias("x")), "x", "left_semi"))
    links = [copies.join(again, F.col("a") == F.col("x"), "left_semi")]
    # one comparison per document first: with the least of its buckets' hubs
    links.append(_confirmed(texts, rows.where("hub < doc_id").groupBy("doc_id").agg(F.min("hub").alias("b"))
                            .select(F.col("doc_id").alias("a"), "b")))
    groups = components(_all(links))
    rows = rows.drop("hub")
    for cut in (True, False):
        found, large = _compared(texts, materialise(_with_component(rows, groups), "buckets"), cut)
        new = materialise(_all(found), "links")
        if not new.isEmpty():
            links.append(new)
            groups = components(_all(links))
        if not cut or large.isEmpty():
            break
        # similar texts meet again in a rare shingle; texts that share only a passage part
        rows = rare_shingles(texts.join(large.select(F.col("doc_id").alias("d")).distinct(),
                                        F.col("doc_id") == F.col("d"), "left_semi"))

    # a copy hangs on its representative, whose component is final
    copied = copies.join(groups, F.col("b") == F.col("node"), "left").select(
        F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    groups = groups.union(copied).groupBy("node").agg(F.min("component").alias("component"))
    found = features.select("doc_id", "n_shingles").join(groups, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each_group(documents: DataFrame) -> DataFrame:
    """Documents without those that ``near_duplicates`` does not keep; same columns.

    Rows that repeat the doc_id and the text of a kept row go too (which of them
    stays is not defined). Rows without a doc_id all stay.
    """
    name = free_name(documents, "gone")
    gone = near_duplicates(documents).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    kept = documents.join(gone, documents["doc_id"] == gone[name], "left_anti")
    again = materialise(rows_of(documents, ["doc_id"]).where("doc_id is not null")
                        .groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name), "again")
    if again.isEmpty():
        return kept
    same = kept["doc_id"] == again[name]
    return kept.join(again, same, "left_anti").union(
        kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
