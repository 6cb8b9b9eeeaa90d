"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents in blocks of BLOCK ids. A block
stores its least id, then the differences packed at the width that holds
PERCENTILE of them; larger ones stand whole in a list of exceptions. Block and
document starts are indexed at the end, so that any range can be read alone.

File, little-endian: the blocks; their starts (u64 each, and the end); per
document its id (i64; i64 minimum: none) and its number of ids (u64); a footer
of documents, blocks, ids, and the place of the index (u64 each) and MAGIC.
Block: least id (u32), exceptions (u16), width (u8), zero (u8); the packed
differences (16 * width u64, bit by bit from the lowest); the exceptions'
places (u16 each) and differences (u32 each).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder
from .files import make_folder, open_for_reading, open_for_writing
from .tokens import as_ids, encoder

BLOCK = 1024
PERCENTILE = 0.9
END_ID = 2
FLUSH_IDS = 1 << 20  # ids that a writing task holds at a time
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IHBB")
_FOOT = struct.Struct("<QQQQ8s")
_NO_ID = -(1 << 63)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Pack rows of BLOCK values below 2**width into rows of 16 * width words."""
    v = v.reshape(-1, 64).T.astype(np.uint64)
    out = np.zeros((width, v.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK // 64 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((64, w.shape[1]), dtype=np.uint32)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = w[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids``; the last is filled up with its least id."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    rows = np.empty(n * BLOCK, dtype=np.uint32)
    rows[: len(ids)] = ids
    rows[len(ids):] = ids[(n - 1) * BLOCK:].min()
    rows = rows.reshape(n, BLOCK)
    least = rows.min(axis=1)
    diff = rows - least[:, None]
    at = np.partition(diff, int(BLOCK * PERCENTILE) - 1, axis=1)[:, int(BLOCK * PERCENTILE) - 1]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    odd = (diff >> width[:, None].astype(np.uint32)) > 0 if n else diff > 0
    packed: list = [None] * n
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        words = _pack(np.where(odd[which], 0, diff[which]), w) if w else np.zeros((len(which), 0), np.uint64)
        for i, x in zip(which.tolist(), words, strict=True):
            packed[i] = x.tobytes()
    out = []
    for i in range(n):
        places = np.flatnonzero(odd[i])
        out.append(_HEAD.pack(int(least[i]), len(places), int(width[i]), 0) + packed[i]
                   + places.astype("<u2").tobytes() + diff[i, places].astype("<u4").tobytes())
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``starts`` are their places in ``raw`` and the end."""
    n = len(starts) - 1
    heads = [_HEAD.unpack_from(raw, int(s)) for s in starts[:-1]]
    out = np.empty((n, BLOCK), dtype=np.uint32)
    width = np.array([h[2] for h in heads], dtype=np.int64)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        size = BLOCK // 64 * w
        if w:
            words = np.stack([np.frombuffer(raw, "<u8", size, int(starts[i]) + _HEAD.size) for i in which])
            out[which] = _unpack(words, w)
        else:
            out[which] = 0
    for i, (least, n_odd, w, _) in enumerate(heads):
        if n_odd:
            at = int(starts[i]) + _HEAD.size + BLOCK // 64 * w * 8
            places = np.frombuffer(raw, "<u2", n_odd, at)
            out[i, places] = np.frombuffer(raw, "<u4", n_odd, at + 2 * n_odd)
        out[i] += np.uint32(least)
    return out.reshape(-1)


class _Writer:
    def __init__(self, address: str):
        self.file = open_for_writing(address)
        self.starts: list[int] = [0]
        self.documents: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_ids = self.ids = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.documents.append((_NO_ID if doc_id is None else doc_id, len(raw) // 4))
        self.held.append(raw)
        self.held_ids += len(raw) // 4
        if self.held_ids >= FLUSH_IDS:
            self._flush(self.held_ids // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = as_ids(b"".join(self.held))
        blocks = encode_blocks(ids[:n])
        for b in blocks:
            self.starts.append(self.starts[-1] + len(b))
        self.file.write(b"".join(blocks))
        self.ids += n
        self.held = [ids[n:].tobytes()]
        self.held_ids = len(ids) - n

    def close(self) -> None:
        self._flush(self.held_ids)
        self.file.write(np.array(self.starts, "<u8").tobytes())
        self.file.write(np.array([d for d, _ in self.documents], "<i8").tobytes())
        self.file.write(np.array([n for _, n in self.documents], "<u8").tobytes())
        self.file.write(_FOOT.pack(len(self.documents), len(self.starts) - 1, self.ids, self.starts[-1], MAGIC))
        self.file.close()


class TokenFile:
    """Random access to one file by its indexes."""

    def __init__(self, address: str):
        self.file = open_for_reading(address)
        end = self.file.size()
        n_docs, n_blocks, self.n_ids, at, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, end - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{address} is not a token file")
        index = self.file.read_at(end - _FOOT.size - at, at)
        self.starts = np.frombuffer(index, "<u8", n_blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * (n_blocks + 1))
        lengths = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + 1 + n_docs)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths)])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids number ``begin`` to ``end`` (exclusive); reads only their blocks."""
        if end <= begin:
            return np.empty(0, np.uint32)
        low, high = begin // BLOCK, -(-end // BLOCK)
        at = int(self.starts[low])
        raw = self.file.read_at(int(self.starts[high]) - at, at)
        ids = decode_blocks(raw, self.starts[low: high + 1] - at)
        return ids[begin - low * BLOCK: end - low * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's number, ids) of each document, some documents at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + FLUSH_IDS)))
            j = min(j, n)
            ids = self.ids(int(self.first[i]), int(self.first[j]))
            for k in range(i, j):
                a, b = self.first[k] - self.first[i], self.first[k + 1] - self.first[i]
                yield (None if self.doc_ids[k] == _NO_ID else int(self.doc_ids[k])), int(self.first[k]), ids[a:b]
            i = j


def _write(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # a name of this attempt: only the manifest's files count, so a failed attempt's is never read
        address = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        writer = None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            writer = writer or _Writer(address)
            raw = encoder(vocabulary).ids([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), raw, strict=True):
                writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "address": [address],
                "n_documents": pa.array([len(writer.documents)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})
    return write


def write_token_files(documents: DataFrame, folder: str, vocabulary: str | None = None,
                      end_id: int = END_ID) -> DataFrame:
    """Write the ids of documents (doc_id, text) in ascending doc_id order; return the manifest.

    One file per range of ids. The manifest (part, address, n_documents, n_ids,
    start: ids in the files before) is kept beside the files. A document is its
    text's ids, then ``end_id``; null texts count as empty. Rows without a
    doc_id come last; rows that repeat one are ordered by a hash of their
    texts. Further columns play no part; an empty table gives no files.
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark = documents.sparkSession
    make_folder(folder)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(_write(folder, vocabulary, end_id), "part long, address string, n_documents long, n_ids long") \
        .write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files with ``start``, the number of ids in the files before each."""
    files = spark.read.schema("part long, address string, n_documents long, n_ids long") \
        .parquet(f"{folder}/_manifest").orderBy("part").collect()  # one short row per file
    rows, start = [], 0
    for f in files:
        rows.append((*f, start))
        start += f["n_ids"]
    return spark.createDataFrame(rows, "part long, address string, n_documents long, n_ids long, start long") \
        .repartition(max(1, len(rows)), "part")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for address, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()))
                    for doc_id, at, ids in TokenFile(address).documents()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for address, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for doc_id, at, ids in TokenFile(address).documents():
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id], pa.int64()), "start": pa.array([base + at], pa.int64()),
                    "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a folder's files."""
    return manifest(spark, folder).select("address", "start").mapInArrow(
        _arrays, "doc_id long, start long, ids array<long>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), computed from the files' ids where they are read."""
    return manifest(spark, folder).select("address", "start").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write documents as token files in the shared folder and read their digests back."""
    folder = new_folder(documents.sparkSession, "tokens")
    write_token_files(documents, folder, vocabulary)
    return read_digests(documents.sparkSession, folder)
