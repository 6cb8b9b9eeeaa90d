"""WARC archives as a Spark data source, and deduplicated archives of pages.

Reading: a task gets whole files (large) or several small ones. A record's
headers are parsed first; predicates on the columns that stand for headers are
pushed down and decided on them, and the payload of a record that is not wanted
is neither decoded nor kept. Members that say their own length (gzip extra
field ``sl``, which the writer sets) are jumped over without being inflated.

Writing: one compressed member per record. A committed write lists its files in
a manifest, so that files of failed attempts are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import materialise, new_folder
from .files import list_files, locate, make_folder, open_for_reading, open_for_writing, remove

PARTITION_BYTES = 64 << 20
LEAST_SHARED_BYTES = 100
_READ = 1 << 18
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "content_type string, warc_date string, payload_length long, headers map<string,string>, payload binary")
# Column -> header; predicates on these columns are decided on the headers alone.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
           "warc_date": "warc-date"}
_LENGTH = "x-payload-length"  # length of the full payload, also where it is not in the record


# -- reading ------------------------------------------------------------------

class _Plain:
    """Sequential bytes of an uncompressed archive."""

    def __init__(self, address: str):
        self.file = open_for_reading(address)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def more(self) -> bytes:
        raw = self.file.read_at(min(_READ, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(raw)
        return raw

    def head(self) -> bytes | None:
        """The next header block without its blank line, or None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            end = self.held.find(b"\r\n\r\n")
            if end >= 0:
                out, self.held = self.held[:end], self.held[end + 4:]
                return out
            raw = self.more()
            if not raw:
                if self.held:
                    raise ValueError("the archive ends inside a record's headers")
                return None
            self.held += raw

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            raw = self.more()
            if not raw:
                raise ValueError("the archive ends inside a record")
            parts.append(raw)
            have += len(raw)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.at += n - len(self.held)
            self.held = b""


class _Gzip(_Plain):
    """Inflated bytes of an archive of gzip members."""

    def __init__(self, address: str):
        super().__init__(address)
        self.raw, self.inflate, self.next_member = b"", None, None

    def more(self) -> bytes:
        while True:
            if self.inflate is None or self.inflate.eof:
                self.raw = self.inflate.unused_data if self.inflate else self.raw
                if len(self.raw) < 4096:
                    self.raw += super().more()
                if not self.raw.lstrip(b"\0"):
                    return b""
                length = _member_length(self.raw)
                self.next_member = self.at - len(self.raw) + length if length else None
                self.inflate = zlib.decompressobj(31)
            else:
                self.raw = self.inflate.unconsumed_tail or super().more()
                if not self.raw and not self.inflate.eof:
                    raise ValueError("the archive ends inside a gzip member")
            out = self.inflate.decompress(self.raw, _READ // 8)
            self.raw = b""
            if out:
                return out

    def skip(self, n: int) -> None:
        if n > len(self.held) and self.next_member is not None:
            self.at, self.held, self.raw, self.inflate = self.next_member, b"", b"", None
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = self.more()
            if not self.held:
                raise ValueError("the archive ends inside a record")
        self.held = self.held[n:]


def _member_length(raw: bytes) -> int | None:
    """The compressed length that a gzip member states in its extra field ``sl``."""
    if len(raw) < 12 or raw[:2] != b"\x1f\x8b" or not raw[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", raw, 10)[0]
    at = 12
    while at + 4 <= min(end, len(raw)):
        size = struct.unpack_from("<H", raw, at + 2)[0]
        if raw[at: at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", raw, at + 4)[0]
        at += 4 + size
    return None


def _parse(head: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def records(address: str, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers are ``wanted``.

    The payload of an HTTP record is its body; None if payloads are not asked for.
    """
    stream = _Gzip(address) if address.endswith(".gz") else _Plain(address)
    while (head := stream.head()) is not None:
        headers = _parse(head)
        length = int(headers.get("content-length", "0"))
        if not wanted(headers):
            stream.skip(length)
        elif not with_payload:
            yield headers, None
            stream.skip(length)
        else:
            block = stream.take(length)
            if headers.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield headers, block


@dataclass
class _Files(InputPartition):
    addresses: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[name], "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[name], "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[name], "set", None))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[name], "prefix", f.value))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for header, kind, value in self.tests:
            has = headers.get(header)
            if has is None or kind == "in" and has not in value or kind == "prefix" and not has.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        now: list[str] = []
        size = 0
        for address, n in _archive_files(self.path):
            if now and size + n > self.partition_bytes:
                out.append(_Files(tuple(now)))
                now, size = [], 0
            now.append(address)
            size += n
        if now or not out:
            out.append(_Files(tuple(now)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for address in partition.addresses:
            for headers, payload in records(address, self.wanted, self.with_payload):
                length = headers.get(_LENGTH)
                yield (*(headers.get(HEADERS[c]) for c in HEADERS),
                       int(length) if length else None if payload is None else len(payload), headers, payload)


def _archive_files(path: str) -> list[tuple[str, int]]:
    """Archives in a folder: those of its manifests, or all if it has none."""
    store, place = locate(path)
    found = list_files(path, (".warc", ".warc.gz"))
    from pyarrow import fs
    info = store.get_file_info(place)
    if info.type != fs.FileType.Directory:
        return found
    lists = [x for x in store.get_file_info(fs.FileSelector(place)) if x.base_name.startswith("_committed-")]
    if not lists:
        return found
    names = set()
    for x in lists:
        with store.open_input_file(x.path) as f:
            names.update(json.loads(f.read()))
    return [(a, n) for a, n in found if a.rsplit("/", 1)[-1] in names]


# -- writing ------------------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


def _line(name: str, value: object) -> str:
    """One header line; what would end the line is percent-encoded."""
    return "" if value is None else f"{name}: " + str(value).replace("\r", "%0D").replace("\n", "%0A") + "\r\n"


def record(row: dict) -> bytes:
    """One WARC/1.1 record as a gzip member that states its own length."""
    payload = row.get("payload")
    body = b"" if payload is None else payload
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    block = http + (b"" if revisit else body)
    head = "WARC/1.1\r\n" + "".join((
        _line("WARC-Type", row["record_type"]), _line("WARC-Record-ID", row["record_id"]),
        _line("WARC-Date", row["warc_date"]), _line("WARC-Target-URI", row.get("target_uri")),
        _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        _line("WARC-Refers-To", row.get("refers_to")), _line("WARC-Payload-Digest", row.get("payload_digest")),
        _line("X-Payload-Length", row.get("payload_length")), _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", len(block)))) + "\r\n"
    plain = head.encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = deflate.compress(plain) + deflate.flush()
    extra = 12
    size = 12 + extra + len(data) + 8
    header = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, extra, b"sl", 8, size, len(plain) & 0xFFFFFFFF)
    return header + data + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex
        self.file_bytes = int(options.get("fileBytes", 4 * PARTITION_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names: list[str] = []
        file, size = None, 0
        make_folder(self.path)
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None or size >= self.file_bytes:
                    if file:
                        file.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = open_for_writing(f"{self.path}/{names[-1]}"), 0
                raw = record(row)
                file.write(raw)
                size += len(raw)
        if file:
            file.close()
        return _Written(tuple(names))

    def commit(self, messages) -> None:
        make_folder(self.path)
        with open_for_writing(f"{self.path}/_committed-{self.job}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages) -> None:
        for m in messages:
            for n in m.names if m else ():
                remove(f"{self.path}/{n}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options: payload (true), partitionBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages --------------------------------------------------------------------

_PAGE = "<urn:x-page:"


def write_pages(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of pages (page_id, url, html).

    Payload: the html in UTF-8, null as empty. Of equal payloads of at least 100
    bytes the row with the least page_id is a response and the others revisit
    it (rows that repeat the least id are responses too, and so are rows of a
    group without any id). Shorter payloads are all responses. Missing urls
    leave their header out; further columns play no part.
    """
    register(pages.sparkSession)
    # hashed by Spark; the text moves once, to meet its group's first page
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    # a table of its own, so that the join deals both sides and Spark can split a hot payload
    shared = materialise(rows.where(F.col("bytes") >= LEAST_SHARED_BYTES).groupBy(F.col("digest").alias("d")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    met = rows.join(shared, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit(_PAGE), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    met.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"), F.when(revisit, name("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.lit(date).alias("warc_date"),
        F.col("bytes").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a folder's records.

    Responses are measured on their payloads as read; revisits by their headers
    alone, whose payloads are not in the archive.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    kept = spark.read.format("warc").load(folder).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"))
    return kept.union(again)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back; empty in, empty out."""
    folder = new_folder(pages.sparkSession, "warc")
    write_pages(pages, folder)
    return read_pages(pages.sparkSession, folder)
