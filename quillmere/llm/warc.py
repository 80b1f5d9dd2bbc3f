"""WARC as a PySpark data source, and archives of pages with revisit records for equal payloads.

Writer: every task writes files of gzip members, one a record, each with the 'sl' extra field (compressed and plain
size); a commit lists the files of the tasks that counted in a manifest, so that leftovers of failed attempts are never
read. Reader: one input partition a file of the manifest (files are closed at FILE_BYTES); pushed predicates on
record_type, record_id, target_uri, refers_to and payload_digest are tested on the headers, for which only the first
bytes of a member are inflated; members that fail are skipped by their 'sl' size and their payloads never decoded.

Defined results: a null payload is an empty one; a null URL leaves the header out; repeated rows of one page are written
each, with the same type; a row without page_id is a response of its own and comes back with a null page_id; an empty table
gives an archive without records and an empty result; extra columns are ignored. Payloads of any length are kept whole. The
reader takes archives of other writers too: plain `.warc` files, header names in any case, folded header lines.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path

FILE_BYTES = 64 << 20
#: Plain bytes inflated first; the headers of most records end within them.
HEAD_BYTES = 2048
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 20
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, http_headers string, payload binary"
WRITE_COLUMNS = ["record_id", "record_type", "target_uri", "refers_to", "payload_sha1", "payload_bytes", "payload"]
PUSHED = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
#: Names and forms set by the WARC 1.1 and RFC 1952 formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC, GZIP_EXTRA = b"\x1f\x8b\x08", 4
NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with the 'sl' extra field: its own size and the record's."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    extra = b"sl" + struct.pack("<H", 16)
    size = 10 + 2 + len(extra) + 16 + len(body) + 8
    extra += struct.pack("<QQ", size, len(record))
    head = GZIP_MAGIC + bytes([GZIP_EXTRA]) + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<LL", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict, date: str) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP headers and leaves the payload out."""
    payload, n = row["payload"] or b"", row["payload_bytes"] or 0
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["target_uri"]))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_sha1'])).decode()}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class WarcFile(InputPartition):
    uri: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = open_fs(self.path)
        system.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                data = member(record_bytes(row, self.date))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_fs(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_fs(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{base}/{f}")


def parse_headers(head: bytes) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class Members:
    """Records of a stream, headers first; each is a gzip member or stands plain."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.buffer = stream, b""

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.stream.read(max(READ_BYTES, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.stream.seek(self.stream.tell() + n - len(self.buffer))
            self.buffer = b""

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of the records whose headers are wanted."""
        while self.fill(12):
            if self.buffer[:5] == b"WARC/":
                while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                    if not self.fill(len(self.buffer) + 1):
                        raise ValueError("a record ends within its headers")
                headers = parse_headers(self.buffer[:end])
                n = int(headers["content-length"])
                self.skip(end + 4)
                if wanted(headers):
                    if not self.fill(n):
                        raise ValueError("a record ends within its block")
                    yield headers, self.buffer[:n]
                self.skip(n + 4)
                continue
            if self.buffer[:3] != GZIP_MAGIC:
                raise ValueError("neither a gzip member nor a record at this place")
            size, start = None, 10
            if self.buffer[3] & GZIP_EXTRA:
                n = struct.unpack_from("<H", self.buffer, 10)[0]
                self.fill(12 + n)
                extra, start = self.buffer[12 : 12 + n], 12 + n
                while len(extra) >= 4:
                    k = struct.unpack_from("<H", extra, 2)[0]
                    if extra[:2] == b"sl" and k >= 16:
                        size = struct.unpack_from("<Q", extra, 4)[0]
                    extra = extra[4 + k :]
            # without 'sl' the raw flags before the body are left to zlib
            z = zlib.decompressobj(-15 if size else 31)
            at = start if size else 0
            if size:
                self.fill(min(size, at + HEAD_BYTES))
            plain = z.decompress(self.buffer[at : at + HEAD_BYTES], HEAD_BYTES)
            tail, at = z.unconsumed_tail, at + len(self.buffer[at : at + HEAD_BYTES])
            while b"\r\n\r\n" not in plain and not z.eof:
                if not tail:
                    if not self.fill(at + 1):
                        raise ValueError("a record ends within its headers")
                    tail, at = self.buffer[at:], len(self.buffer)
                plain += z.decompress(tail, HEAD_BYTES)
                tail = z.unconsumed_tail
            head, _, block = plain.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            take = wanted(headers)
            if size and not take:
                self.skip(size)
                continue
            parts = [block]
            while not z.eof:
                if not tail:
                    if not self.fill(at + 1):
                        raise ValueError("a record ends within its block")
                    tail, at = self.buffer[at:], len(self.buffer)
                got = z.decompress(tail, READ_BYTES)
                if take:
                    parts.append(got)
                tail = z.unconsumed_tail
            self.skip(size if size else at - len(z.unused_data) if z.unused_data else at)
            if take:
                yield headers, b"".join(parts)[: int(headers["content-length"])]


def value_of(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(NAMES[column])
    return value.removeprefix("sha1:") if value and column == "payload_digest" else value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tests = options["path"].rstrip("/"), []
        self.verify = options.get("verify", "false") == "true"

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, base = open_fs(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.File]
        listed = [f.path for f in found if f.base_name.startswith("_manifest-")]
        if listed:
            files = [name for path in listed for name in json.loads(system.open_input_stream(path).read())]
        else:
            files = [f.base_name for f in found if f.base_name.endswith((".warc.gz", ".warc"))]
        return [WarcFile(f"{self.path}/{f}") for f in sorted(files)] or [WarcFile("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        system, path = open_fs(partition.uri)
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in (c.split(" ")[0] for c in SCHEMA.split(", "))])
        rows, size = [], 0
        with system.open_input_file(path) as stream:
            for headers, block in Members(stream).records(lambda h: all(value_of(h, c) in v for c, v in self.tests)):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = headers.get("warc-type") == "revisit"
                lengths = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")] if revisit else []
                row = {c: value_of(headers, c) for c in PUSHED}
                if self.verify and not revisit and row["payload_digest"] not in (None, digest_of(payload)):
                    raise ValueError(f"{row['record_id']}: the payload doesn't have its digest")
                rows.append(row | {"payload_bytes": int(lengths[0]) if lengths else len(payload), "http_headers": http.decode("utf-8", "replace"), "payload": None if revisit else payload})
                size += len(block)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """format("warc"): record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, http_headers, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame) -> DataFrame:
    """The record of each page: response for the largest page_id of equal payloads, revisit for the others.

    Digests are grouped with map-side combining; the pages themselves are joined by page_id, so a payload that a third of
    the pages share makes no hot key.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("sha"))
    best = digests.groupBy("sha").agg(F.max("page_id").alias("response"))
    revisits = digests.join(best, "sha").where(F.col("page_id") < F.col("response")).select("page_id", F.col("sha").alias("own_sha"), "response").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    joined = rows.withColumn("sha", F.sha1("payload")).join(revisits.withColumnRenamed("page_id", "own_id"), (F.col("page_id") == F.col("own_id")) & (F.col("sha") == F.col("own_sha")), "left")
    first = F.col("response").isNull()
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.when(~first, urn("response")).alias("refers_to"),
        F.col("sha").alias("payload_sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(first, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    archive_records(pages).select(*WRITE_COLUMNS).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The archive's records; with verify, payloads that are decoded are hashed and must have their header's digest."""
    register(spark)
    return spark.read.format("warc").option("verify", str(verify).lower()).load(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as an archive in the shared folder and reads the records back; responses are hashed anew."""
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archive(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
