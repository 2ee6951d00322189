"""WARC archives: a writer with revisit records, and a reader that salvages what lies behind damage."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.session import shared_folder, stored

#: Fixed values of the format and of its revisit profile.
VERSION = b"WARC/1.1\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MEMBER = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
CHUNK = 1 << 18


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """An uncompressed record: the page as an HTTP response, or (`revisit_of`) its HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit_of is not None else http + payload
    fields = [
        ("WARC-Type", "response" if revisit_of is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~"))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:x-page:{revisit_of}>")] if revisit_of is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@dataclass
class Record:
    """A record that passed all checks, with the bytes [offset, offset + length) of the file that it takes."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes without a valid record."""

    offset: int
    length: int
    reason: str


class _Damaged(Exception):
    pass


class SalvageReader:
    """Records and gaps of a seekable file, in order. Memory is bounded by one record and a chunk.

    Checks: a gzip member's own sums and length, version line, header lines, content length, end of record, and the sha1 or
    sha256 digests that are given. After a failed check it looks for the next place where a whole record
    passes all of them.
    """

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, 2)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def __iter__(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.size:
            try:
                record = self._record(at)
                yield record
                at += record.length
            except _Damaged as why:
                begin, found = at, None
                for start in self._starts(at + 1):
                    try:
                        found = self._record(start)
                        break
                    except _Damaged:
                        continue
                at = found.offset if found else self.size
                yield Gap(begin, at - begin, str(why))
                if found:
                    yield found
                    at += found.length

    def _starts(self, offset: int) -> Iterator[int]:
        overlap = 16
        while offset < self.size:
            data = self._at(offset, CHUNK + overlap)
            for m in STARTS.finditer(data):
                if m.start() < CHUNK:
                    yield offset + m.start()
            offset += CHUNK

    def _record(self, offset: int) -> Record:
        head = self._at(offset, 16)
        if head.startswith(GZIP_MEMBER):
            data, length = self._unpacked(offset)
            headers, begin = self._headers(data)
            n = self._content_length(headers)
            if len(data) != begin + n + 4:
                raise _Damaged("length differs from Content-Length")
            return self._checked(offset, length, headers, data[begin : begin + n], data[begin + n :])
        if not VERSION_LINE.match(head):
            raise _Damaged("no member or version line")
        headers, begin = self._headers(self._until_blank_line(offset))
        n = self._content_length(headers)
        if offset + begin + n + 4 > self.size:
            raise _Damaged("cut off")
        data = self._at(offset + begin, n + 4)
        return self._checked(offset, begin + n + 4, headers, data[:n], data[n:])

    def _until_blank_line(self, offset: int) -> bytes:
        """A record's header, of any length, with what was read beyond its blank line."""
        out = self._at(offset, CHUNK)
        while b"\r\n\r\n" not in out and len(more := self._at(offset + len(out), len(out))):
            out += more
        return out

    def _unpacked(self, offset: int) -> tuple[bytes, int]:
        z, out, at = zlib.decompressobj(31), [], offset
        try:
            while not z.eof:
                data = self._at(at, CHUNK)
                if not data:
                    raise _Damaged("member is cut off")
                at += len(data)
                out.append(z.decompress(data))
                if len(out) == 1 and len(out[0]) >= 10 and not VERSION_LINE.match(out[0]):
                    raise _Damaged("member holds no record")
        except zlib.error as e:
            raise _Damaged("member fails its checks") from e
        return b"".join(out), at - len(z.unused_data) - offset

    @staticmethod
    def _headers(data: bytes) -> tuple[dict[str, str], int]:
        end = data.find(b"\r\n\r\n")
        if not VERSION_LINE.match(data) or end < 0:
            raise _Damaged("no complete header")
        headers = {}
        for line in data[:end].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if not colon or not name.strip():
                raise _Damaged("bad header line")
            headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys():
            raise _Damaged("a required field is missing")
        return headers, end + 4

    @staticmethod
    def _content_length(headers: dict[str, str]) -> int:
        if not re.fullmatch("[0-9]{1,15}", headers["content-length"]):
            raise _Damaged("bad Content-Length")
        return int(headers["content-length"])

    @staticmethod
    def _checked(offset: int, length: int, headers: dict[str, str], block: bytes, end: bytes) -> Record:
        if end != b"\r\n\r\n":
            raise _Damaged("no end of record")
        parts = {"warc-block-digest": block}
        if headers["warc-type"] == "response":
            parts["warc-payload-digest"] = block.partition(b"\r\n\r\n")[2]
        for field, data in parts.items():
            kind, _, value = headers.get(field, "").partition(":")
            if kind.lower() in ("sha256", "sha1") and len(value) in (64, 40) and hashlib.new(kind.lower(), data).hexdigest() != value.lower():
                raise _Damaged(f"{field} differs")
        return Record(offset, length, headers, block)


def with_record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, and `first`: for a revisit the page it refers to, else null.

    Only digests that occur twice are joined back; their smallest ids combine before the shuffle, and a
    frequent digest's rows are split by the adaptive skew join.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    seen = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(seen.where("n > 1").drop("n"), "payload_digest", "left")
    revisit = (F.octet_length("payload") >= least) & (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("first", F.when(revisit, F.col("first")))


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll: int = 16 << 20) -> DataFrame:
    """Write gzipped archives of about `roll` bytes into `folder`; returns the list of those that count (path, records, bytes).

    pages: page_id, url, html. A null html is an empty payload, a null url leaves the field out. Of pages with equal payloads of
    `least` bytes or more, those with the smallest id are responses, the others (a null id too) revisits.
    Every attempt of a task writes files of its own name, and only a finished task's files are listed, so
    lost executors leave stray files at worst. An empty table makes no archive; other columns are not looked at.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            columns = {k: batch.column(k) for k in batch.schema.names}
            for i in range(batch.num_rows):
                page, url, payload, digest, first = (columns[k][i].as_py() for k in ("page_id", "url", "payload", "payload_digest", "first"))
                if out is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, records, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record_bytes(page, url, payload, digest, first))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), arrow)], schema=arrow)

    system, base = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return stored(with_record_types(pages, least).select("page_id", "url", "payload", "payload_digest", "first").mapInArrow(run, schema), "warc-list")


READ_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("quarantined", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA for every record, and for every gap (`quarantined` has the reason, the record's columns are null).

    paths: a column `path` of archives, gzipped by record or plain, in any file system that pyarrow opens. The digest and size are those of
    the full payload; for a revisit, which holds none, they are what its headers say. A null path gives no row.
    """
    arrow = to_arrow_schema(READ_SCHEMA)

    def rows(path: str) -> Iterator[tuple]:
        system, name = pyarrow.fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as file:
            for x in SalvageReader(file):
                if isinstance(x, Gap):
                    yield (path, x.offset, x.length, x.reason, *[None] * 7)
                    continue
                head, _, payload = x.block.partition(b"\r\n\r\n")
                kind, digest, n = x.headers["warc-type"], hashlib.sha256(payload).hexdigest(), len(payload)
                if kind == "revisit":
                    digest = x.headers.get("warc-payload-digest", "").partition(":")[2] or None
                    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                    n, payload = int(m[1]) if m else None, None
                yield path, x.offset, x.length, None, kind, x.headers["warc-record-id"], x.headers.get("warc-target-uri"), x.headers.get("warc-refers-to"), digest, n, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").drop_null().to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[2] if with_payload else 0
                    if len(held) >= 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

    spread = paths.select("path")
    return spread.repartition(max(1, min(spread.count(), 20_000))).mapInArrow(run, READ_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cellwise/warc-{uuid.uuid4().hex}"
