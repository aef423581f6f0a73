"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Records are gzip members of their own.  The writer ends the headers with a full flush
and states the member's length in an extra field ("sl"), so the reader can inflate the
headers alone and step over a payload that nobody asked for.  Members of other writers
are inflated to their end.  Every task writes files under a pending name; the driver's
commit moves those of the tasks that count, so lost executors leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from leadmill.llm.common import scratch_dir, slices, tidy

READ_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Column of the data source to the WARC header it is read from.
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 256 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: percent signs and control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _unline(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, errors="surrogatepass") if "%" in value else value


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str) -> tuple[bytes, bytes]:
    """(headers of WARC and HTTP, payload with the record's end)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_line(record_id)}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _line(uri))] if uri is not None else []
    head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{_line(refers_to)}>")] if kind == "revisit" else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + http, body + b"\r\n\r\n"


def member(head: bytes, body: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(body) + z.flush()
    whole, plain = 10 + 2 + 12 + len(data) + 8, len(head) + len(body)
    extra = b"sl" + struct.pack("<HII", 8, whole if whole < 1 << 32 else 0, plain & 0xFFFFFFFF)
    crc = zlib.crc32(body, zlib.crc32(head))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", crc, plain & 0xFFFFFFFF)


#: Names under which Hadoop and Arrow know the same stores.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a Spark path; a path without a scheme is local."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}" if colon else uri)


class MemberReader:
    """Gzip members of one file, headers first.

    The buffer is read from ``start`` on and cut when what is behind it is large, so that every byte is moved a bounded number of times.
    """

    def __init__(self, f):
        self.f, self.data, self.start = f, bytearray(), 0

    @property
    def buffer(self) -> memoryview:
        return memoryview(self.data)[self.start :]

    def _fill(self, n: int) -> bool:
        while len(self.data) - self.start < n:
            more = self.f.read(max(1 << 18, n - len(self.data) + self.start))
            if not more:
                return False
            if self.start > 1 << 20:
                self.data, self.start = self.data[self.start :], 0
            self.data += more
        return True

    def _skip(self, n: int) -> None:
        here = len(self.data) - self.start
        if n <= here:
            self.start += n
        else:
            self.f.seek(self.f.tell() + n - here)
            self.data, self.start = bytearray(), 0

    def _find(self, byte: bytes, start: int) -> int:
        at = self.data.find(byte, self.start + start)
        return at - self.start if at >= 0 else -1

    def __iter__(self):
        """(headers of WARC, headers of HTTP, call that returns the payload) per record."""
        while self._fill(12):
            flags = self.buffer[3]
            whole, start = 0, 10
            if flags & 4:
                (n,) = struct.unpack_from("<H", self.buffer, 10)
                self._fill(12 + n)
                extra = bytes(self.buffer[12 : 12 + n])
                if extra[:2] == b"sl":
                    whole = struct.unpack_from("<I", extra, 4)[0]
                start = 12 + n
            for bit in (8, 16):  # a name, a comment
                while flags & bit and (end := self._find(b"\0", start)) < 0 and self._fill(len(self.data) - self.start + 1):
                    pass
                start = end + 1 if flags & bit else start
            start += 2 if flags & 2 else 0
            z, plain, fed = zlib.decompressobj(-15), bytearray(), start

            def more(z=z, plain=plain):
                nonlocal fed
                if z.eof or not self._fill(fed + 1):
                    return False
                part = bytes(self.buffer[fed : fed + (1 << 16)])
                plain += z.decompress(part)
                fed += len(part) - len(z.unused_data)
                return True

            ends: list[int] = []
            while len(ends) < 2:
                at = plain.find(b"\r\n\r\n", ends[-1] if ends else 0)
                if at >= 0:
                    ends.append(at + 4)
                elif not more():
                    ends += [len(plain)] * (2 - len(ends))
            warc, http = parse(bytes(plain[: ends[0]])), parse(bytes(plain[ends[0] : ends[1]]))

            def payload(more=more, plain=plain, warc=warc, ends=ends):
                while more():
                    pass
                size = int(warc.get("content-length", 0)) - (ends[1] - ends[0])
                return bytes(plain[ends[1] : ends[1] + max(0, size)])

            yield warc, http, payload
            if not whole:
                while more():
                    pass
                whole = fed + 8
            self._skip(whole)


def parse(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode(errors="replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


@dataclass
class Files(InputPartition):
    uris: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "keep")
        self.part_bytes = int(options.get("partbytes", 128 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        """Equality on what the headers hold is answered before a payload is inflated."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and f.attribute[0] == "record_type"):
                yield f

    def partitions(self):
        """Files in groups of about ``partbytes``; a file is read by one task."""
        where, path = file_system(self.path)
        found = [x for x in where.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name.endswith(".warc.gz")]
        prefix = self.path.rstrip("/")
        out, room = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not out or room < x.size:
                out.append(Files([]))
                room = self.part_bytes
            out[-1].uris.append(f"{prefix}/{x.base_name}")
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for uri in partition.uris:
            where, path = file_system(uri)
            with where.open_input_file(path) as f:
                for warc, http, payload in MemberReader(f):
                    got = {c: (_unline(v.strip("<>")) if (v := warc.get(h.lower())) is not None else None) for c, h in HEADER_OF.items()}
                    if any(got[c] not in values for c, values in self.wanted.items()):
                        continue
                    got["payload_digest"] = warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    got["payload_bytes"] = int(http["content-length"]) if "content-length" in http else None
                    got["payload"] = None
                    if got["record_type"] == "response" and self.payload != "skip":
                        data = payload()
                        if self.payload == "check":
                            got["payload_digest"], got["payload_bytes"] = digest_of(data), len(data)
                        else:
                            got["payload"] = data
                            held += len(data)
                    rows.append(got)
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_type, record_id, target_uri, refers_to, payload_digest, payload)."""

    def __init__(self, options):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = file_system(self.path)
        where.create_dir(f"{path}/_pending", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            cols = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload")]
            for row in zip(*cols, strict=True):
                kind, record_id, uri, refers_to, digest, payload = (x.as_py() for x in row)
                data = member(*record(kind, record_id, uri, refers_to, digest, payload or b"", self.date))
                if out is None or size + len(data) > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{path}/_pending/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        where, path = file_system(self.path)
        for m in messages:
            for name in m.names if m else []:
                where.move(f"{path}/_pending/{name}", f"{path}/{name}")
        if where.get_file_info(f"{path}/_pending").type != fs.FileType.NotFound:
            where.delete_dir(f"{path}/_pending")

    def abort(self, messages) -> None:
        where, path = file_system(self.path)
        if where.get_file_info(f"{path}/_pending").type != fs.FileType.NotFound:
            where.delete_dir(f"{path}/_pending")


class WarcDataSource(DataSource):
    """Options: path; payload = keep, check (recompute digest and length, return no bytes) or skip; partbytes; date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _payloads(keep: bool):
    """html to payload bytes, digest and length."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                data = [x.as_py().encode() if x.is_valid else b"" for x in batch.column("html")]
                digests = pa.array([digest_of(x) for x in data], pa.string())
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), digests, pa.array(data, pa.binary())], ["page_id", "url", "payload_digest", "payload"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("page_id"), digests, pa.array([len(x) for x in data], pa.int64())], ["page_id", "payload_digest", "payload_bytes"])

    return run


def write_archives(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are ignored) under ``path``.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the smallest page_id are
    responses and the others revisit it.  A null html is an empty payload, a null url has no
    header, and a null page_id counts as larger than all others.  Rows that repeat the smallest
    page_id with its payload are all responses.  No rows, no files.
    """
    register(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    thin = pages.mapInArrow(tidy(_payloads(False)), "page_id long, payload_digest string, payload_bytes long")
    first = thin.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    again = thin.where(F.col("payload_bytes") >= min_payload).join(first.select("payload_digest", "first"), "payload_digest").where("page_id is null or page_id <> first")
    again = again.select("page_id", F.col("payload_digest").alias("digest"), "first").distinct()
    full = pages.mapInArrow(tidy(_payloads(True)), "page_id long, url string, payload_digest string, payload binary")
    rows = full.join(again, full["page_id"].eqNullSafe(again["page_id"]) & (full["payload_digest"] == again["digest"]), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    rows.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        urn(full["page_id"]).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("first").isNotNull(), urn(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload",
    ).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: str = "check") -> DataFrame:
    """The records under ``path``, a page_id beside each; filters on types and headers reach the reader."""
    register(spark)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    rows = spark.read.format("warc").option("payload", payload).load(path)
    return rows.withColumns({"page_id": number("record_id"), "refers_to_page": number("refers_to")})


def archive_pages(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back: one row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); the digests and lengths of
    responses are computed from the payloads read, those of revisits are their headers'.
    """
    path = scratch_dir(pages.sparkSession)
    write_archives(pages, path, min_payload)
    rows = read_archives(pages.sparkSession, path, "check")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
