"""WARC archives as a Python data source.

Reading plans partitions from the files' sizes, takes filters on record type and header
columns, parses a record's headers first, and touches the payload only of records that pass and
only if the payload is asked for. Members of gzip files that carry the ``sl`` extra field (the record's
compressed and plain length) are skipped by seeking; others are inflated and thrown away.
Plain archives are skipped by Content-Length.

Writing gives each task files of its own, one gzip member per record, each with the ``sl``
field. The names of the files of a write that succeeded go into a manifest; a folder
with manifests is read by them, so files of lost tasks are never seen.

Paths are URIs of any file system that pyarrow reaches, or local paths.

Edge cases: a null payload is empty. Missing headers are null. A record cut off by the end of a file is an error. An empty
folder gives no rows; null ids get a random one. Repeated rows are records of their own. Payloads of any length are read in pieces and
given whole. Of pages, only id, address and html are read, so other columns may have any names; an empty table of pages gives no records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import stored

#: Columns that come from headers, by name of the header (fixed values of the format).
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long, headers map<string,string>, payload binary, file string, offset long"])
#: Bytes of a partition, and of a file after which a writer starts another.
PARTITION, FILE = 64 << 20, 64 << 20
CHUNK = 1 << 18


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


class _Source:
    """Bytes of a file with a place that can move ahead without reading."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.held, self.at = file, b"", 0  # at: of held[0] in the file

    def need(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.file.read(max(n - len(self.held), CHUNK))
        return self.held[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.at + n)
            self.held = b""
        self.at += n


class _Plain:
    """One record's bytes in an archive that isn't compressed."""

    def __init__(self, source: _Source) -> None:
        self.source = source

    def head(self) -> bytes | None:
        while (lead := self.source.need(2)) in (b"\r\n", b"\n\n") or lead[:1] == b"\n":
            self.source.skip(2 if lead == b"\r\n" else 1)
        n = 4096
        while b"\r\n\r\n" not in (got := self.source.need(n)):
            if len(got) < n:
                if got.strip():
                    raise ValueError("an archive ends within a record's headers")
                return None
            n *= 2
        n = got.index(b"\r\n\r\n") + 4
        self.source.skip(n)
        return got[:n]

    def body(self, n: int) -> bytes:
        got = self.source.need(n)
        if len(got) < n:
            raise ValueError("an archive ends within a record")
        self.source.skip(n)
        return got

    def leave(self, n: int) -> None:
        self.source.skip(n)


class _Member:
    """One record in a gzip member of its own."""

    def __init__(self, source: _Source) -> None:
        self.source, self.inflate, self.out = source, zlib.decompressobj(31), bytearray()
        self.length = self._stated()
        self.used = 0

    def _stated(self) -> int | None:
        """The member's compressed length, from its ``sl`` field."""
        head = self.source.need(12)
        if len(head) < 12 or not head[3] & 4:
            return None
        size = struct.unpack("<H", head[10:12])[0]
        extra = self.source.need(12 + size)[12:]
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and n == 8:
                return struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
        return None

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        got = self.source.need(1)
        if not got:
            raise ValueError("an archive ends within a member")
        piece = self.source.held[:CHUNK]
        self.out += self.inflate.decompress(piece, CHUNK)
        taken = len(piece) - len(self.inflate.unconsumed_tail or b"") - len(self.inflate.unused_data)
        self.source.skip(taken)
        self.used += taken
        return True

    def head(self) -> bytes | None:
        while b"\r\n\r\n" not in self.out:
            if not self.more():
                return None
        n = self.out.index(b"\r\n\r\n") + 4
        head = bytes(self.out[:n])
        del self.out[:n]
        return head

    def body(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("a member is shorter than its record")
        got = bytes(memoryview(self.out)[:n])
        self.leave(n)
        return got

    def leave(self, _: int) -> None:
        if self.length is not None:
            self.source.skip(self.length - self.used)
            self.inflate = zlib.decompressobj()
            return
        while self.more():
            self.out.clear()


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that starts with white space goes on with the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """Without the HTTP headers of a stored response or request."""
    if headers.get("content-type", "").startswith("application/http"):
        head, mark, rest = block.partition(b"\r\n\r\n")
        return rest if mark else b""
    return block


def read_records(file: pa.NativeFile, passes, want_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """(headers, payload, offset) of the records whose headers pass."""
    source = _Source(file)
    while True:
        start = source.at
        lead = source.need(2)
        if not lead:
            return
        record = _Member(source) if lead == b"\x1f\x8b" else _Plain(source)
        head = record.head()
        if head is None:
            if isinstance(record, _Plain):
                return
            continue
        headers = parse_headers(head)
        n = int(headers.get("content-length", "0"))
        if passes(headers):
            if want_payload:
                yield headers, _payload(headers, record.body(n)), start
            else:
                record.leave(n)
                yield headers, None, start
        else:
            record.leave(n)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path = options["path"]
        self.columns = schema.names
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def _passes(self, headers: dict[str, str]) -> bool:
        for f in self.filters:
            value = headers.get(HEADERS[f.attribute[0]])
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, place = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True)) if fs.get_file_info(place).type != pafs.FileType.File else [fs.get_file_info(place)]
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        files = [f for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
        if manifests:
            named = {n for m in manifests for n in json.loads(fs.open_input_stream(m.path).read())}
            files = [f for f in files if f.base_name in named]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if held and size + f.size > PARTITION:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        want = "payload" in self.columns
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for headers, payload, offset in read_records(file, self._passes, want):
                    rows.append((headers, payload, path, offset))
                    held += 1000 + len(payload or b"")
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        make = {
            "content_length": lambda: pa.array([int(h.get("content-length", "0")) for h, *_ in rows], pa.int64()),
            "headers": lambda: pa.array([list(h.items()) for h, *_ in rows], pa.map_(pa.string(), pa.string())),
            "payload": lambda: pa.array([p for _, p, *_ in rows], pa.binary()),
            "file": lambda: pa.array([r[2] for r in rows], pa.string()),
            "offset": lambda: pa.array([r[3] for r in rows], pa.int64()),
        }
        arrays = [make[c]() if c in make else pa.array([h.get(HEADERS[c]) for h, *_ in rows], pa.string()) for c in self.columns]
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, record_id, target_uri, date, payload, payload_sha1 (20 bytes), refers_to; others become headers X-<name>."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.level = options["path"], int(options.get("level", "1"))
        if overwrite:
            fs, place = _open(self.path)
            if fs.get_file_info(place).type == pafs.FileType.Directory:
                fs.delete_dir_contents(place)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, place = _open(self.path)
        fs.create_dir(place, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None or size > FILE:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{place}/{names[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(row), self.level)
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = _open(self.path)
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/_manifest-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{place}/{name}")


def record_bytes(row: dict) -> bytes:
    payload = row.pop("payload", None) or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = row.pop("record_type")
    block = b"" if kind == "revisit" else http + payload
    sha1 = row.pop("payload_sha1", None)
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{row.pop('record_id', None) or 'urn:uuid:' + str(uuid.uuid4())}>",
        "WARC-Date": row.pop("date", None) or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row.pop("target_uri", None),
        "WARC-Payload-Digest": sha1 and "sha1:" + base64.b32encode(sha1).decode(),
        "WARC-Refers-To": (to := row.pop("refers_to", None)) and f"<{to}>",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        **{"X-" + k.replace("_", "-"): v for k, v in row.items()},
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: object) -> str:
    return " ".join(str(value).splitlines())


def gzip_member(record: bytes, level: int) -> bytes:
    """A gzip member whose ``sl`` extra field holds its own length and the record's."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(record) & 0xFFFFFFFF)
    return struct.pack("<4BL2BH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<LL", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Records under ``path``; name the columns to leave payloads unread."""
    register(spark)
    names = StructType.fromDDL(SCHEMA)
    chosen = names if columns is None else StructType([names[c] for c in columns])
    return spark.read.format("warc").schema(chosen).load(path)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A record per page; pages with equal payloads of at least ``least_bytes`` revisit the one with the smallest id.

    Pages without an id revisit the smallest of those that have one; rows that share the smallest id all are responses.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("target_uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("payload_sha1"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_sha1").agg(F.min("page").alias("first"))
    # Stored, so that the join deals both sides anew, and the rows of one payload, such as all null pages, can be split.
    first = stored(first, "first-pages")
    joined = rows.join(first, "payload_sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.col("page").cast("string")).alias("record_id"),
        "target_uri",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_sha1",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and intact: whether a response's payload has its digest and length."""
    records = read_warc(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "headers", "payload"])
    number = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    bare = F.substring_index("payload_digest", ":", -1)
    stated = F.col("headers").getItem("x-payload-length").cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", stated).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        bare.alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.when(F.col("record_type") == "response", (F.octet_length("payload") == stated) & (base32(F.sha1("payload")) == bare)).alias("intact"),
    )


def base32(digest: Column) -> Column:
    """A hexadecimal digest of whole groups of five digits in base 32: upper case, no padding."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
