"""WARC archives as a PySpark Python data source (reader and writer).

Reading plans one partition per file.  Of each record the header block is
parsed first; filters on the record type and other header columns are pushed
into the source, and the payload of a record that no filter wants, or of any
record when ``payload`` is ``false``, is never inflated: archives written here
note each gzip member's length in the member's extra field, so the reader
jumps to the next record.  Members without the note, and plain ``.warc`` files,
are read too.

Writing takes rows of (record_id, record_type, target_uri, refers_to, payload,
payload_bytes, payload_digest) and makes one file a task.  A task writes under
a name of its own attempt; the commit on the driver gives the files of the
attempts that count their final names and removes what other attempts of the
write left (a reader would not look at it).

``archive_pages`` turns pages into records: of equal payloads of at least
``least`` bytes the largest page_id is the response and the others are
revisits without a payload.

Edge cases: a null payload is empty; a null url has no target header; a null
page_id is never the largest of its group and is written as ``null``; rows that
tie on the largest page_id of a group are all responses; control characters
in header values are percent-encoded; a payload of any length is one record;
further columns are not read; an empty table gives no archive, and reading a
folder without archives gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from starloom.llm.skew import split_join
from starloom.llm.store import stored

LEAST_REVISIT = 1000
HEAD = 16_384  # bytes inflated at first to find the header block
READ = 1 << 22
BATCH_BYTES = 1 << 23
DATE = "2024-01-01T00:00:00Z"  # default WARC-Date when the input has no crawl time

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = pa.schema(
    [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in _NAMES]
)
_HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _digest_out(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _digest_in(value: str | None) -> str | None:
    if not value or not value.lower().startswith("sha1:"):
        return None
    raw = value[5:].strip()
    if len(raw) == 40:
        return raw.lower()
    try:
        return base64.b32decode(raw.upper()).hex()
    except ValueError:
        return None


def record_bytes(row: dict, level: int = 6) -> bytes:
    """One record as a gzip member whose extra field holds the member length."""
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if revisit:
        lines.append(f"WARC-Refers-To: <{_clean(row['refers_to'])}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"WARC-Payload-Digest: {_digest_out(row['payload_digest'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = 20 + len(body) + 8
    return struct.pack("<4BI2BH2sHI", 31, 139, 8, 4, 0, 0, 255, 8, b"SL", 4, whole) + body + tail


class _File:
    """Forward reader of one file with a bounded buffer."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.at, self.ended = source, b"", 0, False

    def need(self, n: int) -> bool:
        """Have ``n`` unread bytes in the buffer, if the file has them."""
        while len(self.buffer) - self.at < n and not self.ended:
            more = self.source.read(max(READ, n))
            self.ended = not more
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return len(self.buffer) - self.at >= n

    def peek(self, n: int) -> bytes:
        self.need(n)
        return self.buffer[self.at : self.at + n]

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.source.seek(n - have, 1)
            self.buffer, self.at = b"", 0


def _header(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _fields(head: dict[str, str]) -> dict:
    row = {c: head.get(h) for c, h in _HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].strip("<>")
    row["payload_digest"] = _digest_in(head.get("warc-payload-digest"))
    return row


def _finish(row: dict, head: dict[str, str], block: bytes, payload: bool) -> dict:
    """Split the HTTP header off the block."""
    body = block
    if head.get("content-type", "").startswith("application/http"):
        front, _, body = block.partition(b"\r\n\r\n")
        length = _header(front).get("content-length", "")
        row["payload_bytes"] = int(length) if length.isdigit() else len(body)
    else:
        row["payload_bytes"] = int(head.get("content-length", len(body)))
    row["payload"] = body if payload and row["record_type"] != "revisit" else None
    return row


def read_records(source, wanted, payload: bool = True) -> Iterator[dict]:
    """Rows of an open WARC file.  ``wanted`` judges the header columns; the
    block of a record that it rejects is skipped undecoded where possible."""
    file = _File(source)
    while file.need(1):
        if file.peek(2) == b"\x1f\x8b":
            yield from _gzip_record(file, wanted, payload)
        elif file.peek(5) == b"WARC/":
            yield from _plain_record(file, wanted, payload)
        else:
            file.skip(1)  # blank lines between records


def _gzip_record(file: _File, wanted, payload: bool) -> Iterator[dict]:
    start = file.peek(20)
    whole = struct.unpack("<I", start[16:20])[0] if len(start) == 20 and start[3] == 4 and start[12:14] == b"SL" else 0
    member = zlib.decompressobj(31)
    used, raw = 0, b""
    limit = HEAD if whole else 0  # 0: no limit, the member must be inflated to find its end
    while b"\r\n\r\n" not in raw and not member.eof:
        chunk = file.peek(min(whole, used + HEAD) if whole else used + READ)[used:]
        if not chunk and not member.unconsumed_tail:
            break
        raw += member.decompress(member.unconsumed_tail + chunk, limit)
        used += len(chunk)
    head_raw, _, block = raw.partition(b"\r\n\r\n")
    head = _header(head_raw)
    row = _fields(head)
    if whole:
        if wanted(row):
            # a header-only read still needs the HTTP header at the block's start
            if payload or b"\r\n\r\n" not in block:
                rest = member.unconsumed_tail + file.peek(whole)[used:]
                block += member.decompress(rest) + member.flush()
            length = int(head.get("content-length", len(block)))
            yield _finish(row, head, block[:length], payload)
        file.skip(whole)
        return
    parts = [block]
    while not member.eof:
        file.skip(used)
        chunk, used = file.peek(READ), 0
        if not chunk:
            break
        parts.append(member.decompress(chunk))
        used = len(chunk)
    file.skip(used - len(member.unused_data))
    if wanted(row):
        block = b"".join(parts)
        yield _finish(row, head, block[: int(head.get("content-length", len(block)))], payload)


def _plain_record(file: _File, wanted, payload: bool) -> Iterator[dict]:
    size = HEAD
    while (end := file.peek(size).find(b"\r\n\r\n")) < 0 and file.need(size):
        size *= 2
    if end < 0:
        file.skip(len(file.buffer) - file.at)
        return
    head = _header(file.peek(end))
    length = int(head.get("content-length", 0))
    row = _fields(head)
    file.skip(end + 4)
    if wanted(row):
        block = file.peek(length if payload else min(length, HEAD))
        yield _finish(row, head, block, payload)
    file.skip(length)


class WarcFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    """One partition a file; header predicates are checked in the reader."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in (*_HEADERS, "payload_digest") and isinstance(f, EqualTo | In | StringStartsWith):
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        names = [i.path for i in found if i.is_file and re.search(r"\.warc(\.gz)?$", i.base_name)]
        return [WarcFile(p) for p in sorted(names)] or [WarcFile("")]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            have = row[name]
            if have is None:
                return False
            if kind == "StringStartsWith" and not have.startswith(value):
                return False
            if kind == "EqualTo" and have != value or kind == "In" and have not in value:
                return False
        return True

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as source:
            for row in read_records(source, self.wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWritten(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file of its own; the commit gives it its name."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        attempt = context.taskAttemptId() if context else 0
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        name, out = f"{self.run}-{part:06d}-{attempt}", None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.open")
                out.write(record_bytes(row))
        if out is None:
            return WarcWritten([])
        out.close()
        return WarcWritten([name])

    def commit(self, messages) -> None:
        fs, path = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{path}/{name}.open", f"{path}/{name}.warc.gz")
        self._clear(fs, path)

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        """Remove the unfinished files of this write."""
        for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(self.run) and info.base_name.endswith(".open"):
                fs.delete_file(info.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to the session and let filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_record_id(page_id) -> F.Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def archive_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to ``path``.

    The payloads are moved only if the revisits don't fit a broadcast: equal
    payloads are found on (page_id, digest) alone, by an aggregate that
    combines before its shuffle, and one row a revisit is joined back."""
    register(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("target_uri"),
        F.encode(body, "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    tops = large.groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    revisits = (
        split_join(large, stored(tops, "warc-tops"), "payload_digest", "n")
        .where(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
        .select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "top")
        .distinct()
    )
    both = rows.join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")),
        "left",
    )
    is_revisit = F.col("top").isNotNull()
    records = both.select(
        page_record_id(F.col("page_id")).alias("record_id"),
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(is_revisit, page_record_id(F.col("top"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~is_revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").option("path", path).mode("append").save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below ``path`` (columns of ``SCHEMA``)."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
