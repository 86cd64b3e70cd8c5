"""WARC archives: written with one gzip member per record, read back in sequence.

Spark's text writer puts the members' bytes into files and commits them, on any
file system it knows. Files are read with Spark's binary reader; each is inflated
as it is walked, records are framed by their Content-Length, and both digests are
verified.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.llm.common import pieces, small
from wiresift.session import checkpoint_dir, cut

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
#: Payload bytes of a file, at most, but for a file of one record.
FILE_BYTES = 64 << 20
#: Records are dealt into files by size: those up to the first of these bytes together, and so on.
SIZES = (1 << 16, 1 << 20, 1 << 24)
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, payload_bytes: int,
           refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with its payload, or a revisit without, uncompressed."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload_bytes}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte.

    The last byte of a member is the top byte of its size. From 16 MB on that is
    not 0; an empty member, which readers pass over, then follows.
    """
    def pack(part: bytes) -> bytes:
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        return deflate.compress(part) + deflate.flush()
    out = pack(data)
    return out if out[-1] == 0 else out + pack(b"")


def with_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to) of (page_id, url, html).

    A null html is an empty payload. Of equal payloads with at least ``min_bytes``
    bytes that with the smallest page_id is the response, and the others name it in
    ``refers_to``. Rows that repeat its id are responses, too; where no row of the
    payload has an id, all are.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")) \
        .withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    first = cut(
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    return rows.join(small(first), "digest", "left").select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE,
                   file_bytes: int = FILE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``.

    A file holds at most ``records_per_file`` records and ``file_bytes`` bytes of
    payload, or one larger record: records of different sizes go to files of their own,
    with so many records each as their size allows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Few records at once where they are large.
                rows = 128 if batch.column(4)[at].as_py() <= SIZES[0] else 1
                part = batch.slice(at, rows)
                members = [member(record(**row))[:-1] for row in part.rename_columns(
                    ["page_id", "url", "payload", "digest", "payload_bytes", "refers_to"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])
                at += part.num_rows

    typed, size = with_types(pages), F.col("payload_bytes")
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    low = -1
    for high in (*SIZES, None):
        some = typed.where((size > low) if high is None else (size > low) & (size <= high))
        records = 1 if high is None else max(1, min(records_per_file, file_bytes // high))
        # The writer ends each row with the separator: here the zero byte that ends a member.
        some.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option(
            "lineSep", "\0").option("maxRecordsPerFile", records).mode("append").text(path)
        low = high
        if high is None or largest <= high:
            break


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    problem: str | None = None
    payload: bytes = field(default=b"")

    def page(self, name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(name, ""))
        return int(found[1]) if found else None


def read_records(data: bytes | memoryview, step: int = READ) -> Iterator[Record]:
    """The records of an archive, inflated ``step`` bytes at a time.

    A damaged member gives a record of kind ``damaged`` with its problem, and
    reading goes on at the next one that a gzip header announces.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, frame, begin = zlib.decompressobj(31), _Frame(), at
        problem = None
        try:
            while not inflate.eof:
                if at >= len(view):
                    raise ValueError("the member is cut off")
                chunk = view[at:at + step]
                frame.add(inflate.decompress(chunk))
                at += len(chunk) - len(inflate.unused_data)
            if frame.empty():
                continue
            yield frame.record()
        except (zlib.error, ValueError) as error:
            problem = str(error)
        if problem:
            yield Record("damaged", {}, b"", problem)
            at = _next_member(view, begin + 1)


def _next_member(view: memoryview, at: int) -> int:
    while at < len(view):
        window = bytes(view[at:at + READ])
        found = window.find(b"\x1f\x8b\x08")
        if found >= 0:
            return at + found
        at += max(1, len(window) - 2) if at + len(window) < len(view) else len(window)
    return len(view)


class _Frame:
    """One record as its bytes come in: header lines, then so many bytes, then two line ends."""

    def __init__(self) -> None:
        self.head = bytearray()
        self.body: bytearray | None = None
        self.headers: dict[str, str] = {}
        self.length = 0
        self.block_sha = hashlib.sha256()
        self.hashed = 0

    def add(self, data: bytes) -> None:
        if self.body is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n", max(0, len(self.head) - len(data) - 3))
            if end < 0:
                return
            self.body = bytearray(self.head[end + 4:])
            lines = bytes(self.head[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC version line")
            for line in lines[1:]:
                name, colon, value = line.partition(":")
                if not colon:
                    raise ValueError(f"header line without a colon: {line[:80]}")
                self.headers[name.strip().lower()] = value.strip()
            if not self.headers.get("content-length", "").isdigit():
                raise ValueError("no Content-Length")
            self.length = int(self.headers["content-length"])
        else:
            self.body += data
        end = min(len(self.body), self.length)
        if end > self.hashed:
            self.block_sha.update(memoryview(self.body)[self.hashed:end])
            self.hashed = end
        if len(self.body) > self.length + 4:
            raise ValueError("more bytes than Content-Length says")

    def empty(self) -> bool:
        return self.body is None and not self.head

    def record(self) -> Record:
        if self.body is None or len(self.body) != self.length + 4 or self.body[self.length:] != b"\r\n\r\n":
            raise ValueError("the record does not end where Content-Length says")
        block = bytes(self.body[:self.length])
        kind = self.headers.get("warc-type", "")
        said = self.headers.get("warc-block-digest")
        if said and said != f"sha256:{self.block_sha.hexdigest()}":
            raise ValueError("the block digest does not match")
        payload = block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else block
        said = self.headers.get("warc-payload-digest")
        if kind != "revisit" and said and said != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("the payload digest does not match")
        return Record(kind, self.headers, block, None, payload)

def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, problem[, payload]).

    One row per record of the files in ``path``. Digests and sizes are those of the
    full payload, for a revisit as its headers give them. Damaged records have
    type ``damaged`` and say what is wrong. A file is one task's work, so archives
    should be of moderate size, as ``write_archives`` makes them.
    """
    schema = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
              "refers_to long, problem string" + (", payload binary" if payloads else ""))
    names = [p.split()[0] for p in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[p.split()[1]] for p in schema.split(", ")]

    def rows(data: bytes) -> Iterator[tuple]:
        for r in read_records(data):
            length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", r.block[:4096]) if r.kind == "revisit" else None
            out = (r.page("warc-record-id"), r.headers.get("warc-target-uri"), r.kind,
                   int(length[1]) if length else len(r.payload),
                   r.headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                   r.page("warc-refers-to"), r.problem)
            yield (*out, r.payload) if payloads else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            held: list[tuple] = []
            for row in rows(batch.column(0)[0].as_buffer()):
                held.append(row)
                if len(held) == 256:
                    yield _batch(held, names, types)
                    held = []
            if held:
                yield _batch(held, names, types)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors reach."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
