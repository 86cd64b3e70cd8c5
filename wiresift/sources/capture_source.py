"""Capture files as a data source of Spark: with filters on header columns, and as a stream that follows their growth.

Filters are decided on a packet's header bytes, before anything of it becomes a row.
A stream's progress is a byte offset for each file, always between two records. The
files are read through pyarrow's file systems, so their place must be one that these
reach from the driver and the executors; ``read_capture`` reads the rest.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from wiresift.functions.headers import TCP, UDP
from wiresift.sources.capture import (
    FILE_HEADER, FILE_SHIFT, RECORD_HEADER, ROWS_PER_BATCH, SPLIT_BYTES, CaptureFile, files_below, in_batches,
)

FORMAT = "wiresift_capture"
SCHEMA = ("capture string, pkt_seq long, ts timestamp, pkt binary, proto int, src string, dst string, sport int, dport int, "
          "len int")
_ARROW = pa.schema([
    ("capture", pa.string()), ("pkt_seq", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("pkt", pa.binary()),
    ("proto", pa.int32()), ("src", pa.string()), ("dst", pa.string()), ("sport", pa.int32()), ("dport", pa.int32()),
    ("len", pa.int32())])
HEADERS = ("proto", "src", "dst", "sport", "dport", "len")
#: Bytes of records that one trigger takes from each file.
TRIGGER_BYTES = 64 << 20
#: Tasks that the files are dealt to, about, where nothing else is said; and the bytes that the opening of a file counts for.
TASKS, OPEN_BYTES = 64, 1 << 14
_FILES = pa.schema([("path", pa.large_string()), ("size", pa.int64())])
_TAKEN = pa.schema([("path", pa.large_string()), ("number", pa.int64()), ("at", pa.int64())])
_PIECES = pa.schema([("path", pa.large_string()), ("number", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_READ = 1 << 20
_TESTS: dict[type, tuple[str, Callable[[Any, Any], bool]]] = {
    EqualTo: ("=", lambda x, v: x == v), In: ("in", lambda x, v: x in v), GreaterThan: (">", lambda x, v: x > v),
    GreaterThanOrEqual: (">=", lambda x, v: x >= v), LessThan: ("<", lambda x, v: x < v),
    LessThanOrEqual: ("<=", lambda x, v: x <= v)}
_OPS = dict(_TESTS.values())


def headers_of(pkt: bytes) -> tuple[int, str, str, int | None, int | None, int]:
    """(proto, src, dst, sport, dport, payload bytes) of an IPv4 packet; no ports beyond a first fragment or TCP and UDP."""
    head, proto = (pkt[0] & 15) * 4, pkt[9]
    total = struct.unpack_from("!H", pkt, 2)[0]
    src, dst = (".".join(map(str, pkt[a:a + 4])) for a in (12, 16))
    first = struct.unpack_from("!H", pkt, 6)[0] & 0x1FFF == 0
    if not first or proto not in (TCP, UDP) or len(pkt) < head + (20 if proto == TCP else 8):
        return proto, src, dst, None, None, max(0, min(total, len(pkt)) - head)
    sport, dport = struct.unpack_from("!HH", pkt, head)
    skip = head + ((pkt[head + 12] >> 4) * 4 if proto == TCP else 8)
    return proto, src, dst, sport, dport, max(0, min(total, len(pkt)) - skip)


@dataclass(frozen=True)
class Wanted:
    """One pushed test of a header column."""

    column: str
    op: str
    value: Any

    def holds(self, fields: tuple) -> bool:
        x = fields[HEADERS.index(self.column)]
        return x is not None and _OPS[self.op](x, self.value)


@dataclass
class Pieces(InputPartition):
    """Records that start in [start, end) of each of some files, packed: there may be very many."""

    base: str
    packed: bytes

    def __iter__(self) -> Iterator[tuple[str, int, int, int]]:
        """(URI, file number, start, end)"""
        for batch in _unpacked(self.packed).to_batches(max_chunksize=4096):
            for path, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield self.base + path, *numbers


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def listed(path: str) -> tuple[str, pa.Table]:
    """A URI, and (path after it, size) of the capture files at or below ``path``, by name."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    root = root.rstrip("/") or root
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    host = path.split("://")[1].split("/")[0] if "://" in path and not path.startswith("file:") else ""
    base = f"{scheme}{host}{root}" if host == "" or not root.startswith(host) else f"{scheme}{root}"
    found = ((name[len(root):], size) for name, size in files_below(where, root)
             if size >= FILE_HEADER and not name.rsplit("/", 1)[-1].startswith(("_", ".")))
    return base, pa.Table.from_batches(in_batches(found, _FILES, ROWS_PER_BATCH), _FILES).sort_by("path")


def capture_files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the capture files at or below ``path``, by name."""
    base, files = listed(path)
    return [(base + name, size) for name, size in zip(*(c.to_pylist() for c in files.columns), strict=True)]


def shared_out(base: str, pieces: pa.Table, tasks: int) -> list[InputPartition]:
    """(path, number, start, end) rows in order as partitions, about ``tasks`` of them or more: small files share one."""
    weight = (pieces["end"].to_numpy() - pieces["start"].to_numpy()) + OPEN_BYTES
    most = min(SPLIT_BYTES, max(OPEN_BYTES, -(-int(weight.sum()) // tasks)))
    out, first, held = [], 0, 0
    for i, w in enumerate(weight.tolist()):
        if held and held + w > most:
            out.append(Pieces(base, _packed(pieces.slice(first, i - first))))
            first, held = i, 0
        held += w
    return out + ([Pieces(base, _packed(pieces.slice(first)))] if held else [])


def rows_of(pieces: Pieces, wanted: list[Wanted]) -> Iterator[pa.RecordBatch]:
    """The packets of the pieces that pass all tests."""
    def rows() -> Iterator[tuple]:
        for path, number, start, end in pieces:
            file, at = CaptureFile(path), start
            for after, micros, frame in file.records(start, end):
                pkt = file.datagram(frame)
                if pkt is not None and len(pkt) >= 20:
                    fields = headers_of(pkt)
                    if all(w.holds(fields) for w in wanted):
                        yield path, number << FILE_SHIFT | at, micros, pkt, *fields
                at = after

    yield from in_batches(rows(), _ARROW, ROWS_PER_BATCH)


class _Batch(DataSourceReader):
    def __init__(self, path: str, tasks: int = TASKS) -> None:
        self.path, self.tasks = path, tasks
        self.wanted: list[Wanted] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and len(column) == 1 and column[0] in HEADERS:
                self.wanted.append(Wanted(column[0], _TESTS[type(f)][0], f.value if hasattr(f, "value") else f.values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        base, files = listed(self.path)
        n = files.num_rows
        pieces = pa.table([files["path"], np.arange(n), np.full(n, FILE_HEADER), files["size"]], schema=_PIECES)
        return shared_out(base, pieces, self.tasks)

    def read(self, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        return rows_of(pieces, self.wanted)


class _Stream(DataSourceStreamReader):
    """An offset has the number of each file and the byte up to which it was taken; files get their numbers as they are found, by name.

    As there may be very many files, their table is packed: ``{"base": URI, "files": (path after it, number, byte)}``.
    Offsets written as ``{file: [number, byte]}`` are understood, too.
    """

    def __init__(self, path: str, trigger_bytes: int, tasks: int = TASKS) -> None:
        self.path, self.trigger_bytes, self.tasks = path, trigger_bytes, tasks
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        self.known = {}
        return {}

    def latestOffset(self) -> dict:
        # After a restart the place is not known yet: then all that is there is taken.
        bound = None if self.known is None else self.trigger_bytes
        base, files = listed(self.path)
        known = _taken(self.known or {}, base)
        places = _places(files, known)
        old, new = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        first = pc.max(known["number"]).as_py() + 1 if known.num_rows else 0
        numbers, ats = np.empty(files.num_rows, np.int64), np.full(files.num_rows, FILE_HEADER)
        numbers[old], ats[old] = known["number"].to_numpy()[places[old]], known["at"].to_numpy()[places[old]]
        numbers[new] = first + np.arange(len(new))
        i = 0
        for batch in files.to_batches(max_chunksize=ROWS_PER_BATCH):
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A file that was looked into and has not grown is not opened.
                if not FILE_HEADER < ats[i] == size:
                    ats[i] = _whole_records(base + path, int(ats[i]), size, bound)
                i += 1
        seen = np.zeros(known.num_rows, bool)
        seen[places[old]] = True
        found = pa.table([files["path"], numbers, ats], schema=_TAKEN)
        gone = known.filter(pa.array(~seen))
        self.known = _offset(base, pa.concat_tables([found, gone]).sort_by("path")) if found.num_rows + gone.num_rows else {}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end
        base = end.get("base") if isinstance(end.get("base"), str) else ""
        begun, ended = _taken(start, base), _taken(end, base).sort_by("path")
        places = _places(ended, begun)
        starts = np.full(ended.num_rows, FILE_HEADER)
        starts[places >= 0] = begun["at"].to_numpy()[places[places >= 0]]
        pieces = pa.table([ended["path"], ended["number"], starts, ended["at"]], schema=_PIECES)
        return shared_out(base, pieces.filter(pc.greater(pieces["end"], pieces["start"])), self.tasks)

    def read(self, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        return rows_of(pieces, [])


def _offset(base: str, taken: pa.Table) -> dict:
    return {"base": base, "files": base64.b64encode(_packed(taken)).decode()}


def _taken(offset: dict, base: str) -> pa.Table:
    """(path after ``base``, number, at) of an offset; the whole URI as path where it does not begin with ``base``."""
    if isinstance(offset.get("base"), str):
        table = _unpacked(base64.b64decode(offset["files"]))
        if offset["base"] == base:
            return table
        rows = [(offset["base"] + path, n, at) for path, n, at in zip(*(c.to_pylist() for c in table.columns), strict=True)]
    else:
        rows = [(uri, n, at) for uri, (n, at) in offset.items()]
    return pa.Table.from_batches(in_batches(((u.removeprefix(base), n, at) for u, n, at in rows), _TAKEN, ROWS_PER_BATCH), _TAKEN)


def _places(files: pa.Table, among: pa.Table) -> np.ndarray:
    """The row of each file among others, by path; -1 if it has none."""
    if not among.num_rows:
        return np.full(files.num_rows, -1)
    return pc.fill_null(pc.index_in(files["path"], value_set=among["path"].combine_chunks()), -1).to_numpy().astype(np.int64)


def _whole_records(path: str, at: int, size: int, bound: int | None) -> int:
    """Where the last whole record ends that starts within ``bound`` bytes of ``at``."""
    file = CaptureFile(path)
    stop = size if bound is None else min(size, at + bound)
    data, origin = b"", at
    while at < stop:
        if at + RECORD_HEADER > origin + len(data):
            origin, data = at, file.file.read_at(min(_READ, size - at), at)
            if len(data) < RECORD_HEADER:
                break
        kept = file.record.unpack_from(data, at - origin)[2]
        if at + RECORD_HEADER + kept > size:
            break
        at += RECORD_HEADER + kept
    return at


class CaptureSource(DataSource):
    """``spark.read.format("wiresift_capture").load(path)``, and the same with ``readStream``.

    A file is in one partition of a batch, as where records begin is only known by walking
    them, and small files share one, by ``tasks``; ``read_capture`` splits large files.
    ``trigger_bytes`` is an option of streams.
    ``pkt_seq`` rises by file and by place in the file; it is not dense.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("tasks", TASKS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("trigger_bytes", TRIGGER_BYTES)), int(self.options.get("tasks", TASKS)))


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the captures below ``path`` with their header columns, filters on which reach the source."""
    return _registered(spark).read.format(FORMAT).options(tasks=_tasks(spark)).load(_uri(path))


def growing_captures(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The same as a stream: packets as captures grow and new ones come."""
    return _registered(spark).readStream.format(FORMAT).options(**{"tasks": _tasks(spark)} | options).load(_uri(path))


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    return spark


def _tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"
