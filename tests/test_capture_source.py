"""The capture data source: pushed filters, splits, and captures that grow while they are read."""

import datetime as dt
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_run import tcp, udp
from wiresift.sources import capture_source as C
from wiresift.sources.capture import read_capture
from wiresift.streaming import online as O

HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101)


def records(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        ends = (bytes([10, 0, 0, rng.randrange(4)]), rng.choice((53, 80, 4000))), (bytes([10, 0, 1, 1]), rng.choice((53, 9000)))
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        pkt = udp(*ends, body) if rng.random() < 0.5 else tcp(*ends, i, 24, body)
        out.append(struct.pack("<IIII", 1_700_000_000 + i, i, len(pkt), len(pkt)) + pkt)
    return out


def plain(df):
    return sorted((r.capture, r.ts, bytes(r.pkt)) for r in df.select("capture", "ts", "pkt").collect())


@pytest.fixture
def folder(tmp_path):
    for i in range(2):
        (tmp_path / f"c{i}.pcap").write_bytes(HEAD + b"".join(records(i, 300)))
    return tmp_path


def test_same_packets(spark, folder):
    got = C.captured(spark, str(folder))
    want = read_capture(spark, str(folder)).withColumn("capture", F.concat(F.lit("file://"), "capture"))
    assert plain(got) == plain(want) and got.rdd.getNumPartitions() == 2
    order = [(r.capture, r.ts) for r in got.orderBy("pkt_seq").collect()]
    assert order == sorted(order) and got.select("pkt_seq").distinct().count() == 600


def test_filters_reach_the_source(spark, folder):
    every = [r.asDict() for r in C.captured(spark, str(folder)).collect()]
    assert {r["proto"] for r in every} == {6, 17}
    tests = [("proto = 17 AND dport = 53", lambda r: r["proto"] == 17 and r["dport"] == 53),
             ("sport IN (53, 80) AND len >= 9 AND src > '10.0.0.1'", lambda r: r["sport"] in (53, 80) and r["len"] >= 9 and r["src"] > "10.0.0.1"),
             ("(sport = 53 OR dport = 53) AND proto < 10", lambda r: (r["sport"] == 53 or r["dport"] == 53) and r["proto"] < 10)]
    for where, test in tests:
        df = C.captured(spark, str(folder)).where(where)
        assert sorted(r.pkt_seq for r in df.collect()) == sorted(r["pkt_seq"] for r in every if test(r))
    reader = C._Batch(C._uri(str(folder)))
    left = list(reader.pushFilters([C.EqualTo(("proto",), 17), C.EqualTo(("capture",), "x"), C.In(("dport",), (53,))]))
    assert [type(f) for f in left] == [C.EqualTo] and len(reader.wanted) == 2
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == sum(r["proto"] == 17 and r["dport"] == 53 for r in every) < len(every) / 2
    plan = C.captured(spark, str(folder)).where("proto = 17 AND dport = 53")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(proto,17)" in plan.replace(" ", "") or "proto" not in plan.split("Filter")[-1].split("Scan")[0]


def test_growing_captures(spark, tmp_path):
    """What triggers take while files grow, in the middle of records too, is what stands there in the end."""
    parts, target = [b"".join(records(i, 400)) for i in range(2)], tmp_path / "in"
    target.mkdir()
    stream = C.growing_captures(spark, str(target), trigger_bytes=6000)
    out = str(tmp_path / "out")

    def take():
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(
            availableNow=True).start()
        query.awaitTermination()
    rng = random.Random(1)
    for i in range(2):
        written = 0
        for _ in range(3):
            cut = min(len(parts[i]), written + rng.randrange(2000, 9000)) if _ < 2 else len(parts[i])
            with open(target / f"c{i}.pcap", "ab") as f:
                f.write((b"" if written else HEAD) + parts[i][written:cut])
            written = cut
            take()
    for _ in range(8):
        take()
    got, want = spark.read.parquet(out), C.captured(spark, str(target))
    assert plain(got) == plain(want) and want.count() == 800


def test_bounds_and_offsets(tmp_path):
    data = records(5, 100)
    path = tmp_path / "x.pcap"
    path.write_bytes(HEAD + b"".join(data)[:-7])
    reader = C._Stream(C._uri(str(path)), 1000)
    at, offsets = reader.initialOffset(), []
    for _ in range(40):
        end = reader.latestOffset()
        pieces = reader.partitions(at, end)
        offsets += [sum(b.num_rows for b in reader.read(p)) for p in pieces]
        at = end
    assert sum(offsets) == 99 and max(offsets) < 40
    # After a restart the next offset is taken from what is there, and never lies before the last one.
    again = C._Stream(C._uri(str(path)), 1000)
    assert again.latestOffset() == at and again.partitions(at, again.latestOffset()) == []
    (tmp_path / "empty").mkdir()
    assert C.capture_files(C._uri(str(tmp_path / "empty"))) == []


@pytest.fixture
def many(tmp_path):
    """Sixty small files in two folders, and some that are no captures by name or size."""
    for i in range(60):
        folder = tmp_path / "in" / ("a" if i % 2 else "b.c")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"c{i:02d}.pcap").write_bytes(HEAD + b"".join(records(i, 4)))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"x" * 40)
    (tmp_path / "in" / "short.pcap").write_bytes(b"x")
    return tmp_path / "in"


def read_all(reader, pieces):
    return sorted((b.column("capture")[i].as_py(), b.column("pkt_seq")[i].as_py()) for p in pieces for b in reader.read(p) for i in range(b.num_rows))


def test_small_files_share_a_task_of_the_stream(spark, many, tmp_path):
    reader = C._Stream(C._uri(str(many)), 1 << 20, tasks=4)
    pieces = reader.partitions(reader.initialOffset(), end := reader.latestOffset())
    assert 4 <= len(pieces) <= 8 and len(read_all(reader, pieces)) == 240
    assert len(json.dumps(end)) < sum(len(str(f)) for f in many.rglob("c*.pcap"))
    order = read_all(reader, pieces)
    assert [n >> C.FILE_SHIFT for _, n in order] == [i for i in range(60) for _ in range(4)]
    got = O.drain(C.growing_captures(spark, str(many)))
    assert plain(got) == plain(C.captured(spark, str(many)))


def test_offsets_of_single_files_are_understood(many):
    """Progress as it was written before, a file each, and by a base with a slash."""
    reader = C._Stream(C._uri(str(many)), 1 << 20, tasks=4)
    whole = reader.partitions(reader.initialOffset(), end := reader.latestOffset())
    every = {path: [number, at] for p in whole for path, number, _, at in p}
    before = {path: [n, C.FILE_HEADER if n % 3 else at] for path, (n, at) in every.items() if n < 30}
    left = read_all(reader, reader.partitions(before, end))
    assert left == read_all(reader, reader.partitions(before, every)) and len(left) == 240 - 40
    again = C._Stream(C._uri(str(many)), 1 << 20)
    assert again.partitions(every, end) == [] == again.partitions(every, again.latestOffset())
    again = C._Stream(C._uri(str(many)) + "/", 1 << 20)
    assert again.partitions(end, again.latestOffset()) == []
    again.known = before
    (many / "a" / "a0.pcap").write_bytes(HEAD + b"".join(records(99, 4)))
    assert {n for p in again.partitions(end, again.latestOffset()) for _, n, _, _ in p} >= {30}


def test_small_files_share_a_task_of_a_batch(spark, many):
    reader = C._Batch(C._uri(str(many)), tasks=4)
    assert 4 <= len(pieces := reader.partitions()) <= 8
    got = C.captured(spark, str(many))
    assert got.rdd.getNumPartitions() < 40 and got.count() == len(read_all(reader, pieces)) == 240
    assert sum(len(p.packed) for p in pieces) < 60 * 100
