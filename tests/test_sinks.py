"""Capture files in and out, reports, annotation joins, summaries."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from wiresift.operators import annotate, summary
from wiresift.operators.scan import block_of
from wiresift.operators.streams import line_mode
from wiresift.sources import capture, sinks

TS = dt.datetime(2024, 5, 6, 7, 8, 9, 123456, dt.timezone.utc)


def ip(body, proto=17):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0,
                       b"\x0a\0\0\x01", b"\x0a\0\0\x02") + body


def write_capture(path, frames, order=">", magic=0xA1B2C3D4, link=1):
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link))
        for i, frame in enumerate(frames):
            out.write(struct.pack(order + "IIII", 1_700_000_000 + i, 5, len(frame), len(frame)) + frame)


ETHER = b"\0\x0b\0\x0b\0\x0b\0\x0a\0\x0a\0\x0a\x08\0"


@pytest.mark.parametrize("order,magic,link,before", [
    (">", 0xA1B2C3D4, 1, ETHER), ("<", 0xA1B2C3D4, 1, ETHER), ("<", 0xA1B23C4D, 1, ETHER),
    (">", 0xA1B2C3D4, 101, b""), ("<", 0xA1B2C3D4, 1, ETHER[:12] + b"\x81\0\0\x05\x08\0")])
def test_read_formats(spark, tmp_path, order, magic, link, before):
    frames = [before + ip(bytes([i]) * i) for i in range(5)] + ([ETHER[:12] + b"\x86\xdd" + b"6" * 40] if link == 1 else [])
    write_capture(tmp_path / "a.pcap", frames, order, magic, link)
    rows = capture.read_capture(spark, str(tmp_path)).orderBy("pkt_seq").collect()
    assert [bytes(r.pkt) for r in rows] == [ip(bytes([i]) * i) for i in range(5)]


def test_large_file_is_split_exactly(spark, tmp_path):
    """Payloads that look like records themselves mislead a guess, not the result."""
    rng = random.Random(3)
    fake = struct.pack(">IIII", 1_700_000_000, 7, 8, 8) + b"notapkt!"
    frames = [ETHER + ip(fake * rng.randint(0, 60) if i % 3 else rng.randbytes(rng.randint(0, 900)))
              for i in range(400)]
    write_capture(tmp_path / "big.pcap", frames)
    write_capture(tmp_path / "small.pcap", frames[:3])
    whole = capture.read_capture(spark, str(tmp_path)).orderBy("pkt_seq").collect()
    parts = capture.read_capture(spark, str(tmp_path), split_bytes=4096).orderBy("pkt_seq").collect()
    assert [bytes(r.pkt) for r in whole] == [f[14:] for f in frames + frames[:3]]
    assert parts == whole
    assert whole[0].pkt_seq == 0 and whole[399].pkt_seq == 399


def test_capture_parts_and_round_trip(spark, tmp_path):
    packets = [("f1", i, TS, bytearray(ip(bytes([i]) * 30))) for i in range(40)] + [
        ("f2", 40, TS, bytearray(ip(b"x" * (277 - 2 * 34)))), ("f2", 41, TS, bytearray(ip(b"")))]
    df = spark.createDataFrame(packets, "file_name string, pkt_seq long, ts timestamp, pkt binary")
    images = sinks.flow_captures(df, block_of(F.col("pkt_seq"), 8), part_bytes=1000)
    sizes = {(r.file_name, r.part_no): len(r.content) for r in images.collect()}
    assert sizes["f2", 0] == 24 + sum(16 + 14 + len(p[3]) for p in packets[40:]) == 333
    assert len(sizes) > 2
    sinks.write_captures(spark, images, str(tmp_path / "out"))
    back = capture.read_capture(spark, str(tmp_path / "out"))
    assert sorted(bytes(r.pkt) for r in back.collect()) == sorted(bytes(p[3]) for p in packets)
    assert {r.ts.replace(tzinfo=None) for r in back.collect()} == {
        r.ts for r in df.collect()}


def test_payload_parts_keep_every_byte(spark):
    rows = [("a", i, bytearray(bytes([i % 256]) * (i % 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, no long, data binary")
    parts = sinks.payload_log(df, ["key"], ["no"], block_of(F.col("no"), 16), part_bytes=64).orderBy("part_no").collect()
    assert b"".join(bytes(p.content) for p in parts) == b"".join(bytes(r[2]) for r in rows)
    assert max(len(p.content) for p in parts) < 64 + 7


def test_line_mode_payloads_append(spark, tmp_path):
    parts = spark.createDataFrame([("TCP", "CTS", 1, bytearray(b"ab"))], "proto string, direction string, f int, content binary")
    for linemode, want in ((False, 1), (True, 2), (False, 1)):
        sinks.write_payloads(parts, str(tmp_path / "log"), linemode)
        assert spark.read.parquet(str(tmp_path / "log")).count() == want


CHUNK = "flow_id long, direction string, chunk_no long, payload binary"


def test_packet_span_and_pieces(spark):
    sizes = [10, 5, 0, 20, 1, 7]
    rows = [(1, "CTS", i, bytearray(bytes([65 + i]) * n)) for i, n in enumerate(sizes)]
    ranges = line_mode(spark.createDataFrame(rows, CHUNK)).withColumn("pkt_no", F.col("chunk_no") + 1)
    stream = b"".join(bytes(r[3]) for r in rows)
    owner = [i + 1 for i, n in enumerate(sizes) for _ in range(n)]
    spans = [(a, b) for a in (0, 3, 9, 10, 15, 34, 35, 36, 42) for b in (a + 1, a + 6, a + 30) if b <= 43]
    matches = spark.createDataFrame([(1, "CTS", i, a, b) for i, (a, b) in enumerate(spans)],
                                    "flow_id long, direction string, match_no int, start_off long, end_off long")
    key, ident = ["flow_id", "direction"], ["flow_id", "direction", "match_no"]
    for bucket in (4, 1 << 16):
        got = {r.match_no: (r.first_pkt, r.last_pkt)
               for r in annotate.packet_span(matches, ranges, key, ident, bucket).collect()}
        assert got == {i: (owner[a], owner[b - 1]) for i, (a, b) in enumerate(spans)}
        pieces = annotate.match_pieces(matches, ranges, key, ident, bucket).orderBy("match_no", "piece_off").collect()
        data = {}
        for p in pieces:
            data[p.match_no] = data.get(p.match_no, b"") + bytes(p.data)
        assert data == {i: stream[a:b] for i, (a, b) in enumerate(spans)}


def test_summary_ties_go_to_the_latest(spark):
    m = spark.createDataFrame([("TCP", 1, 1, 9), ("TCP", 2, 2, 9), ("TCP", 3, 3, 12), ("TCP", 4, 4, 12)],
                              "proto string, seq long, id long, size long")
    p = spark.createDataFrame([("TCP",)] * 6 + [("UDP",)], "proto string")
    rows = {r.proto: r for r in summary.summary(p, m, ["seq"], "id").collect()}
    t, u = rows["TCP"], rows["UDP"]
    assert (t.processed, t.matched, t.shortest, t.shortest_id, t.longest, t.longest_id) == (6, 4, 9, 2, 12, 4)
    assert (u.processed, u.matched, u.shortest, u.longest_id) == (1, 0, 0, 0)


def test_rule_expressions(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (3, 1)], "flow long, rule_id int")
    got = annotate.rule_expr(m, ["flow"], {"m01": 1, "m02": 2, "m03": 3}, "m01 and (m02 or m03)")
    assert sorted(r.flow for r in got.collect()) == [1, 3]


def test_the_driver_lists_no_captures(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    names = ["b/x.pcap", "a-b.pcap", "a/z.pcap", "é.pcap", "a/long.pcap"]
    want = {}
    for i, name in enumerate(sorted(names)):
        n = 300 if name.endswith("long.pcap") else 2
        df = spark.range(n).select(F.lit("f").alias("file_name"), F.col("id").alias("pkt_seq"), F.timestamp_seconds(F.col("id")).alias("ts"),
                                   F.unhex(F.lit("45")).alias("pkt"))
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(bytes(sinks.flow_captures(df, None).first().content))
        want[f"{tmp_path}/in/{name}"] = [(i << capture.FILE_SHIFT) + k for k in range(n)]
    (tmp_path / "in" / "empty.pcap").write_bytes(b"")

    def refused(*_, **__):
        raise AssertionError("listed by the driver")
    monkeypatch.setattr(fs, "FileSelector", refused)
    for split in (1 << 20, 100):
        got = {}
        for r in capture.read_capture(spark, str(tmp_path / "in"), split).orderBy("pkt_seq").collect():
            got.setdefault(r.capture, []).append(r.pkt_seq)
        assert got == want
    (tmp_path / "none").mkdir()
    assert capture.read_capture(spark, str(tmp_path / "none")).count() == 0
