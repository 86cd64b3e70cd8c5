"""Whole runs over packets made by hand: encode, decode, flows, assembly, rules, extracts."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from wiresift.functions.headers import decode_packets
from wiresift.plans.run import inspect
from wiresift.spec import InspectSpec, Rule

A, B = (b"\x0a\0\0\x01", 4000), (b"\x0a\0\0\x02", 80)
T0 = dt.datetime(2024, 1, 1)


def tcp(src, dst, seq, flags, body=b""):
    head = struct.pack("!HHLLBBHHH", src[1], dst[1], seq % 2**32, 0, 0x50, flags, 1, 0, 0) + body
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(head), 1, 0, 64, 6, 0, src[0], dst[0]) + head


def udp(src, dst, body):
    head = struct.pack("!HHHH", src[1], dst[1], 8 + len(body), 0) + body
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(head), 1, 0, 64, 17, 0, src[0], dst[0]) + head


S, SA, ACK, PA, FA = 2, 18, 16, 24, 17
C, D = 2**32 - 20, 500


def conversation():
    """A connection whose sequence numbers wrap, with a lost order and a copy, and two datagram flows."""
    low, high = (b"\x0a\0\0\x07", 53), (b"\x0a\0\0\x08", 9000)
    return [
        tcp(A, B, C, S), tcp(B, A, D, SA), tcp(A, B, C + 1, ACK),
        tcp(A, B, C + 11, PA, b"needle two"), tcp(A, B, C + 1, PA, b"first nee."),
        tcp(A, B, C + 1, PA, b"first nee."), tcp(B, A, D + 1, PA, b"answer nee"), tcp(B, A, D + 11, PA, b"dle end"),
        tcp(A, B, C + 21, FA), tcp(B, A, D + 18, FA),
        tcp((b"\x0a\0\0\x09", 1), B, 9, PA, b"needle untracked"),
        udp(high, low, b"ask needle"), udp(low, high, b"reply"), udp(low, high, b"needle reply"),
        *[udp(high, low, b"more") for _ in range(5)],
    ]


def decoded(spark, packets=None):
    rows = [(i, T0 + dt.timedelta(seconds=i), bytearray(p)) for i, p in enumerate(packets or conversation())]
    return decode_packets(spark.createDataFrame(rows, "pkt_seq long, ts timestamp, pkt binary"))


def test_first_match(spark):
    run = inspect(decoded(spark), InspectSpec(rules=(Rule(1, pattern="needle"),), post_packets=1))
    got = {(r.proto, r.flow_id, r.direction, r.start_off, r.end_off, r.found_at, r.match_pkt)
           for r in run.matches.collect()}
    assert got == {("TCP", 0, "CTS", 10, 16, 4, 5), ("UDP", 11, "CTS", 4, 10, 11, 1), ("UDP", 11, "STC", 0, 6, 13, 3)}
    span = run.with_packet_span().first()
    assert (span.first_pkt, span.last_pkt) == (4, 4)
    rows = {r.proto: r for r in run.summary().collect()}
    assert (rows["TCP"].processed, rows["TCP"].matched, rows["UDP"].processed, rows["UDP"].matched) == (1, 1, 8, 2)
    kept = {}
    for r in run.extracted().collect():
        kept.setdefault((r.proto, r.extract_no), set()).add(r.pkt_no)
    assert kept == {("TCP", 1): set(range(1, 7)), ("UDP", 1): {1, 2}, ("UDP", 2): {3, 4}}


def test_match_over_two_packets(spark):
    run = inspect(decoded(spark), InspectSpec(rules=(Rule(1, pattern="needle", direction="STC"),)))
    tcp_match = run.with_packet_span().first()
    assert (tcp_match.start_off, tcp_match.end_off, tcp_match.first_pkt, tcp_match.last_pkt) == (7, 13, 7, 8)
    pieces = [bytes(r.data) for r in run.matched_bytes().orderBy("piece_off").collect()]
    assert pieces == [b"nee", b"dle"]
    assert {r.pkt_no for r in run.extracted().filter("proto = 'TCP'").collect()} == set(range(1, 11))


def test_multi_match_and_limits(spark):
    rules = (Rule(1, pattern="nee"),)
    run = inspect(decoded(spark), InspectSpec(rules=rules, multi_match=True, max_datagrams=2))
    got = sorted((r.proto, r.direction, r.start_off) for r in run.matches.collect())
    assert got == [("TCP", "CTS", 6), ("TCP", "CTS", 10), ("TCP", "STC", 7), ("UDP", "CTS", 4)]


def test_line_mode(spark):
    run = inspect(decoded(spark), InspectSpec())
    got = [(r.direction, r.start_off, r.end_off) for r in run.matches.filter("proto = 'TCP'").orderBy(
        "found_at", "start_off").collect()]
    assert got == [("CTS", 0, 10), ("CTS", 10, 20), ("STC", 0, 10), ("STC", 10, 17)]
    assert {r.matched for r in run.summary().collect()} == {0}
    assert {r.flow_id for r in run.extracted().collect()} == {0, 11}


def test_input_order_does_not_matter(spark):
    spec = InspectSpec(rules=(Rule(1, pattern="needle"),))
    plain = inspect(decoded(spark), spec).matches.collect()
    mixed = inspect(decoded(spark).orderBy(F.hash("pkt_seq")), spec).matches.collect()
    assert sorted(map(str, plain)) == sorted(map(str, mixed))


@pytest.mark.parametrize("without", [1, 2])
def test_no_handshake_no_streams(spark, without):
    packets = [p for i, p in enumerate(conversation()) if i != without and i < 10 and not (without == 2 and i > 2)]
    run = inspect(decoded(spark, packets), InspectSpec(rules=(Rule(1, pattern="needle"),)))
    assert run.matches.count() == 0


def test_fragments_are_merged_before_flows(spark):
    from wiresift.plans.run import packets_of

    whole = udp((b"\x0a\0\0\x07", 53), (b"\x0a\0\0\x08", 9000), b"x" * 12 + b"a needle across both")

    def piece(low, high, more):
        body = whole[20 + low:20 + high]
        return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 7, more << 13 | low // 8, 64, 17, 0, *(
            whole[12:16], whole[16:20])) + body

    packets = [piece(24, len(whole), 0), piece(0, 24, 1), whole]
    rows = [(i, T0, bytearray(p)) for i, p in enumerate(packets)]
    merged = packets_of(spark.createDataFrame(rows, "pkt_seq long, ts timestamp, pkt binary"))
    assert sorted((r.pkt_seq, bytes(r.payload)[12:], r.sport) for r in merged.collect()) == [
        (0, b"a needle across both", 53), (2, b"a needle across both", 53)]
    run = inspect(merged, InspectSpec(rules=(Rule(1, pattern="needle"),)))
    assert [(r.flow_id, r.start_off) for r in run.matches.orderBy("match_no").collect()] == [(0, 14), (0, 14)]
    lines = [r.line2 for r in run.report().orderBy("found_at").collect()]
    assert len(lines) == 2 and lines[0].startswith("[MATCH] (00000001/00000001)") and "[14:20] (6B)" in lines[0]
    assert [bytes(r.content) for r in run.payloads().collect()] == [b"needleneedle"]


def test_display_modes(spark):
    """Each mode shows the matches it should, clipped or piece by piece."""
    rules = (Rule(1, pattern="needle"),)
    modes = ("quiet", "meta", "hex", "print", "raw")
    run = inspect(decoded(spark), InspectSpec(rules=rules, multi_match=True, output_modes=modes, max_disp_bytes=4))
    rows = {(r.proto, r.direction, r.match_no): r for r in run.displayed().collect()}
    assert set(rows) == {("TCP", "CTS", 1), ("TCP", "STC", 1), ("UDP", "CTS", 1), ("UDP", "STC", 1)}
    for r in rows.values():
        assert (bytes(r.raw), r.print, r.piece_off) == (b"need", "need", 0) and r.hex.startswith("00000000") and "6e 65 65 64" in r.hex
        assert r.meta[0].startswith("[MATCH]") and "] - 6B" in r.quiet
    whole = inspect(decoded(spark), InspectSpec(rules=rules, multi_match=True, output_modes=("raw",)))
    got = sorted((r.proto, r.direction, r.piece_off, bytes(r.raw)) for r in whole.displayed().collect())
    assert got == [("TCP", "CTS", 0, b"needle"), ("TCP", "STC", 0, b"nee"), ("TCP", "STC", 3, b"dle"),
                   ("UDP", "CTS", 0, b"needle"), ("UDP", "STC", 0, b"needle")]
    few = InspectSpec(rules=rules, multi_match=True, output_modes=("quiet",), max_disp_streams=1, max_disp_datagrams=1)
    assert [r.quiet for r in inspect(decoded(spark), few).displayed().collect()] == [
        "matches 'needle' @ [10:16] - 6B", "matches 'needle' @ [4:10] - 6B"]


def test_chunk_limit_and_whole_flows(spark):
    run = inspect(decoded(spark), InspectSpec(rules=(Rule(1, pattern="nee"),), multi_match=True, max_chunks=2))
    assert sorted((r.direction, r.start_off) for r in run.matches.filter("proto = 'TCP'").collect()) == [("CTS", 6), ("CTS", 10)]
    assert inspect(decoded(spark), InspectSpec(rules=(Rule(1, pattern="needle"),), max_chunks=1)).matches.filter("proto = 'TCP'").count() == 0
    both = inspect(decoded(spark), InspectSpec(rules=(Rule(1, pattern="needle"),), extract=True, post_packets=1))
    assert {r.pkt_no for r in both.extracted().filter("proto = 'TCP'").collect()} == set(range(1, 11))


def test_datagram_matches_are_numbered(spark):
    run = inspect(decoded(spark, [*conversation(), udp((b"\x0a\0\0\x08", 9000), (b"\x0a\0\0\x07", 53), b"last needle")]),
                  InspectSpec(rules=(Rule(1, pattern="needle"),)))
    udp_rows = run.matches.filter("proto = 'UDP'").orderBy("found_at").collect()
    assert [(r.direction, r.match_no) for r in udp_rows] == [("CTS", 1), ("STC", 1), ("CTS", 2)]
