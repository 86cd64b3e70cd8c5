"""Headers, texts, rules on single buffers, options."""

import random
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.brute import ratio
from wiresift.functions import headers as H
from wiresift.functions import text as X
from wiresift.operators import scope as S
from wiresift.operators.datagrams import inspect_datagrams
from wiresift.operators.matchers import partial_ratio
from wiresift.spec import InspectSpec, Rule, context_free, normalise, widest_match


def one(spark, raw, *cols):
    return spark.createDataFrame([(bytearray(raw),)], "b binary").select(*cols).first()


def test_header_fields(spark):
    tcp = struct.pack("!HHLLBBHHH", 4000, 80, 2**32 - 5, 2**31, 0x50, 0x3F, 1024, 0xBEEF, 7)
    ip = struct.pack("!BBHHHBBH4s4s", 0x46, 3, 24 + 20 + 5, 777, 0x2001, 63, 6, 0, bytes([10, 0, 0, 255]),
                     bytes([192, 168, 1, 2])) + b"opts"
    df = spark.createDataFrame([(1, bytearray(ip + tcp + b"hello" + b"\0\0\0"))], "pkt_seq long, pkt binary")
    row = H.decode_packets(df).first()
    assert (row.src, row.dst, row.sport, row.dport) == ("10.0.0.255", "192.168.1.2", 4000, 80)
    assert (row.seq, row.ack, row.flags, row.window) == (2**32 - 5, 2**31, "FSRPAU", 1024)
    assert (row.ip_id, row.ttl, row.tos, bytes(row.payload)) == (777, 63, 3, b"hello")
    parts = df.select(H.decode_ip(F.col("pkt")).alias("ip")).first().ip
    assert (parts.version, parts.ihl, parts.more_frags, parts.frag_off) == (4, 24, 1, 8)


def test_other_protocols_are_dropped(spark):
    icmp = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28, 1, 0, 64, 1, 0, b"\x01" * 4, b"\x02" * 4) + b"\0" * 8
    df = spark.createDataFrame([(1, bytearray(icmp))], "pkt_seq long, pkt binary")
    assert H.decode_packets(df).count() == 0


HTTP_DUMP = [
    "00000000:  48 54 54 50 2f 31 2e 31 20 32 30 30 20 4f 4b 0d   |HTTP/1.1 200 OK.|",
    "00000010:  0a 44 61 74 65 3a 20 54 68 75 2c 20 31 33 20 4d   |.Date: Thu, 13 M|",
]


def test_hexdump(spark):
    raw = b"HTTP/1.1 200 OK\r\nDate: Thu, 13 M"
    assert one(spark, raw, X.hexdump(F.col("b")).alias("d")).d == HTTP_DUMP
    assert one(spark, b"", X.hexdump(F.col("b")).alias("d")).d == []
    assert one(spark, b"a\\~\xff'", X.hexdump(F.col("b")).alias("d")).d == [
        "00000000:  61 5c 7e ff 27" + " " * 34 + "  |a.~.'|"]


def test_printable_drops_tilde(spark):
    assert one(spark, b"a~\x00}\t\r\n\x7f\xe9 b", X.printable(F.col("b")).alias("p")).p == "a}\t\r\n b"


@pytest.mark.parametrize("size,spec,want", [
    (10, InspectSpec(offset=4), (4, 10)), (10, InspectSpec(offset=10), (0, 10)),
    (10, InspectSpec(offset=12, depth=3), (0, 3)), (10, InspectSpec(offset=4, depth=3), (4, 7)),
    (10, InspectSpec(offset=4, depth=60), (4, 10)), (10, InspectSpec(), (0, 10)), (0, InspectSpec(depth=4), (0, 0)),
])
def test_scope(spark, size, spec, want):
    text = "0123456789"[:size]
    row = spark.createDataFrame([(text,)], "t string").select(S.scope(F.col("t"), spec).alias("s")).first()
    assert row.s == text[want[0]:want[1]]


@settings(max_examples=25, deadline=None)
@given(st.text("abcd", max_size=200), st.text("abcd", min_size=1, max_size=9))
def test_partial_ratio(spark, text, pattern):
    row = spark.createDataFrame([(text,)], "t string").select(partial_ratio(F.col("t"), pattern).alias("r")).first()
    assert row.r == ratio(text, pattern)


def hits(spark, payload, rule, **opts):
    df = spark.createDataFrame([("STC", bytearray(payload))], "direction string, payload binary")
    rows = inspect_datagrams(df, InspectSpec(rules=(rule,), **opts), []).collect()
    return [(r.start_off, r.end_off) for r in rows]


def test_golden_vectors(spark):
    sip = (b"SIP/2.0 180 Ringing\r\nVia: SIP/2.0/UDP 10.0.1.45;received=10.0.1.199\r\n"
           b"Contact: <sip:127.0.0.1>\r\nTo: <sip:10.0.1.45>;tag=20d70673\r\n"
           b'From: "testtest"<sip:10.0.1.199>\r\nCall-ID: 14810.0.1.45\r\nCSeq: 1 INVITE\r\n'
           b"User-Agent: X-Lite release 1009r stamp 38964\r\nContent-Length: 0\r\n\r\n")
    assert len(sip) == 269
    assert hits(spark, sip, Rule(1, "fuzzy", "inite", threshold=50)) == [(0, 269)]
    assert hits(spark, b"q" * 146, Rule(1, pattern=".*")) == [(0, 146)]
    shell = b"\x90" * 4034 + bytes.fromhex("d9ebd97424f4") + b"z" * 310
    assert hits(spark, shell, Rule(1, "bytesig", "d9ebd97424f4")) == [(4034, 4350)]


def test_regex_bytes_and_lines(spark):
    assert hits(spark, b"\xc3\xa9\xff\x00ab", Rule(1, pattern="ab")) == [(4, 6)]
    assert hits(spark, b"a\rb", Rule(1, pattern="^b")) == []
    assert hits(spark, b"a\nb", Rule(1, pattern="^b")) == [(2, 3)]
    assert hits(spark, b"a\nb", Rule(1, pattern="^b", flags="")) == []
    assert hits(spark, b"a\nb", Rule(1, pattern="a.b", flags="")) == []
    assert hits(spark, b"xyz", Rule(1, pattern="q*")) == [(0, 0)]
    assert hits(spark, b"xyz", Rule(1, pattern="q*"), drop_empty=True) == []
    assert hits(spark, b"XyZ", Rule(1, pattern="xyz", flags="smi")) == [(0, 3)]


def test_directions_without_rules_do_not_match(spark):
    assert hits(spark, b"abc", Rule(1, pattern="q", direction="CTS"), invert=True) == []


def test_pattern_bounds():
    assert widest_match("ab(c|de){2,3}") == 8
    assert widest_match("a.*b") is None
    assert widest_match("^ab") is None and not context_free(r"\bab")
    assert context_free("a.*?b")


def test_option_conflicts():
    assert normalise(InspectSpec(offset=5, invert=True)) == InspectSpec(linemode=True)
    rules = (Rule(1, pattern="a"),)
    fast = normalise(InspectSpec(rules=rules, multi_match=True, post_packets=5))
    assert fast.post_packets is None and fast.extract
    assert normalise(InspectSpec(rules=rules, post_packets=5)).post_packets == 5


@pytest.mark.parametrize("bad", [
    {"mode": "yaml"}, {"direction": "UP"}, {"mode": "fuzzy", "pattern": "a", "threshold": 0},
    {"mode": "bytesig", "pattern": "xz"}, {"mode": "signature"}])
def test_bad_rules_are_rejected(bad):
    with pytest.raises(ValueError):
        Rule(1, **bad)


def test_display_filter_swaps_for_replies(spark):
    cols = [F.lit(x) for x in ("TCP", "1.1.1.1", 4000, "2.2.2.2", 80)]
    rows = spark.createDataFrame([("CTS",), ("STC",)], "d string").select(
        X.flow_filter(*cols, F.col("d")).alias("f")).collect()
    assert rows[0].f == "(ip.src == 1.1.1.1 and tcp.srcport == 4000) and (ip.dst == 2.2.2.2 and tcp.dstport == 80)"
    assert rows[1].f.startswith("(ip.src == 2.2.2.2 and tcp.srcport == 80)")


def test_ratios_over_bytes(spark):
    """Exact best ratios, with a threshold and without one, over any bytes."""
    rng = random.Random(12)
    for pattern in ("threating", "aab", "h\xe9lp me", "abcdefghijklmnopqrst"):
        rows = []
        for i in range(60):
            text = [rng.choice("abcdefgthrein \xe9\xff\n") for _ in range(rng.choice((0, 2, 8, 30, 200)))]
            if i % 3 == 0 and text:
                at = rng.randrange(len(text))
                text[at:at] = list(pattern)
                for _ in range(rng.randint(0, 4)):
                    text[rng.randrange(len(text))] = rng.choice("thx\xe9")
            rows.append((i, "".join(text)))
        df = spark.createDataFrame(rows, "i int, t string")
        found = df.select("i", partial_ratio(F.col("t"), pattern), partial_ratio(F.col("t"), pattern, 70)).collect()
        for i, exact, some in found:
            want = ratio(rows[i][1], pattern)
            assert exact == want and (some == want if want >= 70 else some is None or some < 70)
