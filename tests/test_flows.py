"""Flow construction against a plain state machine, whole and cut into small blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wiresift.operators import assembly, extract, flows
from wiresift.operators.scan import Running, block_of, running

HEADERS = ("pkt_seq long, ts timestamp, src string, sport int, dst string, dport int, "
           "flags string, seq long, len int")
START = dt.datetime(2024, 1, 1)


def packets(seed, n=300, gap=0):
    rng = random.Random(seed)
    rows, now = [], START
    for i in range(n):
        now += dt.timedelta(seconds=rng.choice([1, 1, 1, gap or 1]))
        ends = [("10.0.0.%d" % rng.randint(1, 3), 4000), ("10.9.0.1", 80)]
        if rng.random() < .45:
            ends.reverse()
        flags = rng.choice(["S", "PA", "PA", "PA", "A", "FA", "FA", "R", "SA", "PA"])
        rows.append((i, now, *ends[0], *ends[1], flags, i, rng.randint(0, 9)))
    return rows


def machine(rows, idle=None):
    """pkt_seq -> (open_seq, direction, closes)."""
    state, out = {}, {}
    for seq, ts, src, sport, dst, dport, flags, _, _ in rows:
        pair = tuple(sorted([(src, sport), (dst, dport)]))
        flow, last = state.get(pair, (None, None))
        if idle and last and (ts - last).total_seconds() > idle:
            flow = None
        if flow is None and flags == "S":
            flow = {"open": seq, "client": (src, sport), "fins": set()}
        if flow is None:
            out[seq] = (None, None, False)
        else:
            side = (src, sport) == flow["client"]
            if flags == "S":
                flow["fins"] = set()
            if "F" in flags:
                flow["fins"].add(side)
            closes = "R" in flags or len(flow["fins"]) == 2
            out[seq] = (flow["open"], "CTS" if side else "STC", closes)
            if closes:
                flow = None
        state[pair] = (flow, ts)
    return out


@pytest.mark.parametrize("seed,idle,block", [(1, None, None), (2, None, 16), (3, 60, None), (4, 60, 16)])
def test_tcp_flows(spark, seed, idle, block):
    rows = packets(seed, gap=100 if idle else 0)
    got = flows.tcp_packets(spark.createDataFrame(rows, HEADERS), idle, block).collect()
    assert {r.pkt_seq: (r.open_seq, r.direction, r.closes) for r in got} == machine(rows, idle)


def test_shuffled_input_gives_the_same_flows(spark):
    rows = packets(7)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    a = flows.tcp_packets(spark.createDataFrame(rows, HEADERS), None, 32).collect()
    b = flows.tcp_packets(spark.createDataFrame(mixed, HEADERS), None, 32).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_running_blocks_equal_plain_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randint(0, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    what = [Running("s", "sum", F.col("v"), False), Running("m", "max", F.col("v")),
            Running("n", "min", F.struct("v", "i"))]
    plain = running(df, ["k"], ["i"], None, what).collect()
    blocked = running(df, ["k"], ["i"], block_of(F.col("i"), 9), what).collect()
    assert sorted(map(str, plain)) == sorted(map(str, blocked))


UDP_CASES = [
    # sender port, receiver port of the first packet -> the sender is the client
    (5000, 53, True), (53, 5000, False), (5000, 6000, False), (53, 80, False), (1024, 1024, True),
    (1024, 1025, False), (1023, 1024, False),
]


@pytest.mark.parametrize("sport,dport,sender_is_key", UDP_CASES)
def test_udp_first_packet_fixes_the_client(spark, sport, dport, sender_is_key):
    a, b = ("1.1.1.1", sport), ("2.2.2.2", dport)
    rows = [(0, *a, *b, 5), (1, *b, *a, 7), (2, *a, *b, 9)]
    df = spark.createDataFrame(rows, "pkt_seq long, src string, sport int, dst string, dport int, len int")
    got = [r.direction for r in flows.udp_packets(df, 2).orderBy("pkt_seq").collect()]
    assert got == (["CTS", "STC", "CTS"] if sender_is_key else ["STC", "CTS", "STC"])
    table = flows.udp_flow_table(flows.udp_packets(df, None)).first()
    assert (table.cts_bytes, table.stc_bytes) == ((14, 7) if sender_is_key else (7, 14))


def deliver(segs):
    """In-order delivery: list of (pkt_seq, start, end) over arriving (pkt_seq, lo, hi)."""
    queue, edge, out = [], 0, []
    for no, lo, hi in segs:
        queue.append((lo, no, hi))
        while True:
            ready = sorted(q for q in queue if q[0] <= edge)
            queue = [q for q in queue if q[0] > edge]
            if not ready:
                break
            for lo_, no_, hi_ in ready:
                if hi_ > edge:
                    out.append((no_, edge, hi_))
                    edge = hi_
    return out


@pytest.mark.parametrize("isn", [100, 2**32 - 30])
@pytest.mark.parametrize("block", [None, 8])
def test_assembly(spark, isn, block):
    rng = random.Random(isn % 97)
    rows, want, seq = [], set(), 0
    for flow in range(5):
        cuts = sorted(rng.sample(range(1, 80), 8)) + [80]
        segs = [(a, b) for a, b in zip([0] + cuts, cuts)]
        if flow == 3:
            del segs[4]
        # Overlap to the right, copies, and arrival out of order.
        arriving = [(a, min(b + (3 if i % 3 == 0 else 0), 80)) for i, (a, b) in enumerate(segs)]
        arriving = [x for pair in zip(arriving[1::2], arriving[::2]) for x in pair] + arriving[len(arriving) // 2 * 2:]
        arriving += [arriving[0], arriving[2]]
        numbered = [(seq + i, a, b) for i, (a, b) in enumerate(arriving)]
        seq += len(arriving)
        rows += [(flow, "CTS", n, (isn + 1 + a) % 2**32, isn, b - a) for n, a, b in numbered]
        want |= {(flow, a, b) for _, a, b in deliver(numbered)}
    df = spark.createDataFrame(rows, "flow_id long, direction string, pkt_seq long, seq long, isn long, len long")
    size = assembly.BYTES_PER_BLOCK if block is None else 16
    got = assembly.assemble(df, size, block).collect()
    assert {(r.flow_id, r.start_off, r.end_off) for r in got} == want
    for flow in range(5):
        mine = sorted((r.chunk_no, r.start_off) for r in got if r.flow_id == flow)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [s for _, s in mine] == sorted(s for _, s in mine)


@pytest.mark.parametrize("block", [None, 8])
def test_partial_retransmissions(spark, block):
    """Overlaps to either side and around; each byte comes from what delivered it first."""
    rng = random.Random(5)
    rows, want, seq = [], set(), 0
    for flow in range(12):
        cuts = [0, *sorted(rng.sample(range(1, 80), 9)), 80]
        segs = list(zip(cuts, cuts[1:], strict=False))
        if flow == 0:
            segs = [(0, 30), (30, 60), (15, 45), (60, 80)]
        else:
            for _ in range(flow):
                a = rng.randrange(79)
                segs.insert(rng.randrange(len(segs)), (a, rng.randint(a + 1, 80)))
            for _ in range(flow // 2):
                i, j = rng.randrange(len(segs)), rng.randrange(len(segs))
                segs[i], segs[j] = segs[j], segs[i]
        numbered = [(seq + i, a, b) for i, (a, b) in enumerate(segs)]
        seq += len(segs)
        rows += [(flow, "CTS", n, 101 + a, 100, b - a) for n, a, b in numbered]
        want |= {(flow, no, a, b) for no, a, b in deliver(numbered)}
    df = spark.createDataFrame(rows, "flow_id long, direction string, pkt_seq long, seq long, isn long, len long")
    got = assembly.assemble(df, assembly.BYTES_PER_BLOCK if block is None else 16, block).collect()
    assert {(r.flow_id, r.pkt_seq, r.start_off, r.end_off) for r in got} == want
    assert [(r.pkt_seq, r.delivered_at) for r in sorted(got, key=lambda r: r.start_off) if r.flow_id == 0] == [(0, 0), (1, 1), (3, 3)]


def test_sequence_numbers_wrap_many_times(spark, monkeypatch):
    monkeypatch.setattr(assembly, "HALF", 1 << 7)
    monkeypatch.setattr(assembly, "FULL", 1 << 8)
    isn, size = 250, 25
    rows = [(1, "CTS", i ^ 1, (isn + 1 + i * size) % 256, isn, size) for i in range(20)]
    df = spark.createDataFrame(rows, "flow_id long, direction string, pkt_seq long, seq long, isn long, len long")
    got = assembly.assemble(df, 100, 4).orderBy("start_off").collect()
    assert [(r.start_off, r.end_off) for r in got] == [(i * size, (i + 1) * size) for i in range(20)]


def test_fragments(spark):
    rows = [
        ("a", "b", 17, 1, 0, START, 0, 1, b"abcdefgh"), ("a", "b", 17, 1, 1, START, 8, 0, b"ij"),
        ("a", "b", 17, 2, 2, START, 8, 0, b"zz"),
        ("a", "b", 17, 3, 3, START, 0, 0, b"whole"),
        ("a", "b", 17, 1, 4, START + dt.timedelta(minutes=5), 8, 0, b"90"),
        ("a", "b", 17, 1, 5, START + dt.timedelta(minutes=5), 0, 1, b"12345678"),
        ("a", "b", 17, 1, 6, START + dt.timedelta(minutes=5), 0, 1, b"12345678"),
    ]
    df = spark.createDataFrame(rows, "src string, dst string, proto int, ip_id int, pkt_seq long, ts timestamp, "
                                     "frag_off int, more_frags int, payload binary")
    got = sorted(bytes(r.payload) for r in assembly.defragment(df).collect())
    assert got == [b"1234567890", b"abcdefghij", b"whole"]


def test_fragment_ids_used_again_at_once(spark):
    rows = []
    for n in range(6):
        parts = [(0, 1, b"%08d" % n), (8, 1, b"abcdefgh"), (16, 0, b"end")]
        if n % 2:
            parts.reverse()
        rows += [("a", "b", 17, 1, 10 * n + i, START, *p) for i, p in enumerate(parts)]
        rows.append(("a", "b", 17, 2, 10 * n + 9, START, 0, 1, b"%08d" % n))  # never complete
    df = spark.createDataFrame(rows, "src string, dst string, proto int, ip_id int, pkt_seq long, ts timestamp, "
                                     "frag_off int, more_frags int, payload binary")
    got = {r.pkt_seq: (bytes(r.payload), r.ts) for r in assembly.defragment(df).collect()}
    assert got == {10 * n: (b"%08dabcdefghend" % n, START) for n in range(6)}


@pytest.mark.parametrize("block", [None, 7])
def test_one_fragment_id_used_throughout(spark, block):
    """One id for thousands of datagrams: silence and completeness tell them apart, in stretches of their own."""
    rng, rows, want, seq, at = random.Random(9), [], [], 0, START
    for n in range(120):
        pieces = [b"%04d" % n + bytes([65 + i]) * 4 for i in range(rng.randint(2, 4))]
        parts = [(8 * i, int(i < len(pieces) - 1), p) for i, p in enumerate(pieces)]
        rng.shuffle(parts)
        whole = n % 4 != 3
        if not whole:
            parts = parts[1:]  # given up after the silence that follows
        for part in parts + parts[:1] * (n % 5 == 1 and len(parts) > 2 and parts[0] in parts[1:]):
            rows.append(("a", "b", 17, 1, seq, at, *part))
            seq += 1
        if whole:
            want.append(b"".join(pieces))
        at += dt.timedelta(seconds=1 if whole else 45)
    df = spark.createDataFrame(rows, "src string, dst string, proto int, ip_id int, pkt_seq long, ts timestamp, "
                                     "frag_off int, more_frags int, payload binary")
    got = assembly.defragment(df, rows_per_block=block).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted(want)
    assert assembly._uses(df, 30.0, block).select("_stretch").distinct().count() == 30


def windows(n, hits, post):
    """Packet numbers 1..n -> extract number, collecting anew after each quota."""
    out, pending, number, cut = {}, [], 1, None
    for no in range(1, n + 1):
        if cut is not None and no > cut:
            out.update(dict.fromkeys(pending, number))
            pending, number, cut = [], number + 1, None
        pending.append(no)
        if no in hits:
            cut = no + post
    if cut is not None:
        out.update(dict.fromkeys(pending, number))
    return out


@pytest.mark.parametrize("hits", [{3}, {3, 5}, {3, 9, 20}, {2, 4, 6, 15}, {30}])
@pytest.mark.parametrize("block", [None, 4])
def test_extract_windows(spark, hits, block):
    pk = spark.createDataFrame([("f", i) for i in range(1, 31)], "flow string, pkt_no long")
    m = spark.createDataFrame([("f", i) for i in hits], "flow string, match_pkt long")
    got = extract.extract_windows(pk, m, ["flow"], 3, block).collect()
    assert {r.pkt_no: r.extract_no for r in got} == windows(30, hits, 3)


def test_extract_post(spark):
    pk = spark.createDataFrame([("f", i) for i in range(1, 31)], "flow string, pkt_no long")
    m = spark.createDataFrame([("f", 4)], "flow string, match_pkt long")
    assert extract.extract_post(pk, m, ["flow"]).count() == 9
    assert extract.extract_all(pk, m, ["flow"]).count() == 30
