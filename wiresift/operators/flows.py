"""Bidirectional flows from packet headers.

Packets carry ``pkt_seq`` (arrival order, dense), src, dst, sport, dport and
``len`` (payload bytes); TCP packets also ``flags`` and ``seq``. Only headers
travel here; payloads are fetched by ``pkt_seq`` where they are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.operators.scan import PACKETS_PER_BLOCK, Running, block_of, numbered, running
from wiresift.session import cut

# Fixed value: ports up to here count as well known.
LOW_PORT = 1024
FLOW = ["pair", "open_seq"]


def with_pair(packets: DataFrame) -> DataFrame:
    """Add ``pair``, the same for both directions, and ``from_a`` (sent by its first endpoint)."""
    sender = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    receiver = F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    return packets.withColumns({
        "pair": F.struct(F.least(sender, receiver).alias("a"), F.greatest(sender, receiver).alias("b")),
        "from_a": sender <= receiver,
    })


def _side(first: Column, field: str) -> Column:
    return F.when(first, F.col(f"pair.a.{field}")).otherwise(F.col(f"pair.b.{field}"))


def idle_gaps(packets: DataFrame, idle_seconds: float,
              rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Packets of a pair that come more than ``idle_seconds`` after the one before."""
    last = running(packets, ["pair"], ["pkt_seq"], block_of(F.col("pkt_seq"), rows_per_block),
                   [Running("_last_ts", "max", F.col("ts"), inclusive=False)])
    gap = F.col("ts").cast("double") - F.col("_last_ts").cast("double")
    return last.filter(gap > idle_seconds).drop("_last_ts")


def flow_marks(packets: DataFrame, idle_seconds: float | None = None,
               rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Where flows open and close: rows (pair, pkt_seq, kind), a few per flow.

    A flow opens with a packet whose flags are exactly ``S`` while none is open
    on the pair; it closes with a reset, with the second side's FIN since the
    latest SYN, or before a packet that follows a long silence.
    """
    block = block_of(F.col("pkt_seq"), rows_per_block)
    syn, fin, rst = F.col("flags") == "S", F.col("flags").contains("F"), F.col("flags").contains("R")
    fields = ["pair", "pkt_seq", "from_a", "flags", "seq"]
    control = packets.filter(syn | fin | rst).select(*fields, F.lit(False).alias("gap"))
    if idle_seconds is not None:
        gaps = idle_gaps(packets, idle_seconds, rows_per_block).select("pkt_seq", F.lit(True).alias("gap"))
        quiet = packets.join(gaps, "pkt_seq").select(*fields, "gap")
        control = control.join(gaps, "pkt_seq", "left_anti").select(*fields, "gap").unionByName(quiet)
    seq = F.col("pkt_seq")
    seen = running(control, ["pair"], ["pkt_seq"], block, [
        Running("last_syn", "max", F.when(syn, seq), inclusive=False),
        Running("fin_a", "max", F.when(fin & F.col("from_a"), seq), inclusive=False),
        Running("fin_b", "max", F.when(fin & ~F.col("from_a"), seq), inclusive=False),
    ])
    other_fin = F.when(F.col("from_a"), F.col("fin_b")).otherwise(F.col("fin_a"))
    closes = F.coalesce(rst | (fin & (other_fin > F.col("last_syn"))), F.lit(False))
    closing = seen.withColumn("closes", closes)
    # Doubled positions leave room for "just before this packet".
    ended = running(closing, ["pair"], ["pkt_seq"], block, [
        Running("end_at", "max", F.when(F.col("closes"), seq * 2), inclusive=False),
        Running("gap_at", "max", F.when(F.col("gap"), seq * 2 - 1)),
    ])
    dead = F.greatest("end_at", "gap_at")
    opens = syn & F.coalesce(
        F.col("last_syn").isNull() | (dead > F.col("last_syn") * 2), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(F.col("gap"), F.lit("gap")), F.when(opens, F.lit("open")),
        F.when(F.col("closes"), F.lit("close"))))
    return ended.select("pair", "pkt_seq", "from_a", "seq", F.explode(kinds).alias("kind"))


def tcp_packets(packets: DataFrame, idle_seconds: float | None = None,
                rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Packets with their flow: ``open_seq`` (null if untracked), ``direction``, ``closes``."""
    packets = with_pair(packets)
    marks = cut(flow_marks(packets, idle_seconds, rows_per_block))
    # A mark counts from just before its packet, except a close: just after.
    kind = F.col("kind")
    before = marks.select(
        "pair", "pkt_seq", F.lit(0).alias("_tag"),
        F.when(kind == "open", F.struct("pkt_seq", "from_a", "seq")).alias("_open"),
        F.when(kind == "gap", F.col("pkt_seq") * 2 - 1).alias("_end"),
        F.when(kind == "close", F.col("pkt_seq")).alias("_closer"))
    after = marks.filter(kind == "close").select(
        "pair", "pkt_seq", F.lit(2).alias("_tag"), (F.col("pkt_seq") * 2).alias("_end"))
    mark_rows = before.unionByName(after, allowMissingColumns=True)
    rows = packets.withColumn("_tag", F.lit(1)).unionByName(mark_rows, allowMissingColumns=True)
    placed = running(rows, ["pair"], ["pkt_seq", "_tag"], block_of(F.col("pkt_seq"), rows_per_block), [
        Running("opened", "max", F.col("_open")), Running("ended", "max", F.col("_end")),
        Running("closer", "max", F.col("_closer"))])
    alive = F.col("opened").isNotNull() & (
        F.coalesce(F.col("ended"), F.lit(-1)) < F.col("opened.pkt_seq") * 2)
    return placed.filter(F.col("_tag") == 1).select(
        *packets.columns,
        F.when(alive, F.col("opened.pkt_seq")).alias("open_seq"),
        F.when(alive, F.when(F.col("from_a") == F.col("opened.from_a"), "CTS").otherwise("STC"))
        .alias("direction"),
        F.when(alive, F.col("opened.seq")).alias("client_isn"),
        F.coalesce(alive & (F.col("closer") == F.col("pkt_seq")), F.lit(False)).alias("closes"))


def tracked(packets: DataFrame) -> DataFrame:
    """Only packets of flows whose opening SYN was seen."""
    return packets.filter(F.col("open_seq").isNotNull())


def number_packets(packets: DataFrame, keys: list[str] = FLOW,
                   rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """1-based packet numbers within a flow, both directions counted together."""
    return numbered(packets, keys, ["pkt_seq"], block_of(F.col("pkt_seq"), rows_per_block), "pkt_no")


def flow_index(packets: DataFrame, rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Numbered packets of tracked TCP flows, headers only, written once.

    Payloads are fetched from the packet table by ``pkt_seq``.
    """
    headers = packets.drop("payload", "pkt")
    return cut(number_packets(tracked(tcp_packets(headers, None, rows_per_block)),
                              rows_per_block=rows_per_block))


def packet_lengths(numbered_packets: DataFrame, direction: str, keys: list[str] = FLOW) -> DataFrame:
    """(packet number, payload length) rows of one direction."""
    return numbered_packets.filter(F.col("direction") == direction).select(*keys, "pkt_no", "len")


def byte_totals() -> list[Column]:
    """Aggregates for the bytes of each direction."""
    return [
        F.sum(F.when(F.col("direction") == "CTS", F.col("len")).otherwise(0)).cast("bigint").alias("cts_bytes"),
        F.sum(F.when(F.col("direction") == "STC", F.col("len")).otherwise(0)).cast("bigint").alias("stc_bytes"),
        F.sum("len").cast("bigint").alias("tot_bytes"),
    ]


def tcp_flow_table(packets: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """One row per TCP flow, from tracked packets.

    ``established`` means that a client packet with A followed the server's
    SYN-ACK. With ``idle_seconds``, flows silent that long before the end of
    the capture count as timed out.
    """
    rst, syn = F.col("flags").contains("R"), F.col("flags").contains("S")
    cts, stc = F.col("direction") == "CTS", F.col("direction") == "STC"
    ack = F.col("flags").contains("A")
    grouped = packets.groupBy(*FLOW).agg(
        F.min("pkt_seq").alias("first_seq"),
        F.first(F.when(cts, F.col("from_a")), ignorenulls=True).alias("client_a"),
        *byte_totals(),
        F.count(F.lit(1)).alias("packets"),
        F.max(rst & F.col("closes")).alias("_rst"),
        F.max("closes").alias("_fin"),
        F.coalesce(F.min(F.when(stc & syn & ack, F.col("pkt_seq")))
                   < F.max(F.when(cts & ack, F.col("pkt_seq"))), F.lit(False)).alias("established"),
        *([F.max("ts").alias("last_ts")] if idle_seconds is not None else []),
    )
    state = F.when(F.col("_rst"), "RST").when(F.col("_fin"), "FIN")
    if idle_seconds is not None:
        end = packets.agg(F.max("ts")).first()[0]
        silent = F.lit(end).cast("double") - F.col("last_ts").cast("double")
        state = state.when(silent > idle_seconds, "TIMED_OUT")
    return grouped.select(
        F.lit("TCP").alias("proto"), *FLOW, "first_seq",
        _side(F.col("client_a"), "ip").alias("client"), _side(F.col("client_a"), "port").alias("cport"),
        _side(~F.col("client_a"), "ip").alias("server"), _side(~F.col("client_a"), "port").alias("sport"),
        "cts_bytes", "stc_bytes", "tot_bytes", "packets", "established",
        state.otherwise("OPEN").alias("end_state"))


def udp_key_is_sender() -> Column:
    """Port rule: the sender is the keyed endpoint when it talks to a low port from a high one."""
    return (F.col("dport") <= LOW_PORT) & (F.col("sport") >= LOW_PORT)


def udp_packets(packets: DataFrame, rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Packets with ``direction`` and ``open_seq``; a pair's first packet fixes its keyed endpoint."""
    packets = with_pair(packets)
    key_a = F.col("from_a") == udp_key_is_sender()
    first = F.struct(F.col("pkt_seq"), key_a.alias("key_a"))
    placed = running(packets, ["pair"], ["pkt_seq"], block_of(F.col("pkt_seq"), rows_per_block),
                     [Running("opened", "min", first)])
    return placed.select(
        *packets.columns,
        F.col("opened.pkt_seq").alias("open_seq"),
        F.col("opened.key_a").alias("key_a"),
        F.when(F.col("from_a") == F.col("opened.key_a"), "CTS").otherwise("STC").alias("direction"))


def udp_flow_table(packets: DataFrame) -> DataFrame:
    """One row per UDP pair, from :func:`udp_packets`."""
    grouped = packets.groupBy(*FLOW, "key_a").agg(*byte_totals(), F.count(F.lit(1)).alias("packets"))
    return grouped.select(
        F.lit("UDP").alias("proto"), *FLOW, F.col("open_seq").alias("first_seq"),
        _side(F.col("key_a"), "ip").alias("client"), _side(F.col("key_a"), "port").alias("cport"),
        _side(~F.col("key_a"), "ip").alias("server"), _side(~F.col("key_a"), "port").alias("sport"),
        "cts_bytes", "stc_bytes", "tot_bytes", "packets", F.lit(True).alias("established"),
        F.lit("OPEN").alias("end_state"))


def udp_epochs(packets: DataFrame, matched: Column,
               rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """``flow_epoch``: how often the pair's flow has restarted after a matching datagram."""
    return running(packets, ["pair"], ["pkt_seq"], block_of(F.col("pkt_seq"), rows_per_block),
                   [Running("flow_epoch", "sum", matched.cast("bigint"), inclusive=False)])


def flow_ids(flows: DataFrame, flows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """Ordinals by first packet: over all flows and within the protocol."""
    flows = cut(flows)
    block = block_of(F.col("first_seq"), flows_per_block)
    overall = numbered(flows, [], ["first_seq"], block, "flow_no")
    return numbered(overall, ["proto"], ["first_seq"], block, "proto_no")
