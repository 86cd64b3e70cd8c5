"""A whole inspection: packets and options in, matches, summary and extracts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.functions import text
from wiresift.functions.headers import TCP, UDP, decode_packets
from wiresift.operators import annotate, assembly, extract, flows, scope, summary
from wiresift.operators.datagrams import inspect_datagrams
from wiresift.operators.scan import Running, block_of, block_rows, numbered, running
from wiresift.operators.streams import inspect_streams, line_mode
from wiresift.session import cut
from wiresift.sources import sinks
from wiresift.spec import InspectSpec, normalise

FLOW = ["flow_id"]
STREAM = ["flow_id", "direction"]
MATCHES = ["proto", "flow_id", "direction", "chunk_no", "match_no", "rule_id", "mode", "start_off", "end_off", "size",
           "detail", "found_at", "match_pkt"]


@dataclass(frozen=True)
class Inspection:
    """Results of one run, all lazy.

    ``packets`` holds the numbered packets of all flows, headers only;
    ``chunks`` the delivered TCP stream pieces, and ``datagrams`` the inspected
    UDP payloads. ``rows`` is the block size of packet numbers.
    """

    spec: InspectSpec
    packets: DataFrame
    chunks: DataFrame
    flow_table: DataFrame
    matches: DataFrame
    datagrams: DataFrame
    rows: int | None

    def summary(self) -> DataFrame:
        """Inspected datagrams and completed handshakes, matched ones, shortest and longest."""
        tcp = _ready(self.flow_table, self.spec).select("proto")
        udp = self.packets.filter(F.col("proto") == "UDP")
        udp = scope.limit_datagrams(udp, self.spec.max_datagrams).select("proto")
        numbers = self.matches.limit(0) if self.spec.linemode else self.matches
        return summary.summary(tcp.unionByName(udp), numbers, ["found_at", "match_no"], "flow_id")

    def with_packet_span(self) -> DataFrame:
        """TCP matches with the first and last packet they touch."""
        ranges = self.chunks.select("pkt_seq", *STREAM, "start_off", "end_off").join(
            self.packets.select("pkt_seq", "pkt_no"), "pkt_seq")
        tcp = self.matches.filter(F.col("proto") == "TCP")
        return annotate.packet_span(tcp, ranges, STREAM, [*STREAM, "match_no"])

    def matched_bytes(self) -> DataFrame:
        """Bytes of TCP matches, one row per piece of the stream."""
        tcp = self.matches.filter(F.col("proto") == "TCP")
        return annotate.match_pieces(tcp, self.chunks, STREAM, [*STREAM, "match_no"])

    def displayed(self) -> DataFrame:
        """The displayed matches in the forms that ``output_modes`` asks for.

        (proto, flow_id, direction, match_no, found_at, piece_off), and for each mode:
        ``quiet`` the one line, ``meta`` the two lines, ``hex``, ``print`` and ``raw`` the
        bytes. With ``max_disp_bytes``, a match is one row with so many bytes at most.
        Without it a match may be as long as its stream, so it has a row for each piece
        of the stream, from which its bytes begin at ``piece_off``.
        """
        match = ["proto", *STREAM, "match_no"]
        most = self.spec.max_disp_bytes
        lines = self._report()
        pieces = self._pieces()
        if most:
            near = pieces.filter(F.col("piece_off") < most).withColumn(
                "data", F.substring("data", F.lit(1), (F.lit(most) - F.col("piece_off")).cast("int")))
            joined = near.groupBy(*match).agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_off", "data"))),
                                         lambda p: F.hex(p["data"])), "").alias("_hex"))
            pieces = joined.select(*match, F.lit(0).cast("bigint").alias("piece_off"), F.unhex("_hex").alias("data"))
        shown = lines.join(pieces, match, "left")
        forms = {"quiet": F.col("quiet"), "meta": F.array("line1", "line2"),
                 **{m: text.rendered(F.col("data"), m) for m in ("hex", "print", "raw")}}
        if not {"hex", "print", "raw"} & set(self.spec.output_modes):
            shown = lines.withColumn("piece_off", F.lit(0).cast("bigint"))
        return shown.select(*match, "found_at", F.coalesce("piece_off", F.lit(0).cast("bigint")).alias("piece_off"),
                            *(forms[m].alias(m) for m in self.spec.output_modes))

    def report(self) -> DataFrame:
        """The two report lines of each match: (proto, flow_id, direction, match_no, found_at, line1, line2).

        Counters run over what was inspected, chunk by chunk and datagram by
        datagram; the chunks of a stream count up to its first match, unless all are
        sought. Display limits hold back later matches.
        """
        return self._report().drop("quiet")

    def _report(self) -> DataFrame:
        flow = self.flow_table.select(
            "proto", F.col("open_seq").alias("flow_id"), "flow_no", "proto_no", "client", "cport", "server", "sport")
        order = ["found_at", "start_off"]
        block = block_of(F.col("found_at"), self.rows)
        tcp = self.with_packet_span().withColumnRenamed("start_off", "match_start")
        chunks = self.chunks.select(*STREAM, "chunk_no", "start_off", F.col("delivered_at").alias("found_at"))
        if not (self.spec.multi_match or self.spec.linemode):
            until = tcp.select("flow_id", F.col("chunk_no").alias("_until"))
            chunks = chunks.join(until, "flow_id", "left").where("_until IS NULL OR chunk_no <= _until").drop("_until")
        seen = chunks.join(tcp.drop("found_at", "direction"), ["flow_id", "chunk_no"], "left")
        seen = annotate.match_counters(seen, order, block, F.col("match_no").isNotNull())
        udp = self.matches.filter(F.col("proto") == "UDP").withColumnRenamed("start_off", "match_start")
        grams = self.datagrams.select(F.col("pkt_seq").alias("found_at"), *STREAM, F.lit(0).alias("start_off"))
        grams = grams.join(udp.drop("flow_id", "direction"), "found_at", "left")
        grams = annotate.match_counters(grams, order, block, F.col("match_no").isNotNull())
        columns = ["proto", *STREAM, "match_no", "found_at", "rule_id", "mode", "detail", "match_start", "end_off",
                   "size", "inspected", "matched_so_far"]
        none = F.lit(None).cast("bigint")
        both = seen.filter(F.col("proto").isNotNull()).select(*columns, "first_pkt", "last_pkt").unionByName(
            grams.filter(F.col("proto").isNotNull()).select(*columns, none.alias("first_pkt"), none.alias("last_pkt")))
        if self.spec.rules:
            both = annotate.with_rule_meta(both, self.spec.rules)
        else:
            both = both.withColumns({c: F.lit("") for c in ("pattern", "rule_name", "source_file")})
        shown = annotate.shown_matches(both, self.spec, ["found_at"]).join(flow, ["proto", "flow_id"])
        what = text.describe(F.col("mode"), F.col("pattern"), F.col("detail"), F.col("match_start"), F.col("rule_name"),
                             F.col("source_file"), self.spec.invert)

        def lines(first: Column | None, last: Column | None) -> Column:
            reply = (F.col("proto") == "UDP") & (F.col("direction") == "STC")
            ends = [F.when(reply, b).otherwise(a) for a, b in (
                (F.col("client"), F.col("server")), (F.col("cport"), F.col("sport")),
                (F.col("server"), F.col("client")), (F.col("sport"), F.col("cport")))]
            return text.meta_lines(
                F.col("inspected"), F.col("matched_so_far"), F.col("flow_no"), F.col("proto"), F.col("proto_no"), ends[0],
                ends[1], F.col("direction"), ends[2], ends[3], what, F.col("match_start"), F.col("end_off"), F.col("size"),
                first, last)

        made = F.when(F.col("first_pkt").isNull(), lines(None, None)).otherwise(lines(F.col("first_pkt"), F.col("last_pkt")))
        quiet = text.quiet_line(F.col("pattern"), F.col("match_start"), F.col("end_off"), F.col("size"))
        return shown.withColumn("_lines", made).select(
            "proto", *STREAM, "match_no", "found_at", F.get("_lines", F.lit(0)).alias("line1"),
            F.get("_lines", F.lit(1)).alias("line2"), quiet.alias("quiet"))

    def _pieces(self) -> DataFrame:
        """(proto, flow_id, direction, match_no, piece_off, data) of all matches."""
        tcp = self.matched_bytes().withColumn("proto", F.lit("TCP"))
        grams = self.datagrams.select(F.col("pkt_seq").alias("found_at"), "payload")
        udp = self.matches.filter(F.col("proto") == "UDP").join(grams, "found_at").select(
            *STREAM, "match_no", F.lit(0).cast("bigint").alias("piece_off"),
            F.substring("payload", (F.col("start_off") + 1).cast("int"), F.col("size").cast("int")).alias("data"),
            F.lit("UDP").alias("proto"))
        return tcp.unionByName(udp)

    def payloads(self) -> DataFrame:
        """Matched bytes per flow direction, in parts: (proto, flow_id, direction, part_no, content)."""
        return sinks.payload_log(self._pieces(), ["proto", *STREAM], ["match_no", "piece_off"],
                                 block_of(F.col("match_no"), self.rows))

    def captures(self, raw: DataFrame) -> DataFrame:
        """Capture files of the extracted packets of ``raw`` (pkt_seq, ts, pkt): (file_name, part_no, content)."""
        flow = self.flow_table.select(
            "proto", F.col("open_seq").alias("flow_id"), text.file_name(
                F.col("proto"), F.col("proto_no"), F.col("client"), F.col("cport"), F.col("server"),
                F.col("sport")).alias("file_name"))
        kept = self.extracted().select("proto", *FLOW, "pkt_seq").join(flow, ["proto", *FLOW])
        images = kept.join(raw.select("pkt_seq", "ts", "pkt"), "pkt_seq")
        return sinks.flow_captures(images.select("file_name", "pkt_seq", "ts", "pkt"), block_of(F.col("pkt_seq"), self.rows))

    def extracted(self) -> DataFrame:
        """Packets of matched flows, whole or up to the quota after a match."""
        post = self.spec.post_packets
        if self.spec.linemode:
            return extract.flows_with_data(self.packets, FLOW)
        if self.spec.extract or post is None:
            return extract.extract_all(self.packets, self.matches, FLOW)
        tcp = self.packets.filter(F.col("proto") == "TCP")
        udp = self.packets.filter(F.col("proto") == "UDP")
        found = self.matches.select("proto", *FLOW, "match_pkt")
        first = extract.extract_post(tcp, found.filter(F.col("proto") == "TCP"), FLOW, post)
        again = extract.extract_windows(udp, found.filter(F.col("proto") == "UDP"), FLOW, post)
        return first.withColumn("extract_no", F.lit(1).cast("bigint")).unionByName(again)


def inspect(packets: DataFrame, spec: InspectSpec, idle_seconds: float | None = None) -> Inspection:
    """Inspect decoded packets (``packets_of`` raw ones with ``pkt_seq`` and ``ts``).

    Flow ids are the ``pkt_seq`` of a flow's first packet. The packets are read
    several times, headers and payloads apart, so give it a stored table rather
    than raw captures.
    """
    spec = normalise(spec)
    packets = packets.drop("pkt").withColumn("len", F.octet_length("payload"))
    rows = block_rows(packets)
    bytes_ = packets.select("pkt_seq", "payload")
    tcp = packets.filter(F.col("proto") == TCP).drop("payload")
    udp = packets.filter(F.col("proto") == UDP).drop("payload")

    placed = flows.tracked(flows.tcp_packets(tcp, idle_seconds, rows))
    server_syn = F.when((F.col("direction") == "STC") & F.col("flags").contains("S"), F.struct("pkt_seq", "seq"))
    index = cut(running(placed, flows.FLOW, ["pkt_seq"], block_of(F.col("pkt_seq"), rows), [
        Running("pkt_no", "sum", F.lit(1)), Running("server_syn", "min", server_syn)]))
    tcp_table = flows.tcp_flow_table(index, idle_seconds)
    pairs = cut(flows.number_packets(flows.udp_packets(udp, rows), rows_per_block=rows))
    table = cut(flows.flow_ids(tcp_table.unionByName(flows.udp_flow_table(pairs)), rows))

    ready = _ready(table, spec)
    isn = F.when(F.col("direction") == "CTS", F.col("client_isn")).otherwise(F.col("server_syn.seq"))
    segments = index.join(ready.select("open_seq"), "open_seq", "left_semi").select(
        F.col("open_seq").alias("flow_id"), "direction", "pkt_seq", "seq", isn.alias("isn"),
        F.col("len").cast("bigint").alias("len")).filter(F.col("isn").isNotNull())
    ranges = cut(assembly.assemble(scope.needed_directions(segments, spec), rows_per_block=rows))
    # Read several times: searched, annotated and logged.
    delivered = assembly.with_payload(ranges, bytes_)
    chunks = cut(scope.limit_chunks(delivered, spec.max_chunks, ("delivered_at", "start_off")))

    numbers = index.select("pkt_seq", "pkt_no").unionByName(pairs.select("pkt_seq", "pkt_no"))
    datagrams = pairs.withColumn("flow_id", F.col("open_seq"))
    datagrams = scope.limit_datagrams(datagrams, spec.max_datagrams).join(bytes_, "pkt_seq")
    if spec.linemode:
        tcp_matches, udp_matches = _lines(chunks, datagrams)
    else:
        found = inspect_streams(chunks, spec)
        at = ranges.select("flow_id", "chunk_no", F.col("delivered_at").alias("found_at"))
        tcp_matches = found.join(at, ["flow_id", "chunk_no"])
        hits = inspect_datagrams(datagrams, spec, ["flow_id", "direction", "pkt_seq"]).withColumn("found_at", F.col("pkt_seq"))
        udp_matches = numbered(hits, STREAM, ["pkt_seq"], block_of(F.col("pkt_seq"), rows), "match_no")
    matches = tcp_matches.withColumn("proto", F.lit("TCP")).unionByName(
        udp_matches.withColumn("proto", F.lit("UDP")), allowMissingColumns=True)
    matches = matches.join(numbers.select(F.col("pkt_seq").alias("found_at"), F.col("pkt_no").alias("match_pkt")),
                           "found_at")
    common = ["pkt_seq", "ts", F.col("open_seq").alias("flow_id"), "direction", "pkt_no", "len", "src", "sport",
              "dst", "dport"]
    both = index.select(F.lit("TCP").alias("proto"), *common).unionByName(
        pairs.select(F.lit("UDP").alias("proto"), *common))
    return Inspection(spec, both, chunks, table, matches.select(*MATCHES), datagrams, rows)


def packets_of(raw: DataFrame) -> DataFrame:
    """Decoded packets of raw ones (pkt_seq, ts, pkt): fragments are merged first."""
    return decode_packets(assembly.whole_packets(raw))


def _ready(table: DataFrame, spec: InspectSpec) -> DataFrame:
    """TCP flows that are inspected: established ones, up to the limit in order of their start."""
    ready = table.filter((F.col("proto") == "TCP") & F.col("established"))
    return ready.orderBy("first_seq").limit(spec.max_streams) if spec.max_streams else ready


def _lines(chunks: DataFrame, datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line mode: every chunk and datagram as it comes."""
    none = {"rule_id": F.lit(None).cast("int"), "mode": F.lit("line"), "detail": F.lit(None).cast("string")}
    tcp = line_mode(chunks).withColumns({
        **none, "match_no": F.col("chunk_no") + 1, "found_at": F.col("delivered_at")})
    size = F.col("len").cast("bigint")
    udp = datagrams.withColumns({
        **none, "start_off": F.lit(0).cast("bigint"), "end_off": size, "size": size,
        "match_no": F.col("pkt_no"), "found_at": F.col("pkt_seq")})
    return tcp, udp
