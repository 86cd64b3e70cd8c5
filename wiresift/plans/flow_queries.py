"""Flow construction, stream assembly, extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions import headers as H
from wiresift.functions import text as X
from wiresift.operators import assembly, extract, flows, summary
from wiresift.operators.datagrams import inspect_datagrams
from wiresift.operators.scan import PACKETS_PER_BLOCK, block_of, block_rows
from wiresift.operators.streams import inspect_streams
from wiresift.plans.header_queries import encoded_tcp, encoded_udp
from wiresift.plans.registry import TCP_FLOW, UDP, UDP_ENDS, UDP_FLOW, query, tcp_flow
from wiresift.session import checkpoint_dir, cut
from wiresift.sources import capture, sinks
from wiresift.sources.capture_source import captured, growing_captures
from wiresift.streaming import online
from wiresift.sources import tables as T
from wiresift.spec import InspectSpec, Rule

ENDS = ["client", "cport", "server", "sport"]
IDLE_SECONDS = 36_000.0
SEVEN = Rule(1, pattern=r"\{.k.: 7[0-9]?\}")
SEVEN_SQL = r"""\{.k.: 7[0-9]?\}"""
POST = 5


def event_rows(spark: SparkSession, sf_dir: str) -> int | None:
    return block_rows(T.table(spark, sf_dir, "events"), "event_id")


def tracked_tcp(spark: SparkSession, sf_dir: str, idle: float | None = None) -> DataFrame:
    headers = T.tcp_headers(spark, sf_dir).drop("payload")
    return cut(flows.tracked(flows.tcp_packets(headers, idle, event_rows(spark, sf_dir))))


TCP_TABLE = """SELECT 'TCP' AS proto, open_seq, any_value(client) AS client, any_value(cport) AS cport,
  any_value(server) AS server, any_value(vport) AS sport,
  sum(CASE WHEN direction = 'CTS' THEN len ELSE 0 END) AS cts_bytes,
  sum(CASE WHEN direction = 'STC' THEN len ELSE 0 END) AS stc_bytes, sum(len) AS tot_bytes, count(*) AS packets,
  coalesce(min(CASE WHEN flags = 'SA' THEN pkt_seq END)
    < max(CASE WHEN direction = 'CTS' AND flags LIKE '%A%' THEN pkt_seq END), false) AS established,
  CASE WHEN bool_or(closes AND flags LIKE '%R%') THEN 'RST' WHEN bool_or(closes) THEN 'FIN' {idle}
    ELSE 'OPEN' END AS end_state, max(ts) AS last_ts
FROM tf WHERE open_seq IS NOT NULL GROUP BY open_seq"""


@query(f"""WITH {TCP_FLOW}, t AS ({TCP_TABLE.format(idle='')})
SELECT open_seq, client, cport, server, sport, cts_bytes, stc_bytes, tot_bytes, packets FROM t""")
def tcp_flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.tcp_flow_table(tracked_tcp(spark, sf_dir)).select(
        "open_seq", *ENDS, "cts_bytes", "stc_bytes", "tot_bytes", "packets")


@query(f"""WITH {tcp_flow(IDLE_SECONDS)}, t AS ({TCP_TABLE.format(
    idle=f"WHEN (SELECT max(epoch(ts)) FROM tf WHERE open_seq IS NOT NULL) - epoch(max(ts)) > {IDLE_SECONDS} THEN 'TIMED_OUT'")})
SELECT open_seq, packets, established, end_state FROM t""")
def flow_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = tracked_tcp(spark, sf_dir, IDLE_SECONDS)
    return flows.tcp_flow_table(packets, IDLE_SECONDS).select("open_seq", "packets", "established", "end_state")


@query(f"""WITH {TCP_FLOW} SELECT pkt_seq, open_seq, direction, len FROM tf WHERE open_seq IS NOT NULL""")
def tracked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked_tcp(spark, sf_dir).select("pkt_seq", "open_seq", "direction", "len")


@query(f"""WITH {TCP_FLOW}, {UDP_FLOW}, f AS (
  SELECT 'TCP' AS proto, open_seq, any_value(client) AS client FROM tf WHERE open_seq IS NOT NULL GROUP BY open_seq
  UNION ALL SELECT 'UDP', open_seq, any_value(CASE WHEN key_is_client THEN client ELSE server END)
  FROM udpf GROUP BY open_seq)
SELECT proto, client, open_seq + CASE proto WHEN 'UDP' THEN 1000000000 ELSE 0 END AS first_seq,
  row_number() OVER (ORDER BY open_seq + CASE proto WHEN 'UDP' THEN 1000000000 ELSE 0 END) AS flow_no,
  row_number() OVER (PARTITION BY proto ORDER BY open_seq) AS proto_no FROM f""")
def flow_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UDP view stands for a capture that follows the TCP one."""
    both = ["proto", "client", "first_seq"]
    tcp = flows.tcp_flow_table(tracked_tcp(spark, sf_dir)).select(*both)
    pairs = flows.udp_flow_table(udp(spark, sf_dir))
    later = pairs.withColumn("first_seq", F.col("first_seq") + 1_000_000_000).select(*both)
    return flows.flow_ids(tcp.unionByName(later))


@query(f"""WITH {TCP_FLOW} SELECT open_seq, pkt_seq, direction, len,
  row_number() OVER (PARTITION BY open_seq ORDER BY pkt_seq) AS pkt_no FROM tf WHERE open_seq IS NOT NULL""")
def packet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_tcp(spark, sf_dir).select(
        "open_seq", "pkt_seq", "direction", "len", "pkt_no")


@query(f"""WITH {TCP_FLOW}, n AS (SELECT *, row_number() OVER (PARTITION BY open_seq ORDER BY pkt_seq) AS pkt_no
  FROM tf WHERE open_seq IS NOT NULL)
SELECT open_seq, pkt_no, len FROM n WHERE direction = 'STC'""")
def packet_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbered_tcp(spark, sf_dir)
    return flows.packet_lengths(numbered, "STC", ["open_seq"])


def udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.udp_packets(T.udp_headers(spark, sf_dir), event_rows(spark, sf_dir))


@query(f"""WITH {UDP_FLOW} SELECT pkt_seq, src, sport, dst, dport, open_seq, direction FROM udpf""")
def udp_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udp(spark, sf_dir).select("pkt_seq", "src", "sport", "dst", "dport", "open_seq", "direction")


@query(f"""WITH {UDP_FLOW} SELECT open_seq,
  any_value(CASE WHEN key_is_client THEN client ELSE server END) AS client,
  any_value(CASE WHEN key_is_client THEN cport ELSE vport END) AS cport,
  any_value(CASE WHEN key_is_client THEN server ELSE client END) AS server,
  any_value(CASE WHEN key_is_client THEN vport ELSE cport END) AS sport,
  sum(CASE WHEN direction = 'CTS' THEN len ELSE 0 END) AS cts_bytes,
  sum(CASE WHEN direction = 'STC' THEN len ELSE 0 END) AS stc_bytes, sum(len) AS tot_bytes, count(*) AS packets
FROM udpf GROUP BY open_seq""")
def udp_flow_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.udp_flow_table(udp(spark, sf_dir)).select(
        "open_seq", *ENDS, "cts_bytes", "stc_bytes", "tot_bytes", "packets")


@query(f"""WITH {UDP_FLOW} SELECT pkt_seq, open_seq, coalesce(sum(CASE WHEN regexp_matches(props, '{SEVEN_SQL}')
  THEN 1 ELSE 0 END) OVER (PARTITION BY open_seq ORDER BY pkt_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS flow_epoch FROM udpf""")
def udp_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = F.decode("payload", "ISO-8859-1").rlike(SEVEN.pattern)
    packets = udp(spark, sf_dir).withColumn("matched", matched).drop("payload")
    return flows.udp_epochs(packets, F.col("matched"), event_rows(spark, sf_dir)).select("pkt_seq", "open_seq", "flow_epoch")


SEGMENT, OVERLAP, LOST_EVERY = 1000, 200, 7


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(T.documents(spark, sf_dir))


def segments_of(documents: DataFrame) -> DataFrame:
    """Documents cut into segments that overlap, repeat, arrive out of order and wrap.

    Every seventh document lacks its fourth segment.
    """
    size = F.octet_length("payload")
    docs = documents.filter(size > 0).withColumns({
        "flow_id": F.col("doc_id"), "n": size,
        "i": F.explode(F.sequence(F.lit(0), F.floor((size - 1) / SEGMENT).cast("int")))})
    copies = docs.withColumn("copy", F.explode(F.when(F.col("i") % 3 == 0, F.array(F.lit(0), F.lit(1)))
                                               .otherwise(F.array(F.lit(0)))))
    kept = copies.filter((F.col("doc_id") % LOST_EVERY != 0) | (F.col("i") != 3))
    isn = 4294967000 + F.col("doc_id") % 500
    payload = F.substring("payload", F.col("i") * SEGMENT + 1, F.lit(SEGMENT + OVERLAP))
    first = kept.select(
        "flow_id", "direction",
        (F.col("doc_id") * 65536 + (F.col("i") * 2 + F.col("copy")).bitwiseXOR(F.lit(2))).alias("pkt_seq"),
        ((isn + 1 + F.col("i") * SEGMENT) % 4294967296).alias("seq"), isn.alias("isn"),
        F.octet_length(payload).cast("bigint").alias("len"), payload.alias("payload"))
    # Long after, bytes of two neighbours are sent again in one segment.
    again = F.substring("payload", F.lit(SEGMENT // 2 + 1), F.lit(SEGMENT))
    late = docs.filter((F.col("i") == 0) & (F.col("n") > 2 * SEGMENT)).select(
        "flow_id", "direction", (F.col("doc_id") * 65536 + 65000).alias("pkt_seq"),
        ((isn + 1 + SEGMENT // 2) % 4294967296).alias("seq"), isn.alias("isn"),
        F.octet_length(again).cast("bigint").alias("len"), again.alias("payload"))
    return first.unionByName(late)


ASSEMBLED = f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
s AS (SELECT *, unnest(range(0, (n - 1) // {SEGMENT} + 1)) AS i FROM d),
r AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE i * {SEGMENT} + {OVERLAP} END AS start_off,
  least(i * {SEGMENT} + {SEGMENT + OVERLAP}, n) AS end_off FROM s)
SELECT doc_id AS flow_id, CASE WHEN doc_id % 2 = 0 THEN 'CTS' ELSE 'STC' END AS direction, i AS chunk_no,
  start_off, end_off, substr(h, 2 * start_off + 1, 2 * (end_off - start_off)) AS data
FROM r WHERE end_off > start_off AND (doc_id % {LOST_EVERY} <> 0 OR i < 3)"""


@query(ASSEMBLED)
def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = segments(spark, sf_dir)
    rows = block_rows(T.table(spark, sf_dir, "documents"), "doc_id", PACKETS_PER_BLOCK // 65536)
    ranges = assembly.assemble(packets.drop("payload"), rows_per_block=rows and PACKETS_PER_BLOCK)
    return assembly.with_payload(ranges, packets).select(
        "flow_id", "direction", "chunk_no", "start_off", "end_off", F.hex("payload").alias("data"))


FRAGMENT = 160


@query(f"""SELECT '10.' || ((conv_id // 65536) % 256) || '.' || ((conv_id // 256) % 256) || '.' || (conv_id % 256) AS src,
  CASE WHEN (conv_id + turn) % {LOST_EVERY} = 0 THEN 1000 + turn ELSE turn % 2 END AS ip_id, text FROM conversations
WHERE strlen(text) <= {FRAGMENT} OR (conv_id + turn) % {LOST_EVERY} <> 0""")
def defragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as fragmented datagrams in one second: ids are soon used again, some lack their last fragment."""
    size = F.octet_length("payload")
    turns = T.table(spark, sf_dir, "conversations").withColumn("payload", T.utf8("text"))
    last = F.greatest(F.floor((size - 1) / FRAGMENT).cast("int"), F.lit(0))
    cut = turns.withColumns({"last": last, "i": F.explode(F.sequence(F.lit(0), last))})
    lost = (F.col("i") == F.col("last")) & (F.col("i") > 0) & ((F.col("conv_id") + F.col("turn")) % LOST_EVERY == 0)
    packets = cut.filter(~lost).select(
        F.expr("concat('10.', (conv_id div 65536) % 256, '.', (conv_id div 256) % 256, '.', conv_id % 256)").alias("src"),
        F.lit(T.SERVER).alias("dst"), F.lit(H.UDP).alias("proto"),
        F.when((F.col("conv_id") + F.col("turn")) % LOST_EVERY == 0, F.col("turn") + 1000)
        .otherwise(F.col("turn") % 2).alias("ip_id"),
        (F.col("conv_id") * 65536 + F.col("turn") * 1024 + F.col("last") - F.col("i")).alias("pkt_seq"),
        F.timestamp_seconds(F.col("conv_id")).alias("ts"),
        (F.col("i") * FRAGMENT).alias("frag_off"),
        F.when(F.col("i") < F.col("last"), 1).otherwise(0).alias("more_frags"),
        F.substring("payload", F.col("i") * FRAGMENT + 1, F.lit(FRAGMENT)).alias("payload"))
    return assembly.defragment(packets).select("src", "ip_id", F.decode("payload", "UTF-8").alias("text"))


@query(f"""WITH {TCP_FLOW}, t AS ({TCP_TABLE.format(idle='')})
SELECT open_seq, client, cport, server, sport, cts_bytes, stc_bytes, tot_bytes FROM t WHERE end_state = 'OPEN'""")
def open_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = flows.tcp_flow_table(tracked_tcp(spark, sf_dir))
    return summary.open_flows(table).select("open_seq", *ENDS, "cts_bytes", "stc_bytes", "tot_bytes")


def numbered_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flow_index(T.tcp_headers(spark, sf_dir), event_rows(spark, sf_dir))


def tcp_matches(spark: SparkSession, sf_dir: str, index: DataFrame, spec: InspectSpec) -> DataFrame:
    """Matches in the data packets of numbered flows."""
    payloads = T.tcp_headers(spark, sf_dir).filter(F.col("len") > 0).select("pkt_seq", "payload")
    chunks = index.filter(F.col("len") > 0).select(
        F.col("open_seq").alias("flow_id"), "direction", F.col("pkt_no").alias("chunk_no"), "pkt_seq",
    ).join(payloads, "pkt_seq").drop("pkt_seq")
    return inspect_streams(chunks, spec).select(
        F.col("flow_id").alias("open_seq"), F.col("chunk_no").alias("match_pkt"), "direction", "rule_id",
        "start_off", "end_off", "size")


TCP_NUMBERED = TCP_FLOW + f""", n AS (SELECT *, row_number() OVER (PARTITION BY open_seq ORDER BY pkt_seq) AS pkt_no
  FROM tf WHERE open_seq IS NOT NULL),
hit AS (SELECT open_seq, min(pkt_no) AS match_pkt FROM n WHERE regexp_matches(payload, '{SEVEN_SQL}') GROUP BY 1)"""


@query(f"""WITH {TCP_NUMBERED} SELECT n.open_seq, n.pkt_seq, pkt_no, direction FROM n JOIN hit USING (open_seq)""")
def extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = numbered_tcp(spark, sf_dir)
    matches = tcp_matches(spark, sf_dir, packets, InspectSpec(rules=(SEVEN,)))
    return extract.extract_all(packets, matches, ["open_seq"]).select(
        "open_seq", "pkt_seq", "pkt_no", "direction")


@query(f"""WITH {TCP_NUMBERED} SELECT n.open_seq, n.pkt_seq, pkt_no, direction FROM n JOIN hit USING (open_seq)
WHERE pkt_no <= match_pkt + {POST}""")
def extract_post_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = numbered_tcp(spark, sf_dir)
    matches = tcp_matches(spark, sf_dir, packets, InspectSpec(rules=(SEVEN,)))
    return extract.extract_post(packets, matches, ["open_seq"], POST).select(
        "open_seq", "pkt_seq", "pkt_no", "direction")


UDP_NUMBERED = UDP_FLOW + f""", n AS (SELECT *, row_number() OVER (PARTITION BY open_seq ORDER BY pkt_seq) AS pkt_no,
  regexp_matches(props, '{SEVEN_SQL}') AS m FROM udpf)"""


EXTRACT_UDP = f"""WITH {UDP_NUMBERED},
a AS (SELECT open_seq, pkt_no, coalesce(pkt_no > lag(pkt_no) OVER w + {POST}, true) AS fresh FROM n WHERE m
  WINDOW w AS (PARTITION BY open_seq ORDER BY pkt_no)),
b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY open_seq ORDER BY pkt_no) AS island FROM a),
c AS (SELECT open_seq, island, max(pkt_no) + {POST} AS cut_at FROM b GROUP BY ALL)
SELECT n.open_seq, n.pkt_seq, n.pkt_no, min(island) AS extract_no
FROM n JOIN c ON n.open_seq = c.open_seq AND n.pkt_no <= c.cut_at GROUP BY ALL"""


@query(EXTRACT_UDP)
def extract_udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    index = cut(flows.number_packets(udp(spark, sf_dir).drop("payload"), rows_per_block=rows))
    payloads = T.udp_headers(spark, sf_dir).select("pkt_seq", "payload")
    matches = inspect_datagrams(index.join(payloads, "pkt_seq"), InspectSpec(rules=(SEVEN,)), [
        "open_seq", "pkt_no"]).withColumnRenamed("pkt_no", "match_pkt")
    return extract.extract_windows(index, matches, ["open_seq"], POST, rows).select(
        "open_seq", "pkt_seq", "pkt_no", "extract_no")


@query(f"""WITH {TCP_FLOW} SELECT open_seq, pkt_seq, direction, len FROM tf
WHERE open_seq IN (SELECT open_seq FROM tf WHERE len > 0)""")
def extract_linemode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.flows_with_data(tracked_tcp(spark, sf_dir), ["open_seq"]).select(
        "open_seq", "pkt_seq", "direction", "len")


@query(f"""WITH {TCP_NUMBERED} SELECT n.open_seq, count(*) AS packets, bool_or(match_pkt IS NOT NULL) AS matched
FROM n LEFT JOIN hit USING (open_seq) GROUP BY 1""")
def flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = numbered_tcp(spark, sf_dir)
    found = tcp_matches(spark, sf_dir, packets, InspectSpec(rules=(SEVEN,))).select("open_seq", F.lit(True).alias("matched"))
    counts = packets.select("open_seq", F.lit(False).alias("matched")).unionByName(
        found.withColumn("matched", F.lit(True)))
    return summary.flow_packets(counts, ["open_seq"]).select(
        "open_seq", (F.col("packets") - F.col("matched").cast("int")).alias("packets"), "matched")


@query(f"""WITH {UDP_NUMBERED} SELECT open_seq, sum(m::INT) AS matches FROM n GROUP BY 1""")
def matches_per_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = udp(spark, sf_dir)
    matches = inspect_datagrams(packets, InspectSpec(rules=(SEVEN,)), ["open_seq"])
    table = flows.udp_flow_table(packets).select("open_seq")
    return summary.matches_per_flow(table, matches, ["open_seq"])


@query(f"""WITH {TCP_FLOW} SELECT open_seq, any_value(
  '(ip.src == ' || src || ' and tcp.srcport == ' || sport || ') and (ip.dst == ' || dst ||
  ' and tcp.dstport == ' || dport || ')') AS filter, direction FROM tf WHERE open_seq IS NOT NULL GROUP BY ALL""")
def flow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = tracked_tcp(spark, sf_dir)
    seen = packets.select("open_seq", "direction").distinct()
    table = flows.tcp_flow_table(packets).select("proto", "open_seq", *ENDS)
    return table.join(seen, "open_seq").select("open_seq", "direction", X.flow_filter(
        F.col("proto"), F.col("client"), F.col("cport"), F.col("server"), F.col("sport"),
        F.col("direction")).alias("filter"))


def named_packets(packets: DataFrame, table: DataFrame, rows: int | None) -> DataFrame:
    """Packets with the capture file name of their flow."""
    ids = flows.flow_ids(table, rows)
    names = ids.select("open_seq", X.file_name(
        F.col("proto"), F.col("proto_no"), F.col("client"), F.col("cport"), F.col("server"),
        F.col("sport")).alias("file_name"))
    return packets.join(names, "open_seq")


@query(f"""WITH {TCP_NUMBERED}, t AS (SELECT open_seq, row_number() OVER (ORDER BY open_seq) AS no FROM n GROUP BY 1)
SELECT format('TCP-{{:08d}}-{{}}.{{}}-192.168.0.1.80', no, client, cport) AS file_name, 0 AS part_no,
  24 + sum(16 + 14 + 40 + len) AS size
FROM n JOIN hit USING (open_seq) JOIN t USING (open_seq) GROUP BY ALL""")
def flow_capture_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = numbered_tcp(spark, sf_dir)
    matches = tcp_matches(spark, sf_dir, packets, InspectSpec(rules=(SEVEN,)))
    payloads = T.tcp_headers(spark, sf_dir).select("pkt_seq", "payload")
    kept = extract.extract_all(packets, matches, ["open_seq"]).join(payloads, "pkt_seq")
    rows = event_rows(spark, sf_dir)
    named = named_packets(encoded_tcp(kept), flows.tcp_flow_table(packets), rows)
    images = sinks.flow_captures(
        named.select("file_name", "pkt_seq", "ts", "pkt"), block_of(F.col("pkt_seq"), rows))
    return images.select("file_name", "part_no", F.octet_length("content").alias("size"))


def event_captures(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the events as capture files, one per flow."""
    packets = udp(spark, sf_dir)
    rows = event_rows(spark, sf_dir)
    named = named_packets(encoded_udp(packets), flows.udp_flow_table(packets), rows)
    images = sinks.flow_captures(
        named.select("file_name", "pkt_seq", "ts", "pkt"), block_of(F.col("pkt_seq"), rows))
    folder = f"{checkpoint_dir(spark)}/captures-{uuid.uuid4().hex}"
    sinks.write_captures(spark, images, folder)
    return folder


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT src, dst, sport, dport, len FROM udpe WHERE dport = 53 AND len >= 9""")
def capture_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files read with filters that are decided on the header bytes, in the source."""
    packets = captured(spark, event_captures(spark, sf_dir)).where("proto = 17 AND dport = 53 AND len >= 9")
    return packets.select("src", "dst", "sport", "dport", "len")


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT src, sport, dst, dport, len FROM udpe""")
def online_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files followed as a stream, with byte offsets as progress."""
    packets = growing_captures(spark, event_captures(spark, sf_dir))
    return online.drain(packets).select("src", "sport", "dst", "dport", "len")


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT src, sport, dst, dport, props AS payload, len FROM udpe""")
def capture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as capture files, one per flow, and read back."""
    decoded = H.decode_packets(capture.read_capture(spark, event_captures(spark, sf_dir)))
    return decoded.select("src", "sport", "dst", "dport", F.decode("payload", "UTF-8").alias("payload"),
                          F.octet_length("payload").alias("len"))
