"""Header decoding over packets encoded from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions import headers as H
from wiresift.operators.scope import prefilter
from wiresift.plans.registry import TCP, UDP, UDP_ENDS, query
from wiresift.sources import tables as T


def encoded_udp(packets: DataFrame) -> DataFrame:
    """Add ``pkt``: the datagram as bytes."""
    body = H.encode_udp(F.col("sport"), F.col("dport"), F.col("payload"))
    return packets.withColumn("pkt", H.encode_ip(
        F.lit(H.UDP), F.col("src"), F.col("dst"), body, F.col("pkt_seq") % 65536))


def encoded_tcp(packets: DataFrame) -> DataFrame:
    """Add ``pkt``: the segment as bytes."""
    body = H.encode_tcp(F.col("sport"), F.col("dport"), F.col("seq"), F.col("ack"), F.col("flags"),
                        F.col("payload"))
    return packets.withColumn("pkt", H.encode_ip(
        F.lit(H.TCP), F.col("src"), F.col("dst"), body, F.col("pkt_seq") % 65536))


@query(f"""WITH {UDP}, {UDP_ENDS}
SELECT pkt_seq, 4 AS version, 20 AS ihl, 0 AS tos, 28 + len AS total_len, pkt_seq % 65536 AS ip_id,
  64 AS ttl, 17 AS proto, src, dst FROM udpe""")
def ip_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = encoded_udp(T.udp_headers(spark, sf_dir)).select("pkt_seq", H.decode_ip(F.col("pkt")).alias("ip"))
    return raw.select("pkt_seq", *[
        f"ip.{c}" for c in ("version", "ihl", "tos", "total_len", "ip_id", "ttl", "proto", "src", "dst")])


@query(f"""WITH {TCP}
SELECT pkt_seq, sport, dport, seq, ack, 20 AS hlen, flags, 8192 AS "window", 0 AS checksum, 0 AS urgent FROM tcp""")
def tcp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = encoded_tcp(T.tcp_headers(spark, sf_dir)).select("pkt_seq", "pkt")
    return raw.select("pkt_seq", H.decode_tcp(F.col("pkt"), F.lit(20)).alias("tcp")).select("pkt_seq", "tcp.*")


@query("""SELECT event_id AS pkt_seq,
  CASE WHEN event_id & 1 <> 0 THEN 'F' ELSE '' END || CASE WHEN event_id & 2 <> 0 THEN 'S' ELSE '' END ||
  CASE WHEN event_id & 4 <> 0 THEN 'R' ELSE '' END || CASE WHEN event_id & 8 <> 0 THEN 'P' ELSE '' END ||
  CASE WHEN event_id & 16 <> 0 THEN 'A' ELSE '' END || CASE WHEN event_id & 32 <> 0 THEN 'U' ELSE '' END AS flags
FROM events""")
def tcp_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pkt_seq"), H.tcp_flags(F.col("event_id") % 256).alias("flags"))


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT pkt_seq, sport, dport, 8 + len AS length FROM udpe""")
def udp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = encoded_udp(T.udp_headers(spark, sf_dir)).select("pkt_seq", "pkt")
    return raw.select("pkt_seq", H.decode_udp(F.col("pkt"), F.lit(20)).alias("udp")).select("pkt_seq", "udp.*")


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT pkt_seq, props AS payload, len FROM udpe""")
def payload_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding after the datagram, as short link frames have it, is cut off."""
    packets = encoded_udp(T.udp_headers(spark, sf_dir)).drop("payload")
    padded = packets.withColumn("pkt", F.concat("pkt", F.unhex(F.lit("000000000000"))))
    return H.decode_packets(padded.select("pkt_seq", "pkt")).select(
        "pkt_seq", F.decode("payload", "UTF-8").alias("payload"), F.octet_length("payload").alias("len"))


@query("""SELECT event_id AS pkt_seq, CASE event_type WHEN 'click' THEN 6 ELSE 17 END AS proto
FROM events WHERE event_type IN ('click', 'view')""")
def proto_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    number = F.when(kind == "click", 6).when(kind == "view", 17).when(kind == "error", 1).otherwise(50)
    return H.by_proto(T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pkt_seq"), number.alias("proto")))


@query(f"""WITH {TCP} SELECT pkt_seq, src, dst, sport, dport, flags, payload, len FROM tcp""")
def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = encoded_tcp(T.tcp_headers(spark, sf_dir)).select("pkt_seq", "pkt")
    return H.decode_packets(raw).select(
        "pkt_seq", "src", "dst", "sport", "dport", "flags", F.decode("payload", "UTF-8").alias("payload"),
        F.octet_length("payload").alias("len"))


@query(f"""WITH {UDP}, {UDP_ENDS} SELECT pkt_seq, src, dst, sport, dport, len FROM udpe
WHERE (sport = 53 OR dport = 53) AND len >= 9""")
def capture_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter(T.udp_headers(spark, sf_dir).select("pkt_seq", "src", "dst", "sport", "dport", "len"),
                     "(sport = 53 or dport = 53) and len >= 9")
