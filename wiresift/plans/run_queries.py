"""A whole run over conversations that travel as TCP packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions import headers as H
from wiresift.operators.streams import line_mode
from wiresift.plans.registry import first_of_prefix, query
from wiresift.plans.run import inspect, packets_of
from wiresift.session import cut
from wiresift.sources import tables as T
from wiresift.spec import InspectSpec, Rule

SEGMENT = 512
LITERAL = " the "


def conversation_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a TCP connection: handshake, then its turns in segments."""
    lines = line_mode(T.chunks(spark, sf_dir))
    pieces = lines.withColumn("i", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("size") - 1) / SEGMENT).cast("int"))))
    data = pieces.select(
        "flow_id", (F.col("chunk_no") + 4).alias("turn"), "i", F.col("direction") == "STC",
        F.lit("PA").alias("flags"), (F.col("start_off") + F.col("i") * SEGMENT + 1).alias("rel"),
        F.substring("payload", F.col("i") * SEGMENT + 1, F.lit(SEGMENT)).alias("payload")).toDF(
        "flow_id", "turn", "i", "reply", "flags", "rel", "payload")
    hello = F.array(*[F.struct(F.lit(n).cast("bigint").alias("turn"), F.lit(r).alias("reply"), F.lit(f).alias("flags"))
                      for n, (r, f) in enumerate([(False, "S"), (True, "SA"), (False, "A")])])
    shake = lines.select("flow_id").distinct().withColumn("h", F.explode(hello)).select(
        "flow_id", "h.turn", F.lit(0).alias("i"), "h.reply", "h.flags",
        F.when(F.col("h.flags") == "A", 1).otherwise(0).cast("bigint").alias("rel"), F.lit(b"").alias("payload"))
    every = data.unionByName(shake)
    flow = F.col("flow_id")
    client = F.concat(F.lit("10."), F.floor(flow / 65536) % 256, F.lit("."), F.floor(flow / 256) % 256,
                      F.lit("."), flow % 256)
    reply, server = F.col("reply"), F.lit(T.SERVER)
    isn = F.when(reply, flow % 1000 + 4294967000).otherwise(flow % 1000 + 4294966000)
    body = H.encode_tcp(F.when(reply, 80).otherwise(20000), F.when(reply, 20000).otherwise(80),
                        (isn + F.col("rel")) % 4294967296, F.lit(0), F.col("flags"), F.col("payload"))
    return every.select(
        (flow * 65536 + F.col("turn") * 256 + F.col("i")).alias("pkt_seq"),
        F.timestamp_seconds(flow * 1000 + F.col("turn")).alias("ts"),
        H.encode_ip(F.lit(H.TCP), F.when(reply, server).otherwise(client),
                    F.when(reply, client).otherwise(server), body, flow % 65536).alias("pkt"))


@query(f"""WITH {first_of_prefix(LITERAL)} SELECT flow_id, direction, start_off, end_off, size FROM fm""")
def packet_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, flows, assembly and inspection in one go."""
    packets = cut(H.decode_packets(conversation_packets(spark, sf_dir)))
    run = inspect(packets, InspectSpec(rules=(Rule(1, pattern=LITERAL),)))
    return run.matches.select(
        F.floor(F.col("flow_id") / 65536).alias("flow_id"), "direction", "start_off", "end_off", "size")


@query(f"""WITH {first_of_prefix(LITERAL)}, p AS (SELECT count(DISTINCT flow_id) AS n FROM ch WHERE len > 0)
SELECT 'TCP' AS proto, (SELECT n FROM p) AS processed, count(*) AS matched, min(size) AS shortest,
  max(size) AS longest, max(flow_id) AS latest_id FROM fm""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = cut(H.decode_packets(conversation_packets(spark, sf_dir)))
    run = inspect(packets, InspectSpec(rules=(Rule(1, pattern=LITERAL),)))
    return run.summary().select("proto", "processed", "matched", "shortest", "longest",
                                F.floor(F.col("longest_id") / 65536).alias("latest_id"))


def literal_run(spark: SparkSession, sf_dir: str, **opts):
    raw = cut(conversation_packets(spark, sf_dir))
    return raw, inspect(cut(packets_of(raw)), InspectSpec(rules=(Rule(1, pattern=LITERAL),), **opts))


# Deliveries in the order of arrival: a turn's segments one by one, up to the flow's match.
SEGMENTS = f"""sg AS (SELECT flow_id, direction, chunk_no, i, {SEGMENT} * i AS at, least({SEGMENT}, len - {SEGMENT} * i) AS size,
    before + {SEGMENT} * i AS start_off
  FROM (SELECT *, unnest(range(0, (len - 1) // {SEGMENT} + 1)) AS i FROM (
    SELECT *, sum(len) OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) - len AS before FROM ch WHERE len > 0)))"""


@query(f"""WITH {first_of_prefix(LITERAL)}, {SEGMENTS},
pk AS (SELECT *, 3 + row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no, i) AS pkt_no FROM sg),
h AS (SELECT f.flow_id, f.direction, f.start_off, f.end_off, f.size, p.pkt_no AS last_pkt, p.chunk_no, p.i,
    (SELECT q.pkt_no FROM pk q WHERE q.flow_id = f.flow_id AND q.direction = f.direction
      AND q.start_off <= f.start_off AND f.start_off < q.start_off + q.size) AS first_pkt
  FROM fm f JOIN pk p ON p.flow_id = f.flow_id AND p.direction = f.direction
    AND p.start_off < f.end_off AND f.end_off <= p.start_off + p.size),
c AS (SELECT p.*, h.last_pkt IS NOT NULL AND h.last_pkt = p.pkt_no AS hit FROM pk p LEFT JOIN h USING (flow_id)
  WHERE h.last_pkt IS NULL OR p.pkt_no <= h.last_pkt),
k AS (SELECT *, row_number() OVER w AS inspected, sum(hit::INT) OVER w AS matched FROM c
  WINDOW w AS (ORDER BY flow_id, pkt_no)),
ids AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) AS no FROM (SELECT DISTINCT flow_id FROM pk)),
o AS (SELECT h.*, k.inspected, k.matched, ids.no, format('[MATCH] ({{:08d}}/{{:08d}}) [IP#{{:d}}.TCP#{{:d}}] ', k.inspected,
    CAST(k.matched AS BIGINT), no, no) AS head FROM h JOIN ids USING (flow_id) JOIN k ON k.flow_id = h.flow_id AND k.hit)
SELECT flow_id, head || '10.' || ((flow_id // 65536) % 256) || '.' || ((flow_id // 256) % 256) || '.' || (flow_id % 256) || ':20000 '
    || CASE direction WHEN 'CTS' THEN '->' ELSE '<-' END || ' 192.168.0.1:80 matches regex: ''{LITERAL}''' AS line1,
  head || 'match @ ' || direction || '[' || start_off || ':' || end_off || '] (' || size || 'B | packet[' || first_pkt
    || '] - packet[' || last_pkt || '])' AS line2 FROM o""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole run over TCP, with the packets that hold each match."""
    _, run = literal_run(spark, sf_dir)
    return run.report().select(F.floor(F.col("flow_id") / 65536).alias("flow_id"), "line1", "line2")


@query(f"""WITH {first_of_prefix(LITERAL)} SELECT 'TCP' AS proto, flow_id, direction, 0 AS part_no, hit AS content FROM fm""")
def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched bytes of a whole run."""
    _, run = literal_run(spark, sf_dir)
    return run.payloads().select("proto", F.floor(F.col("flow_id") / 65536).alias("flow_id"), "direction", "part_no",
                                 F.decode("content", "UTF-8").alias("content"))


@query(f"""WITH {first_of_prefix(LITERAL)},
n AS (SELECT flow_id, 3 + sum((len - 1) // {SEGMENT} + 1) AS packets, sum(len) AS bytes, row_number() OVER (ORDER BY flow_id) AS no
  FROM ch WHERE len > 0 GROUP BY 1)
SELECT format('TCP-{{:08d}}-10.{{}}.{{}}.{{}}.20000-192.168.0.1.80', no, (flow_id // 65536) % 256, (flow_id // 256) % 256, flow_id % 256)
    AS file_name, 0 AS part_no, CAST(24 + 70 * packets + bytes AS BIGINT) AS size
FROM n WHERE flow_id IN (SELECT flow_id FROM fm)""")
def run_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files of the flows that match in a whole run."""
    raw, run = literal_run(spark, sf_dir, extract=True)
    return run.captures(raw).select("file_name", "part_no", F.octet_length("content").cast("bigint").alias("size"))


@query(f"""WITH {first_of_prefix(LITERAL)} SELECT flow_id, direction,
  'matches ''{LITERAL}'' @ [' || start_off || ':' || end_off || '] - ' || size || 'B' AS quiet, substr(hit, 1, 3) AS print FROM fm""")
def run_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of a run as one line each, and their first three bytes as text."""
    _, run = literal_run(spark, sf_dir, output_modes=("quiet", "print"), max_disp_bytes=3)
    return run.displayed().select(F.floor(F.col("flow_id") / 65536).alias("flow_id"), "direction", "quiet", "print")
