"""Summaries, reports and sinks over matches of streams and datagrams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions import text as X
from wiresift.operators import annotate, flows, summary as G
from wiresift.operators.datagrams import inspect_datagrams
from wiresift.operators.scan import block_of
from wiresift.plans.flow_queries import SEVEN, SEVEN_SQL, event_rows, udp
from wiresift.plans.inspect_queries import FIRST, WORD, span_sql, stream_matches
from wiresift.plans.registry import CHUNKS, DOCS, UDP_FLOW, first_of_prefix, query
from wiresift.session import checkpoint_dir
from wiresift.sources import sinks
from wiresift.sources import tables as T
from wiresift.spec import InspectSpec, Rule

BOTH = f"{first_of_prefix(FIRST)}, {DOCS}, {span_sql(WORD)}"


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of conversation streams (TCP) and documents (UDP)."""
    tcp = stream_matches(spark, sf_dir, Rule(1, pattern=FIRST)).select(
        F.lit("TCP").alias("proto"), "flow_id", "direction", F.col("chunk_no").alias("seq"), "start_off",
        "end_off", "size")
    documents = inspect_datagrams(
        T.documents(spark, sf_dir), InspectSpec(rules=(Rule(1, pattern=WORD),)), ["doc_id", "direction"])
    return tcp.unionByName(documents.select(
        F.lit("UDP").alias("proto"), F.col("doc_id").alias("flow_id"), "direction", F.lit(0).alias("seq"),
        "start_off", "end_off", "size"))


@query(f"""WITH {BOTH}, a AS (SELECT 'TCP' AS proto, flow_id, chunk_no AS seq, size FROM fm
  UNION ALL SELECT 'UDP', doc_id, 0, size FROM sp),
p AS (SELECT 'TCP' AS proto, count(DISTINCT flow_id) AS processed FROM ch UNION ALL SELECT 'UDP', count(*) FROM docs)
SELECT p.proto, any_value(processed) AS processed, count(size) AS matched, min(size) AS shortest,
  arg_min(flow_id, size * 1000000000000 - flow_id * 1000 - seq) AS shortest_id, max(size) AS longest,
  arg_max(flow_id, size * 1000000000000 + flow_id * 1000 + seq) AS longest_id
FROM p JOIN a ON a.proto = p.proto GROUP BY 1""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = T.chunks(spark, sf_dir).select("flow_id").distinct().select(F.lit("TCP").alias("proto"))
    processed = streams.unionByName(T.documents(spark, sf_dir).select(F.lit("UDP").alias("proto")))
    return G.summary(processed, all_matches(spark, sf_dir), ["flow_id", "seq"], "flow_id")


@query(f"""WITH {first_of_prefix(FIRST)} SELECT count(*) > 0 AS matched FROM fm""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.verdict(stream_matches(spark, sf_dir, Rule(1, pattern=FIRST)))


META_SQL = f"""WITH {UDP_FLOW}, i AS (
  SELECT *, regexp_matches(props, '{SEVEN_SQL}') AS m, regexp_extract(props, '{SEVEN_SQL}') AS hit,
    CASE WHEN direction = 'CTS' THEN '->' ELSE '<-' END AS flag FROM udpf),
n AS (SELECT *, row_number() OVER (ORDER BY pkt_seq) AS inspected, sum(m::INT) OVER (ORDER BY pkt_seq) AS matched,
  dense_rank() OVER (ORDER BY open_seq) AS flow_no FROM i),
h AS (SELECT *, format('[MATCH] ({{:08d}}/{{:08d}}) [IP#{{:d}}.UDP#{{:d}}] ', inspected, CAST(matched AS BIGINT), flow_no, flow_no)
  AS head, instr(props, hit) - 1 AS s FROM n WHERE m)
SELECT pkt_seq, head || src || ':' || sport || ' ' || flag || ' ' || dst || ':' || dport ||
    ' matches regex: ''{SEVEN_SQL}''' AS line1,
  head || 'match @ ' || direction || '[' || s || ':' || (s + length(hit)) || '] (' || length(hit) || 'B)' AS line2
FROM h"""


@query(META_SQL)
def render_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two report lines of every matching datagram, with running counters."""
    packets = udp(spark, sf_dir)
    rows = event_rows(spark, sf_dir)
    ids = flows.flow_ids(flows.udp_flow_table(packets), rows).select("open_seq", "flow_no", "proto_no")
    hits = inspect_datagrams(packets, InspectSpec(rules=(SEVEN,)), [
        "pkt_seq", "open_seq", "src", "sport", "dst", "dport", "direction"])
    hits = annotate.with_rule_meta(hits, (SEVEN,))
    order = packets.select("pkt_seq").join(hits, "pkt_seq", "left")
    counted = annotate.match_counters(
        order, ["pkt_seq"], block_of(F.col("pkt_seq"), rows), F.col("rule_id").isNotNull())
    shown = counted.filter(F.col("rule_id").isNotNull()).join(ids, "open_seq")
    what = X.describe(F.col("mode"), F.col("pattern"), F.col("detail"), F.col("start_off"),
                      F.col("rule_name"), F.col("source_file"))
    lines = X.meta_lines(
        F.col("inspected"), F.col("matched_so_far"), F.col("flow_no"), F.lit("UDP"), F.col("proto_no"),
        F.col("src"), F.col("sport"), F.col("direction"), F.col("dst"), F.col("dport"), what,
        F.col("start_off"), F.col("end_off"), F.col("size"))
    return shown.withColumn("_lines", lines).select(
        "pkt_seq", F.get("_lines", F.lit(0)).alias("line1"), F.get("_lines", F.lit(1)).alias("line2"))


@query(f"""WITH {CHUNKS}, h AS (SELECT *, regexp_extract(text, '{WORD}') AS hit FROM ch WHERE regexp_matches(text, '{WORD}'))
SELECT 'TCP' AS proto, flow_id, direction, 0 AS part_no, string_agg(hit, '' ORDER BY chunk_no) AS content FROM h GROUP BY ALL""")
def payload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched bytes written per flow direction, and read back."""
    matches = inspect_datagrams(T.chunks(spark, sf_dir), InspectSpec(rules=(Rule(1, pattern=WORD),)), [
        "flow_id", "direction", "chunk_no"]).withColumn("proto", F.lit("TCP"))
    parts = sinks.payload_log(matches, ["proto", "flow_id", "direction"], ["chunk_no"],
                              F.floor(F.col("chunk_no") / 4096).cast("bigint"))
    folder = f"{checkpoint_dir(spark)}/payloads-{uuid.uuid4().hex}"
    sinks.write_payloads(parts, folder)
    return spark.read.parquet(folder).withColumn("content", F.decode("content", "UTF-8"))


@query(f"""WITH {BOTH} SELECT 'TCP' AS proto, flow_id, direction, chunk_no AS seq, start_off, end_off, size FROM fm
UNION ALL SELECT 'UDP', doc_id, direction, 0, start_off, end_off, size FROM sp""")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written as a report table, and read back."""
    folder = f"{checkpoint_dir(spark)}/matches-{uuid.uuid4().hex}"
    sinks.write_matches(all_matches(spark, sf_dir), folder)
    return spark.read.parquet(folder)
