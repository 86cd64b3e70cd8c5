"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register




# Views of wiresift.sources.tables, restated in SQL.
CLIENT = ("'10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) "
          "|| '.' || (user_id % 256)")
UDP = f"""udp AS (
  SELECT event_id AS pkt_seq, ts, user_id, event_type, props, event_id % 3 = 0 AS reply,
    {CLIENT} AS client, user_id % 40000 + 20000 AS cport, '192.168.0.1' AS server,
    CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080
      WHEN 'signup' THEN 5060 ELSE 53 END AS vport, strlen(props) AS len
  FROM events)"""
UDP_ENDS = """udpe AS (
  SELECT *, CASE WHEN reply THEN server ELSE client END AS src, CASE WHEN reply THEN client ELSE server END AS dst,
    CASE WHEN reply THEN vport ELSE cport END AS sport, CASE WHEN reply THEN cport ELSE vport END AS dport
  FROM udp)"""
# A pair's first packet fixes the keyed endpoint.
UDP_FLOW = UDP + ", " + UDP_ENDS + """, udpk AS (
  SELECT *, first_value(CASE WHEN dport <= 1024 AND sport >= 1024 THEN NOT reply ELSE reply END)
      OVER w AS key_is_client,
    first_value(pkt_seq) OVER w AS open_seq
  FROM udpe WINDOW w AS (PARTITION BY user_id, event_type ORDER BY pkt_seq)),
udpf AS (
  SELECT *, CASE WHEN reply <> key_is_client THEN 'CTS' ELSE 'STC' END AS direction FROM udpk)"""
TCP = f"""tcp0 AS (
  SELECT *, event_id AS pkt_seq, {CLIENT} AS client, user_id % 40000 + 20000 AS cport,
    '192.168.0.1' AS server, 80 AS vport, event_id % 3 = 0 AND event_type <> 'signup' AS reply,
    CASE WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'SA'
      WHEN event_type = 'purchase' THEN 'FA' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'R'
      WHEN event_type = 'error' THEN 'A' ELSE 'PA' END AS flags
  FROM events),
tcp AS (
  SELECT *, CASE WHEN reply THEN 'STC' ELSE 'CTS' END AS direction,
    CASE WHEN flags = 'PA' THEN props ELSE '' END AS payload,
    CASE WHEN flags = 'PA' THEN strlen(props) ELSE 0 END AS len,
    event_id * 7919 % 4294967296 AS seq, event_id * 104729 % 4294967296 AS ack,
    CASE WHEN reply THEN server ELSE client END AS src, CASE WHEN reply THEN client ELSE server END AS dst,
    CASE WHEN reply THEN vport ELSE cport END AS sport, CASE WHEN reply THEN cport ELSE vport END AS dport
  FROM tcp0)"""


def tcp_flow(idle: float | None = None) -> str:
    """TCP packets with ``open_seq`` (null when untracked) as ``tf``."""
    gap = "false" if idle is None else (
        f"coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY pkt_seq)) > {idle}, false)")
    past = "(PARTITION BY user_id ORDER BY pkt_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    here = "(PARTITION BY user_id ORDER BY pkt_seq)"
    return TCP + f""",
fa AS (SELECT *, {gap} AS gap FROM tcp),
fb AS (SELECT *, max(CASE WHEN flags = 'S' THEN pkt_seq END) OVER {past} AS last_syn,
    max(CASE WHEN flags LIKE '%F%' AND reply THEN pkt_seq END) OVER {past} AS fin_s,
    max(CASE WHEN flags LIKE '%F%' AND NOT reply THEN pkt_seq END) OVER {past} AS fin_c FROM fa),
fc AS (SELECT *, coalesce(flags LIKE '%R%' OR (flags LIKE '%F%'
    AND CASE WHEN reply THEN fin_c ELSE fin_s END > last_syn), false) AS closing FROM fb),
fd AS (SELECT *, greatest(max(CASE WHEN closing THEN 2 * pkt_seq END) OVER {past},
    max(CASE WHEN gap THEN 2 * pkt_seq - 1 END) OVER {here}) AS dead FROM fc),
fe AS (SELECT *, flags = 'S' AND (last_syn IS NULL OR coalesce(dead > 2 * last_syn, false)) AS opens FROM fd),
ff AS (SELECT *, max(CASE WHEN opens THEN pkt_seq END) OVER {here} AS opened FROM fe),
tf AS (SELECT *, CASE WHEN coalesce(dead, -1) < 2 * opened THEN opened END AS open_seq,
    closing AND opened IS NOT NULL AND coalesce(dead, -1) < 2 * opened AS closes FROM ff)"""


TCP_FLOW = tcp_flow()
CHUNKS = """ch AS (
  SELECT conv_id AS flow_id, turn AS chunk_no, CASE role WHEN 'assistant' THEN 'STC' ELSE 'CTS' END AS direction,
    text, strlen(text) AS len
  FROM conversations)"""
# Events as chunks: a few flows of thousands of chunks each.
LONG_CHUNKS = """ch AS (
  SELECT event_type AS flow_id, event_id AS chunk_no, CASE WHEN event_id % 3 = 0 THEN 'STC' ELSE 'CTS' END AS direction,
    props AS text, strlen(props) AS len
  FROM events)"""
_PREFIX = """, pre AS (
  SELECT *, string_agg(text, '') OVER w AS buf, sum(len) OVER w AS end_off,
    row_number() OVER w AS k
  FROM ch WHERE len > 0
  WINDOW w AS (PARTITION BY flow_id, direction ORDER BY chunk_no))"""
PREFIXES = CHUNKS + _PREFIX
LONG_PREFIXES = LONG_CHUNKS + _PREFIX
DOCS = """docs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'CTS' ELSE 'STC' END AS direction, text FROM documents)"""


def first_of_prefix(pattern: str, where: str = "true", prefixes: str = PREFIXES) -> str:
    """SQL for first-match mode with one context-free pattern, as ``fm``."""
    return prefixes + f""", hits AS (
  SELECT *, regexp_extract(buf, '{pattern}') AS hit,
    row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no) AS rn
  FROM pre WHERE regexp_matches(buf, '{pattern}') AND {where}),
fm AS (
  SELECT flow_id, direction, chunk_no, strlen(substr(buf, 1, instr(buf, hit) - 1)) AS start_off,
    strlen(substr(buf, 1, instr(buf, hit) - 1)) + strlen(hit) AS end_off, strlen(hit) AS size, hit
  FROM hits WHERE rn = 1)"""


def multi_of_prefix(pattern: str) -> str:
    """SQL for multi-match mode with one context-free pattern, as ``mm``."""
    return "RECURSIVE " + PREFIXES + f""", step(flow_id, direction, k, chunk_no, skip, hit, pos0, buf) AS (
  SELECT flow_id, direction, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR),
    CAST(0 AS BIGINT), '' FROM pre WHERE k = 1
  UNION ALL
  SELECT flow_id, direction, k, chunk_no,
    CASE WHEN found THEN skip + instr(rest, hit) - 1 + length(hit) ELSE skip END,
    CASE WHEN found THEN hit END, CASE WHEN found THEN skip + instr(rest, hit) - 1 END, buf
  FROM (
    SELECT p.flow_id, p.direction, p.k, p.chunk_no, s.skip, p.buf, substr(p.buf, s.skip + 1) AS rest,
      regexp_matches(substr(p.buf, s.skip + 1), '{pattern}') AS found,
      regexp_extract(substr(p.buf, s.skip + 1), '{pattern}') AS hit
    FROM step s JOIN pre p ON p.flow_id = s.flow_id AND p.direction = s.direction AND p.k = s.k + 1) x),
mm AS (
  SELECT flow_id, direction, chunk_no,
    row_number() OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) AS match_no,
    strlen(substr(buf, 1, pos0)) AS start_off, strlen(substr(buf, 1, pos0)) + strlen(hit) AS end_off,
    strlen(hit) AS size, hit
  FROM step WHERE hit IS NOT NULL)"""
