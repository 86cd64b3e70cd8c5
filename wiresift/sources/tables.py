"""Packet, datagram and chunk views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions.headers import TCP, UDP

# The one server address, and its port per event type.
SERVER = "192.168.0.1"
PORTS = {"click": 80, "view": 443, "purchase": 8080, "signup": 5060, "error": 53}
TCP_PORT = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    return F.encode(F.col(col), "UTF-8")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as stream chunks: a conversation is a flow, the assistant its server."""
    return chunks_view(table(spark, sf_dir, "conversations"))


def chunks_view(turns: DataFrame) -> DataFrame:
    role = F.col("role")
    return turns.select(
        F.col("conv_id").alias("flow_id"),
        F.when(role == "assistant", "STC").otherwise("CTS").alias("direction"),
        F.col("turn").alias("chunk_no"), utf8("text").alias("payload"))


def long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stream chunks: all events of a kind are one long flow, numbered by their ids."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("flow_id"), F.when(F.col("event_id") % 3 == 0, "STC").otherwise("CTS").alias("direction"),
        F.col("event_id").alias("chunk_no"), utf8("props").alias("payload"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as datagrams: even ids from the client, odd ones from the server."""
    return documents_view(table(spark, sf_dir, "documents"))


def documents_view(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "CTS").otherwise("STC").alias("direction"),
        utf8("text").alias("payload"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as datagrams from the server."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lit("STC").alias("direction"), utf8("html").alias("payload"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as datagrams."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("CTS").alias("direction"),
        utf8("text").alias("payload"))


def _client() -> Column:
    return F.expr("concat('10.', (user_id div 65536) % 256, '.', (user_id div 256) % 256, '.', user_id % 256)")


def _cport() -> Column:
    return (F.col("user_id") % 40000 + 20000).cast("int")


def _ends(reply: Column, server_port: Column) -> dict[str, Column]:
    client, cport, server = _client(), _cport(), F.lit(SERVER)
    return {
        "src": F.when(reply, server).otherwise(client),
        "dst": F.when(reply, client).otherwise(server),
        "sport": F.when(reply, server_port).otherwise(cport).cast("int"),
        "dport": F.when(reply, cport).otherwise(server_port).cast("int"),
    }


def udp_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as UDP datagrams between a user and the server; every third is a reply."""
    return udp_view(table(spark, sf_dir, "events"))


def udp_view(events: DataFrame) -> DataFrame:
    port = F.lit(None).cast("int")
    for kind, number in PORTS.items():
        port = F.when(F.col("event_type") == kind, number).otherwise(port)
    ends = _ends(F.col("event_id") % 3 == 0, port)
    return events.select(
        F.col("event_id").alias("pkt_seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(UDP).alias("proto"), *[c.alias(n) for n, c in ends.items()],
        F.octet_length("props").alias("len"), utf8("props").alias("payload"))


def tcp_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as TCP segments: signups open, purchases finish, some errors reset."""
    return tcp_view(table(spark, sf_dir, "events"))


def tcp_view(events: DataFrame) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    reply = (number % 3 == 0) & (kind != "signup")
    flags = (F.when(kind == "signup", "S").when((kind == "view") & reply, "SA")
             .when(kind == "purchase", "FA").when((kind == "error") & (number % 5 == 0), "R")
             .when(kind == "error", "A").otherwise("PA"))
    ends = _ends(reply, F.lit(TCP_PORT))
    body = F.when(flags == "PA", utf8("props")).otherwise(F.lit(b""))
    return events.select(
        number.alias("pkt_seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(TCP).alias("proto"), *[c.alias(n) for n, c in ends.items()],
        (number * 7919 % 4294967296).alias("seq"), (number * 104729 % 4294967296).alias("ack"),
        flags.alias("flags"), F.when(flags == "PA", F.octet_length("props")).otherwise(0).alias("len"),
        body.alias("payload"))
