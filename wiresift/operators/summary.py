"""Counts over matches and flows. Everything is pre-aggregated before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest_longest(seq: Sequence[str], ident: str) -> list:
    """Shortest and longest match with their ids; among equals the latest wins."""
    early = F.struct(F.col("size"), *[-F.col(c) for c in seq])
    late = F.struct(F.col("size"), *[F.col(c) for c in seq])
    return [
        F.min("size").alias("shortest"), F.min_by(ident, early).alias("shortest_id"),
        F.max("size").alias("longest"), F.max_by(ident, late).alias("longest_id"),
    ]


def summary(processed: DataFrame, matches: DataFrame, seq: Sequence[str], ident: str) -> DataFrame:
    """Per protocol: processed and matched, shortest and longest match.

    ``processed`` has one row per inspected datagram or completed handshake,
    both inputs a ``proto`` column.
    """
    total = processed.groupBy("proto").agg(F.count(F.lit(1)).alias("processed"))
    found = matches.groupBy("proto").agg(
        F.count(F.lit(1)).alias("matched"), *shortest_longest(seq, ident))
    numbers = ("matched", "shortest", "shortest_id", "longest", "longest_id")
    return total.join(found, "proto", "full").select(
        "proto", F.coalesce("processed", F.lit(0)).alias("processed"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers])


def open_flows(flows: DataFrame) -> DataFrame:
    """Flows still open at the end, with the bytes of each direction."""
    return flows.filter(F.col("end_state") == "OPEN")


def flow_packets(packets: DataFrame, flow: Sequence[str], matched: str = "matched") -> DataFrame:
    """Packets per flow and whether it matched."""
    return packets.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("packets"), F.bool_or(matched).alias("matched"))


def matches_per_flow(flows: DataFrame, matches: DataFrame, flow: Sequence[str]) -> DataFrame:
    """Number of matches of every flow, 0 where there is none."""
    counts = matches.groupBy(*flow).agg(F.count(F.lit(1)).alias("matches"))
    return flows.join(counts, list(flow), "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0)))


def verdict(matches: DataFrame) -> DataFrame:
    """One row: whether anything matched."""
    return matches.agg((F.count(F.lit(1)) > 0).alias("matched"))
