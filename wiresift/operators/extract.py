"""Packets of matching flows.

The matched side of each join has one row per flow. The packet side may hold
one very large flow; adaptive skew-join splitting divides it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.operators.scan import PACKETS_PER_BLOCK, Running, block_of, running
from wiresift.session import cut
from wiresift.spec import DEFAULT_POST_PACKETS


def extract_all(packets: DataFrame, matches: DataFrame, flow: Sequence[str]) -> DataFrame:
    """Every packet of every matched flow, both directions, before and after the match."""
    matched = matches.select(*flow).distinct()
    return packets.join(matched, list(flow), "left_semi")


def extract_post(packets: DataFrame, matches: DataFrame, flow: Sequence[str],
                 post: int = DEFAULT_POST_PACKETS) -> DataFrame:
    """Packets up to the one the match was found on, plus ``post`` more.

    ``packets`` are numbered (``pkt_no``); ``matches`` give ``match_pkt``.
    """
    cuts = matches.groupBy(*flow).agg((F.min("match_pkt") + post).alias("_cut"))
    return packets.join(cuts, list(flow)).filter(F.col("pkt_no") <= F.col("_cut")).drop("_cut")


def extract_windows(packets: DataFrame, matches: DataFrame, flow: Sequence[str],
                    post: int = DEFAULT_POST_PACKETS,
                    rows_per_block: int | None = PACKETS_PER_BLOCK) -> DataFrame:
    """The same where a flow can match again: adds ``extract_no``.

    A match within the quota of the one before moves the end of the extract;
    after that collection starts anew, and a later match ends the next extract.
    """
    block = block_of(F.col("pkt_no"), rows_per_block)
    found = matches.select(*flow, F.col("match_pkt").alias("pkt_no"))
    before = running(found, flow, ["pkt_no"], block, [
        Running("_last", "max", F.col("pkt_no"), inclusive=False)])
    starts = F.coalesce(F.col("pkt_no") > F.col("_last") + post, F.lit(True))
    islands = running(before.withColumn("_start", starts.cast("bigint")), flow, ["pkt_no"], block,
                      [Running("_island", "sum", F.col("_start"))])
    cuts = cut(islands.groupBy(*flow, "_island").agg((F.max("pkt_no") + post).alias("pkt_no")))
    last = cuts.groupBy(*flow).agg(F.max("pkt_no").alias("_last_cut"))
    kept = packets.join(last, list(flow)).filter(F.col("pkt_no") <= F.col("_last_cut")).drop("_last_cut")
    marks = cuts.select(*flow, "pkt_no", F.lit(1).alias("_tag"), F.lit(1).alias("_one"))
    rows = kept.withColumns({"_tag": F.lit(0), "_one": F.lit(0)}).unionByName(
        marks, allowMissingColumns=True)
    placed = running(rows, flow, ["pkt_no", "_tag"], block, [
        Running("_done", "sum", F.col("_one"))])
    return placed.filter(F.col("_tag") == 0).withColumn(
        "extract_no", F.col("_done") + 1).drop("_tag", "_one", "_done")


def flows_with_data(packets: DataFrame, flow: Sequence[str]) -> DataFrame:
    """Line-mode extraction: all packets of flows that carried data."""
    carried = packets.filter(F.col("len") > 0).select(*flow).distinct()
    return packets.join(carried, list(flow), "left_semi")
