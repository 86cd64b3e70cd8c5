"""What is added to a match: rule texts, packets, bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.operators.scan import Running, running
from wiresift.spec import InspectSpec, Rule

# Bytes of a stream that share a join bucket.
BUCKET = 1 << 16
RULE_SCHEMA = ("rule_id int, pattern string, namespace string, rule_name string, "
               "source_file string, meta map<string,string>")
# Rules a plan may carry along as a broadcast table.
MAX_BROADCAST_RULES = 10_000


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows."""
    rows = [(r.rule_id, r.pattern, r.namespace, r.rule_name, r.source_file, dict(r.meta)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def with_rule_meta(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add pattern, namespace, rule name, file and metadata of the rule that hit."""
    table = rule_table(matches.sparkSession, rules)
    if len(rules) <= MAX_BROADCAST_RULES:
        table = F.broadcast(table)
    return matches.join(table, "rule_id")


def _buckets(low: Column, high: Column, bucket: int) -> Column:
    return F.sequence(F.floor(low / bucket), F.floor(high / bucket))


def packet_span(matches: DataFrame, ranges: DataFrame, key: Sequence[str], match_id: Sequence[str],
                bucket: int = BUCKET) -> DataFrame:
    """``first_pkt`` and ``last_pkt`` that the bytes of each match lie in.

    ``ranges`` gives, per stream ``key``, the half-open byte range each packet
    contributed; ranges do not overlap. Only the packets holding the first and
    the last byte are looked up, by bucket of the offset, so a match of any
    length costs two rows and a long stream spreads over its buckets.
    """
    points = matches.select(
        *key, *[c for c in match_id if c not in key],
        F.explode(F.array(F.col("start_off"),
                          F.greatest(F.col("end_off") - 1, F.col("start_off")))).alias("_at"))
    points = points.withColumn("_bucket", F.floor(F.col("_at") / bucket))
    held = ranges.filter(F.col("end_off") > F.col("start_off")).select(
        *key, "pkt_no", F.col("start_off").alias("_lo"), F.col("end_off").alias("_hi"),
        F.explode(_buckets(F.col("start_off"), F.col("end_off") - 1, bucket)).alias("_bucket"))
    inside = points.join(held, [*key, "_bucket"]).filter(
        (F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi")))
    span = inside.groupBy(*match_id).agg(
        F.min("pkt_no").alias("first_pkt"), F.max("pkt_no").alias("last_pkt"))
    return matches.join(span, list(match_id), "left")


def match_pieces(matches: DataFrame, chunks: DataFrame, key: Sequence[str], match_id: Sequence[str],
                 bucket: int = BUCKET) -> DataFrame:
    """The matched bytes, one row per chunk they come from.

    A match can be as long as its stream, so its bytes are not joined up here;
    ``piece_off`` orders the pieces within the match.
    """
    spans = matches.filter(F.col("end_off") > F.col("start_off")).select(
        *dict.fromkeys([*key, *match_id]), F.col("start_off").alias("_s"), F.col("end_off").alias("_e"))
    wanted = spans.withColumn("_bucket", F.explode(_buckets(F.col("_s"), F.col("_e") - 1, bucket)))
    held = chunks.filter(F.col("end_off") > F.col("start_off")).select(
        *key, F.col("start_off").alias("_lo"), F.col("end_off").alias("_hi"), "payload")
    held = held.withColumn("_bucket", F.explode(_buckets(F.col("_lo"), F.col("_hi") - 1, bucket)))
    both = wanted.join(held, [*key, "_bucket"])
    low, high = F.greatest("_s", "_lo"), F.least("_e", "_hi")
    # A pair can meet in several buckets; the one of its first shared byte counts.
    once = (low < high) & (F.floor(low / bucket) == F.col("_bucket"))
    return both.filter(once).select(
        *match_id, (low - F.col("_s")).alias("piece_off"),
        F.substring("payload", (low - F.col("_lo") + 1).cast("int"), (high - low).cast("int")).alias("data"))


def match_bytes(buf: Column, start: Column, size: Column) -> Column:
    """Matched bytes of a hit in a single buffer."""
    return F.substring(buf, (start + 1).cast("int"), size.cast("int"))


def match_counters(rows: DataFrame, order: Sequence[str], block: Column | None,
                   matched: Column) -> DataFrame:
    """Running counts over everything inspected: ``inspected`` and ``matched_so_far``."""
    return running(rows, [], order, block, [
        Running("inspected", "sum", F.lit(1)),
        Running("matched_so_far", "sum", matched.cast("bigint"))])


def rule_expr(matches: DataFrame, flow: Sequence[str], rules: dict[str, int], expression: str) -> DataFrame:
    """Flows whose matches satisfy a boolean expression over named rules.

    ``rules`` maps the names used in ``expression`` to rule ids.
    """
    seen = [F.bool_or(F.col("rule_id") == rule_id).alias(name) for name, rule_id in rules.items()]
    return matches.groupBy(*flow).agg(*seen).filter(F.expr(expression))


def shown_matches(matches: DataFrame, spec: InspectSpec, order: Sequence[str]) -> DataFrame:
    """Matches that a report shows under the display limits of the run."""
    from wiresift.operators.scope import clip, limit_report

    tcp = limit_report(matches.filter(F.col("proto") == "TCP"), spec.max_disp_streams, tuple(order))
    udp = limit_report(matches.filter(F.col("proto") == "UDP"), spec.max_disp_datagrams, tuple(order))
    shown = tcp.unionByName(udp)
    return shown.withColumn("data", clip(F.col("data"), spec.max_disp_bytes)) if "data" in shown.columns else shown
