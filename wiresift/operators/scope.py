"""Which bytes, rows and flows are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.spec import InspectSpec


def scope_base(size: Column, spec: InspectSpec) -> Column:
    """Bytes to skip: the offset, unless nothing would be left."""
    if spec.offset <= 0:
        return F.lit(0).cast("bigint")
    return F.when(size > spec.offset, F.lit(spec.offset)).otherwise(F.lit(0)).cast("bigint")


def scope_end(base: Column, size: Column, spec: InspectSpec) -> Column:
    """End of the inspected slice: ``depth`` bytes after ``base`` or all there is."""
    if spec.depth <= 0:
        return size.cast("bigint")
    return F.least(base + spec.depth, size).cast("bigint")


def scope(buf: Column, spec: InspectSpec) -> Column:
    """The slice of one buffer that rules see."""
    size = F.length(buf)
    base = scope_base(size, spec)
    return F.substring(buf, (base + 1).cast("int"), (scope_end(base, size, spec) - base).cast("int"))


def prefilter(packets: DataFrame, condition: Column | str) -> DataFrame:
    """Capture filter: a predicate on header columns, pushed to the scan."""
    return packets.filter(condition)


def needed_directions(df: DataFrame, spec: InspectSpec) -> DataFrame:
    """Drop directions that no rule looks at, before any bytes are shuffled."""
    wanted = spec.directions()
    if len(wanted) == 2:
        return df.filter(F.col("direction").isin("CTS", "STC"))
    return df.filter(F.col("direction").isin(*wanted))


def limit_datagrams(df: DataFrame, n: int, order: str = "pkt_seq") -> DataFrame:
    """The first ``n`` datagrams in arrival order; 0 means all."""
    return df if n <= 0 else df.orderBy(order).limit(n)


def limit_chunks(chunks: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The first ``n`` delivered stream chunks over all flows; 0 means all."""
    return chunks if n <= 0 else chunks.orderBy(*order).limit(n)


def limit_streams(df: DataFrame, flows: DataFrame, n: int, order: str, key: str = "flow_id") -> DataFrame:
    """Rows of the first ``n`` flows; 0 means all."""
    if n <= 0:
        return df
    first = flows.orderBy(order).limit(n).select(key)
    return df.join(first, key, "left_semi")


def limit_report(matches: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """Rows shown in a report; counts and summaries use the full matches."""
    return matches if n <= 0 else matches.orderBy(*order).limit(n)


def clip(data: Column, n: int) -> Column:
    """First ``n`` bytes for display; 0 means all."""
    return data if n <= 0 else F.substring(data, 1, n)
