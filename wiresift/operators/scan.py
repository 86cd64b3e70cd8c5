"""Running aggregates that no single hot key can pile into one task.

A window over ``partitionBy(flow)`` puts a whole flow into one task. Here the
rows of a flow are cut into blocks by their order key, so a task sorts at most
one (flow, block). Blocks are summed up first (map-side combined), the small
table of block totals is run over in order, and each block's rows start from
what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
PACKETS_PER_BLOCK = 1 << 20
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running aggregate; ``inclusive`` counts the row itself."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def block_of(order: Column, rows: int | None = PACKETS_PER_BLOCK) -> Column | None:
    """Block number of a dense, non-negative order key; None if there is one block only."""
    return None if rows is None else F.floor(order / F.lit(rows)).cast("bigint")


def block_rows(table: DataFrame, order: str = "pkt_seq", rows: int = PACKETS_PER_BLOCK) -> int | None:
    """Rows per block, or None where one block holds the whole table.

    Reads the order column of ``table`` once; give it a table as it is stored.
    """
    low, high = table.agg(F.min(order), F.max(order)).first()
    return None if high is None or (low >= 0 and high < rows) else rows


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None,
            what: Sequence[Running]) -> DataFrame:
    """Add running aggregates per ``keys`` in the order of ``order``.

    ``block`` must not decrease along ``order``. Keys must not be null. Without
    a block, all rows are known to fit one, and a plain window does.
    """
    if block is None:
        flow = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({w.name: _plain(w, flow) for w in what})
    df = df.withColumn(BLOCK, block)
    group = [*keys, BLOCK]
    totals = df.groupBy(*group).agg(
        *[_AGG[w.how](w.value).alias(f"_t_{w.name}") for w in what])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = totals.select(
        *group, *[_AGG[w.how](f"_t_{w.name}").over(before).alias(f"_c_{w.name}") for w in what])
    inside = Window.partitionBy(*group).orderBy(*order)
    local = df.withColumns({
        f"_l_{w.name}": _AGG[w.how](w.value).over(
            inside.rowsBetween(Window.unboundedPreceding, 0 if w.inclusive else -1))
        for w in what})
    joined = local.join(carry, group)
    out = []
    for w in what:
        c, l = F.col(f"_c_{w.name}"), F.col(f"_l_{w.name}")
        if w.how == "sum":
            merged = F.coalesce(c, F.lit(0)) + F.coalesce(l, F.lit(0))
        else:
            merged = (F.greatest if w.how == "max" else F.least)(c, l)
        out.append(merged.alias(w.name))
    return joined.select(*[c for c in df.columns if c != BLOCK], *out)


def _plain(w: Running, flow: WindowSpec) -> Column:
    value = _AGG[w.how](w.value).over(
        flow.rowsBetween(Window.unboundedPreceding, 0 if w.inclusive else -1))
    return F.coalesce(value, F.lit(0)) if w.how == "sum" else value


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None,
             name: str) -> DataFrame:
    """1-based position of each row among the rows with equal ``keys``."""
    return running(df, keys, order, block, [Running(name, "sum", F.lit(1))])
