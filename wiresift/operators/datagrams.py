"""Inspection of buffers that stand alone: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.functions.bytestr import byte_text
from wiresift.operators.matchers import all_hits, first_hit, no_hit
from wiresift.operators.scope import needed_directions, scope, scope_base
from wiresift.spec import CTS, STC, InspectSpec, Rule


def per_direction(spec: InspectSpec, test) -> Column:
    """Apply ``test(rules)`` with the rules of each row's direction."""
    out = no_hit()
    cts, stc = spec.for_direction(CTS), spec.for_direction(STC)
    if cts == stc and cts:
        return test(cts)
    branch = None
    for name, rules in ((CTS, cts), (STC, stc)):
        if rules:
            cond = F.col("direction") == name
            branch = F.when(cond, test(rules)) if branch is None else branch.when(cond, test(rules))
    return out if branch is None else branch


def inspect_datagrams(df: DataFrame, spec: InspectSpec, keep: Sequence[str]) -> DataFrame:
    """First hit of each datagram on its own.

    ``df`` has ``payload`` and ``direction``. Offsets in the result count from
    the start of the datagram.
    """
    scoped = needed_directions(df, spec).withColumn("_text", byte_text(F.col("payload")))
    scoped = scoped.withColumns({
        "_buf": scope(F.col("_text"), spec),
        "_base": scope_base(F.length("_text"), spec),
    })
    found = scoped.withColumn(
        "_hit", per_direction(spec, lambda rules: first_hit(F.col("_buf"), rules, spec)))
    return found.filter(F.col("_hit").isNotNull()).select(*keep, *_span_columns())


def inspect_all_rules(df: DataFrame, rules: Sequence[Rule], spec: InspectSpec,
                      keep: Sequence[str]) -> DataFrame:
    """One row for every rule of the row's direction that hits, not only the first."""
    scoped = df.withColumn("_text", byte_text(F.col("payload")))
    scoped = scoped.withColumns({
        "_buf": scope(F.col("_text"), spec),
        "_base": scope_base(F.length("_text"), spec),
    })
    found = scoped.withColumn("_hit", F.explode(all_hits(F.col("_buf"), rules, spec)))
    return found.select(*keep, *_span_columns())


def _span_columns() -> list[Column]:
    hit, base = F.col("_hit"), F.col("_base")
    return [
        hit["rule_id"].alias("rule_id"),
        hit["mode"].alias("mode"),
        (base + hit["start"]).alias("start_off"),
        (base + hit["end"]).alias("end_off"),
        (hit["end"] - hit["start"]).alias("size"),
        hit["detail"].alias("detail"),
        F.substring(F.col("payload"), (base + hit["start"] + 1).cast("int"),
                    (hit["end"] - hit["start"]).cast("int")).alias("data"),
    ]
