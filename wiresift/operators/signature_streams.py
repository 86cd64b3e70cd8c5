"""Signature rules on flows longer than one block.

The strings of a rule may lie far apart, so each string is looked for on its
own. A rule holds from the chunk by which enough of its strings have occurred.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.functions.bytestr import let
from wiresift.operators.matchers import string_found, string_last, string_literal
from wiresift.operators.scope import scope_base, scope_end
from wiresift.spec import CTS, STC, InspectSpec, Rule, SignatureString, widest_match


def _as_rule(number: int, rule: Rule, string: SignatureString) -> Rule:
    if string.kind == "regex":
        return Rule(number, "regex", string.pattern, rule.direction, flags="s")
    return Rule(number, "bytesig", string_literal(string).encode("latin-1").hex(), rule.direction)


def signature_first(chunks: DataFrame, spec: InspectSpec, per_block: int) -> DataFrame:
    """First chunk per (flow, direction, rule) by which the rule holds, with its span."""
    from wiresift.operators import streams

    found = None
    for rule in spec.ordered:
        firsts = None
        for i, string in enumerate(rule.strings):
            one = replace(spec, rules=(_as_rule(i, rule, string),), multi_match=False, invert=False)
            hit = streams.first_per_direction(chunks, one, per_block).select(
                "flow_id", "direction", "chunk_no", F.lit(i).alias("ord"))
            firsts = hit if firsts is None else firsts.unionByName(hit)
        need = rule.needed_strings()
        held = firsts.groupBy("flow_id", "direction").agg(
            F.sort_array(F.collect_list(F.struct("chunk_no", "ord"))).alias("seen")).filter(
            F.size("seen") >= need).select(
            "flow_id", "direction", F.element_at("seen", need)["chunk_no"].alias("chunk_no"),
            F.col("seen"))
        held = held.withColumn("ord", F.array_max(F.transform(
            F.filter("seen", lambda s: s["chunk_no"] <= F.col("chunk_no")), lambda s: s["ord"]))).drop("seen")
        spans = _last_instance(chunks, held, rule, spec, per_block)
        found = spans if found is None else found.unionByName(spans)
    return found


def _last_instance(chunks: DataFrame, held: DataFrame, rule: Rule, spec: InspectSpec,
                   per_block: int) -> DataFrame:
    """Span of the last instance, up to the deciding chunk, of the rule's last string.

    Only the bytes within offset and depth count. A string without a length bound
    can reach over all of them, so they then meet in one row; a depth bounds it.
    """
    from wiresift.operators import streams

    hit = held.select("flow_id", "direction", F.col("chunk_no").alias("at"), "ord")
    seen = chunks.join(hit, ["flow_id", "direction"]).filter(F.col("chunk_no") <= F.col("at")).select(
        "flow_id", "direction", "chunk_no", "payload")
    sizes = seen.groupBy("flow_id", "direction").agg(F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))
    widths = [widest_match(s.pattern) if s.kind == "regex" else len(string_literal(s))
              for s in rule.strings]
    if any(w is None for w in widths):
        blocks = streams.with_context(streams.stream_blocks(seen, 1 << 40), seen, 1 << 40, 0, False)
    else:
        tail = max(max(widths) - 1, 0)
        blocks = streams.with_context(streams.stream_blocks(seen, per_block), seen, per_block, tail, True)
    base = scope_base(F.col("bytes"), spec)
    stop = scope_end(base, F.col("bytes"), spec)
    origin = F.col("base_off") - F.length("tail")
    low = F.greatest(base, origin)
    piece = F.substring("text", (low - origin + 1).cast("int"), F.greatest(stop - low, F.lit(0)).cast("int"))

    def last(text: Column) -> Column:
        return F.coalesce(*[
            F.when((F.col("ord") == i) & string_found(text, s), string_last(text, s))
            for i, s in enumerate(rule.strings)])

    found = let(let(piece, last), lambda s: F.when(s.isNotNull(), F.struct(
        (low + s["start"]).alias("start_off"), (low + s["end"]).alias("end_off"))))
    spans = blocks.join(hit, ["flow_id", "direction"]).join(sizes, ["flow_id", "direction"]).withColumn("_s", found)
    return spans.filter(F.col("_s").isNotNull()).groupBy("flow_id", "direction").agg(
        F.max("at").alias("chunk_no"), F.max("_s").alias("_s")).select(
        "flow_id", "direction", "chunk_no",
        F.lit(rule.rule_id).cast("int").alias("rule_id"), F.lit("signature").alias("mode"),
        "_s.start_off", "_s.end_off", F.lit(None).cast("string").alias("detail"))
