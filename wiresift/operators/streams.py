"""Inspection of byte streams that arrive in chunks.

After each chunk the whole of its direction's stream so far is searched. The
chunks of a (flow, direction) are handled in blocks of consecutive chunks, so
that a flow of any length is spread over many tasks. The first search of a
block is one regex pass over its joined text; only a block that can hit is
searched again prefix by prefix, up to its first hit.

Flows longer than one block need what came before. Where a rule bounds the
length of a match, a few bytes are enough; the others are followed across
blocks by :mod:`wiresift.operators.gaps`, :mod:`~wiresift.operators.carry` and
:mod:`~wiresift.operators.signature_streams`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.bytestr import byte_text, let
from wiresift.operators.carry import carry_first, carry_multi
from wiresift.operators.datagrams import per_direction
from wiresift.operators.gaps import gap_first, tail_bytes, takes_gaps
from wiresift.operators.matchers import first_hit, may_hit, reach
from wiresift.operators.scan import Running, block_of, running
from wiresift.operators.scope import needed_directions, scope_base, scope_end
from wiresift.operators.signature_streams import signature_first
from wiresift.spec import ANY, InspectSpec, Rule

CHUNKS_PER_BLOCK = 256
MATCH_COLUMNS = ["flow_id", "direction", "chunk_no", "match_no", "rule_id", "mode",
                 "start_off", "end_off", "size", "detail"]


def stream_blocks(chunks: DataFrame, per_block: int) -> DataFrame:
    """(flow, direction, block) rows with their chunks in order.

    ``chunks`` has flow_id, direction, chunk_no (dense within the flow, from
    0 or 1) and payload. At most ``per_block`` chunks meet in one row.
    """
    rows = chunks.select(
        "flow_id", "direction", "chunk_no",
        F.floor(F.col("chunk_no") / per_block).cast("bigint").alias("block"),
        byte_text(F.col("payload")).alias("buf"),
    ).filter(F.length("buf") > 0)
    return rows.groupBy("flow_id", "direction", "block").agg(
        F.sort_array(F.collect_list(F.struct("chunk_no", "buf"))).alias("parts"))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["buf"]), "")


def is_long(chunks: DataFrame, per_block: int) -> bool:
    """Whether some flow exceeds one block; a filter the scan can answer from statistics."""
    return not chunks.filter(F.col("chunk_no") >= per_block).select("flow_id").isEmpty()


def block_context(chunks: DataFrame, per_block: int, tail: int) -> DataFrame:
    """Per (flow, direction, block): bytes before it and the last ``tail`` of them.

    Each block contributes a sum and at most ``tail`` bytes. Every listed block
    holds at least one byte, so ``tail`` earlier blocks are enough.
    """
    size = F.octet_length("payload")
    own = chunks.filter(size > 0).select(
        "flow_id", "direction", "chunk_no", size.alias("len"),
        F.floor(F.col("chunk_no") / per_block).cast("bigint").alias("block"),
        F.right(byte_text(F.col("payload")), F.lit(tail)).alias("buf"))
    sums = own.groupBy("flow_id", "direction", "block").agg(
        F.sum("len").alias("len"),
        F.right(_joined(F.sort_array(F.collect_list(F.struct("chunk_no", "buf")))),
                F.lit(tail)).alias("own_tail"))
    flow = Window.partitionBy("flow_id", "direction").orderBy("block")
    return sums.select(
        "flow_id", "direction", "block",
        F.coalesce(F.sum("len").over(flow.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("base_off"),
        F.right(F.array_join(F.collect_list("own_tail").over(flow.rowsBetween(-max(tail, 1), -1)), ""),
                F.lit(tail)).alias("tail"))


def with_context(blocks: DataFrame, chunks: DataFrame, per_block: int, tail: int,
                  long_flows: bool) -> DataFrame:
    if long_flows:
        blocks = blocks.join(block_context(chunks, per_block, tail), ["flow_id", "direction", "block"])
    else:
        blocks = blocks.withColumns({
            "base_off": F.lit(0).cast("bigint"), "tail": F.lit("")})
    return blocks.withColumn("text", F.concat("tail", _joined(F.col("parts"))))


def _prefix_hit(rules: Sequence[Rule], spec: InspectSpec, text: Column, origin: Column,
                skip: Column, end: Column, scan: Column | None = None) -> Column:
    """Hit within stream bytes [base + skip, end), where ``text`` starts at ``origin``.

    Spans of the result are absolute.
    """
    base = scope_base(end, spec) + skip
    stop = scope_end(base, end, spec)
    low = F.greatest(base, origin) if scan is None else F.greatest(base, origin, scan)
    piece = F.substring(text, (low - origin + 1).cast("int"), F.greatest(stop - low, F.lit(0)).cast("int"))

    def absolute(hit: Column) -> Column:
        start = F.when(hit["whole"], base).otherwise(low + hit["start"])
        return F.when(hit.isNotNull(), F.struct(
            hit["rule_id"].alias("rule_id"), hit["mode"].alias("mode"), start.alias("start_off"),
            (low + hit["end"]).alias("end_off"), hit["detail"].alias("detail")))

    return let(piece, lambda b: let(first_hit(b, rules, spec), absolute))


SPAN = "struct<rule_id:int,mode:string,start_off:bigint,end_off:bigint,detail:string>"


def _first_in_block(rules: Sequence[Rule], spec: InspectSpec) -> Column:
    """First chunk of the block after which some rule hits: struct (chunk_no, span)."""
    text, origin = F.col("text"), F.col("base_off") - F.length("tail")
    start = F.struct(
        F.col("base_off").alias("end"),
        F.lit(None).cast("bigint").alias("chunk_no"), F.lit(None).cast(SPAN).alias("span"))

    def step(state: Column, part: Column) -> Column:
        end = state["end"] + F.length(part["buf"])
        span = F.coalesce(state["span"], _prefix_hit(
            rules, spec, text, origin, F.lit(0).cast("bigint"), end))
        return let(span, lambda s: F.struct(
            end.alias("end"),
            F.coalesce(state["chunk_no"], F.when(s.isNotNull(), part["chunk_no"].cast("bigint"))).alias("chunk_no"),
            s.alias("span")))

    folded = F.aggregate(F.col("parts"), start, step)
    return F.when(may_hit(text, rules, spec), folded)


def _split_rules(spec: InspectSpec) -> dict[str, list[Rule]]:
    """Rules by how they are followed across the blocks of a long flow."""
    kinds: dict[str, list[Rule]] = {"bounded": [], "gaps": [], "open": [], "signature": []}
    for rule in spec.ordered:
        if rule.mode == "signature" and not spec.invert:
            kinds["signature"].append(rule)
        elif reach(rule, spec) is not None:
            kinds["bounded"].append(rule)
        elif takes_gaps(rule, spec):
            kinds["gaps"].append(rule)
        else:
            kinds["open"].append(rule)
    return kinds


def inspect_streams(chunks: DataFrame, spec: InspectSpec,
                    per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """Matches of TCP-like streams.

    First-match mode gives one row per flow: the earliest chunk, in either
    direction, after which a rule hits. Multi-match mode gives every hit, with
    the bytes up to the end of a hit skipped from then on.
    """
    if not spec.rules:
        raise ValueError("no rules to look for; line_mode shows chunks as they come")
    chunks = needed_directions(chunks, spec)
    long_flows = is_long(chunks, per_block)
    if spec.multi_match:
        return _multi(chunks, spec, per_block, long_flows)
    return _first(chunks, spec, per_block, long_flows)


def _first(chunks: DataFrame, spec: InspectSpec, per_block: int, long_flows: bool) -> DataFrame:
    found = []
    if long_flows:
        kinds = _split_rules(spec)
        if kinds["bounded"]:
            found.append(_bounded_first(chunks, _only(spec, kinds["bounded"]), per_block, True))
        rest = _only(spec, [r for r in spec.ordered if r not in kinds["bounded"]])
        if rest.rules:
            beyond, short = split_long(chunks, per_block)
            found.append(_bounded_first(short, rest, per_block, False))
            found.extend(_across_blocks(beyond, spec, kinds, per_block))
    else:
        found.append(_bounded_first(chunks, spec, per_block, False))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    rank = F.create_map(*[F.lit(x).cast("int") for i, r in enumerate(spec.ordered) for x in (r.rule_id, i)])
    row = F.struct("direction", "chunk_no", "rule_id", "mode", "start_off", "end_off", "detail")
    order = F.struct(F.col("chunk_no"), F.element_at(rank, F.col("rule_id")))
    best = hits.groupBy("flow_id").agg(F.min_by(row, order).alias("m"))
    return best.select("flow_id", "m.*").withColumns({
        "match_no": F.lit(1).cast("bigint"), "size": F.col("end_off") - F.col("start_off"),
    }).select(*MATCH_COLUMNS)


def first_hits(chunks: DataFrame, spec: InspectSpec, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """The first match of each rule in each flow, for expressions over rules."""
    found = None
    for rule in spec.ordered:
        one = inspect_streams(chunks, replace(spec, rules=(rule,), multi_match=False), per_block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no rules to look for")
    return found


def _only(spec: InspectSpec, rules: Sequence[Rule]) -> InspectSpec:
    return replace(spec, rules=tuple(rules))


def split_long(chunks: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of flows beyond one block, and of all others."""
    ids = chunks.filter(F.col("chunk_no") >= per_block).select("flow_id").distinct()
    return chunks.join(ids, "flow_id", "left_semi"), chunks.join(ids, "flow_id", "left_anti")


def _across_blocks(chunks: DataFrame, spec: InspectSpec, kinds: dict[str, list[Rule]],
                   per_block: int) -> list[DataFrame]:
    """First hits in long flows of rules without a length bound."""
    found = []
    for rule in kinds["gaps"]:
        mine = chunks if rule.direction == ANY else chunks.filter(F.col("direction") == rule.direction)
        blocks = with_context(stream_blocks(mine, per_block), mine, per_block, tail_bytes(rule), True)
        found.append(gap_first(blocks, rule))
    if kinds["open"]:
        found.append(carry_first(chunks, _only(spec, kinds["open"]), per_block))
    if kinds["signature"]:
        found.append(signature_first(chunks, _only(spec, kinds["signature"]), per_block))
    return found


def _bounded_first(chunks: DataFrame, spec: InspectSpec, per_block: int, long_flows: bool) -> DataFrame:
    """First hit of each block; the caller keeps the earliest."""
    reaches = [reach(r, spec) or 1 for r in spec.rules]
    head = spec.offset + max(reaches)
    tail = (head if spec.invert else max(reaches) - 1) if long_flows else 0
    blocks = with_context(stream_blocks(chunks, per_block), chunks, per_block, tail, long_flows)
    if long_flows and spec.invert:
        # A pattern found in some prefix stays found in all longer ones, so only
        # the beginning of a stream can be without it.
        blocks = blocks.filter(F.col("base_off") < head)
    test = per_direction(spec, lambda rules: _first_in_block(rules, spec))
    return blocks.withColumn("_f", test).filter(F.col("_f.span").isNotNull()).select(
        "flow_id", "direction", F.col("_f.chunk_no").alias("chunk_no"), "_f.span.*")


def first_per_direction(chunks: DataFrame, spec: InspectSpec, per_block: int) -> DataFrame:
    """Earliest chunk per (flow, direction) after which the single rule of ``spec`` hits."""
    rule, = spec.rules
    if reach(rule, spec) is None:
        found, *_ = _across_blocks(chunks, spec, _split_rules(spec), per_block)
    else:
        found = _bounded_first(chunks, spec, per_block, True)
    return found.groupBy("flow_id", "direction").agg(F.min("chunk_no").alias("chunk_no"))


def _multi_in_block(rules: Sequence[Rule], spec: InspectSpec) -> Column:
    """All hits of a flow direction that fits one block, in chunk order."""
    text = F.col("text")
    bounds = [reach(r, spec) for r in rules]
    # Whether a rule misses follows from all bytes, not from the newest ones.
    plain = not spec.invert and spec.offset == 0 and spec.depth == 0 and all(
        b is not None and r.mode != "fuzzy" for b, r in zip(bounds, rules))
    tail = max([b or 0 for b in bounds], default=0)
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("end"), zero.alias("skip"), zero.alias("scan"),
                     F.array().cast(f"array<struct<chunk_no:bigint,span:{SPAN}>>").alias("hits"))

    def step(state: Column, part: Column) -> Column:
        end = state["end"] + F.length(part["buf"])
        span = _prefix_hit(rules, spec, text, zero, state["skip"], end, state["scan"])

        def after(s: Column) -> Column:
            skip = F.when(s.isNotNull(), s["end_off"] - scope_base(end, spec)).otherwise(state["skip"])
            quiet = F.greatest(skip, end - max(tail - 1, 0)) if plain else zero
            return F.struct(
                end.alias("end"), skip.alias("skip"),
                F.when(s.isNotNull(), zero).otherwise(quiet).alias("scan"),
                F.when(s.isNotNull(), F.concat(state["hits"], F.array(F.struct(
                    part["chunk_no"].cast("bigint").alias("chunk_no"), s.alias("span")))))
                .otherwise(state["hits"]).alias("hits"))

        return let(span, after)

    folded = F.aggregate(F.col("parts"), start, step, lambda s: s["hits"])
    return F.when(may_hit(text, rules, spec), folded)


def _multi(chunks: DataFrame, spec: InspectSpec, per_block: int, long_flows: bool) -> DataFrame:
    short = chunks
    found = None
    if long_flows:
        beyond, short = split_long(chunks, per_block)
        found = carry_multi(beyond, spec, per_block)
    blocks = with_context(stream_blocks(short, per_block), short, per_block, 0, False)
    hits = per_direction(spec, lambda rules: _multi_in_block(rules, spec))
    rows = blocks.select("flow_id", "direction", F.posexplode(hits).alias("_pos", "_h")).select(
        "flow_id", "direction", F.col("_h.chunk_no").alias("chunk_no"),
        (F.col("_pos") + 1).cast("bigint").alias("match_no"), "_h.span.*")
    if found is not None:
        rows = rows.unionByName(found)
    return rows.withColumn("size", F.col("end_off") - F.col("start_off")).select(*MATCH_COLUMNS)


def line_mode(chunks: DataFrame, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """No rules: every delivered chunk with its place in its direction's stream."""
    rows = chunks.withColumn("size", F.octet_length("payload").cast("bigint")).filter(F.col("size") > 0)
    block = block_of(F.col("chunk_no"), per_block if is_long(chunks, per_block) else None)
    placed = running(rows, ["flow_id", "direction"], ["chunk_no"], block, [Running("end_off", "sum", F.col("size"))])
    return placed.withColumn("start_off", F.col("end_off") - F.col("size"))
