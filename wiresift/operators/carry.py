"""Stream inspection across block borders, for flows longer than one block.

A pattern without a length bound can start in one block and end in another.
Every block is first searched as if nothing were open when it starts. What it
leaves open at its end (the text from the leftmost place where a match may
still be completed) is handed to the next block; blocks that were searched
with another beginning than the one they are now given are searched again,
until nothing changes. Blocks whose predecessor leaves nothing open, which is
the usual case, are searched once, all in parallel.

Python's ``regex`` reports such open partial matches; Spark's own functions do
not. Its work per row is bounded by one block plus the open text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.session import cut
from wiresift.spec import CTS, STC, InspectSpec, Rule, context_free

KEYS = ["flow_id", "direction", "block"]
HITS = ("array<struct<chunk_no:bigint,rule_id:int,mode:string,"
        "start_off:bigint,end_off:bigint,detail:string>>")
STATE = f"hits {HITS}, in_skip bigint, in_off bigint, in_buf binary, " \
        "out_skip bigint, out_off bigint, out_buf binary"


def long_blocks(chunks: DataFrame, per_block: int) -> DataFrame:
    """Blocks with their chunks in order and the stream offset they start at."""
    size = F.octet_length("payload")
    rows = chunks.filter(size > 0).select(
        "flow_id", "direction", F.floor(F.col("chunk_no") / per_block).cast("bigint").alias("block"),
        F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("payload").alias("data"))
    blocks = rows.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("chunk_no", "data"))).alias("parts"),
        F.sum(F.octet_length("data")).cast("bigint").alias("len"))
    flow = Window.partitionBy("flow_id", "direction").orderBy("block")
    sums = rows.groupBy(*KEYS).agg(F.sum(F.octet_length("data")).alias("len")).select(
        *KEYS,
        F.coalesce(F.sum("len").over(flow.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("bigint").alias("base_off"),
        F.row_number().over(flow).cast("bigint").alias("ordinal"))
    return blocks.drop("len").join(sums, KEYS)


class BlockSearch:
    """Search of one block from a given beginning; pickled into the tasks."""

    def __init__(self, spec: InspectSpec, multi: bool) -> None:
        self.spec = spec
        self.multi = multi

    def compiled(self, direction: str) -> list[tuple[Rule, list, object]]:
        import regex

        out = []
        for rule in self.spec.for_direction(direction):
            if rule.mode == "regex":
                flags = sum(f for k, f in {"s": regex.S, "m": regex.M, "i": regex.I}.items()
                            if k in rule.flags)
                out.append((rule, [regex.compile(rule.pattern.encode("utf-8"), flags)]))
            elif rule.mode == "bytesig":
                out.append((rule, [regex.compile(regex.escape(bytes.fromhex(rule.pattern)))]))
            elif rule.mode == "signature":
                out.append((rule, [_string_search(s) for s in rule.strings]))
            else:
                out.append((rule, [rule.pattern.encode("utf-8")]))
        return out

    def run(self, direction: str, rules: list, base_off: int, parts: list[tuple[int, bytes]],
            skip: int, off: int, buf: bytes) -> tuple[list, int, int, bytes]:
        """Hits of the block and what it leaves open: (skip, offset of the text, text)."""
        spec, hits, end = self.spec, [], base_off
        for chunk_no, data in parts:
            buf, end = buf + data, end + len(data)
            base = spec.offset if 0 < spec.offset < end else 0
            low = max(base + skip, off)
            stop = min(base + skip + spec.depth, end) if spec.depth else end
            view = buf[max(low - off, 0):max(stop - off, 0)]
            found = None
            for rule, searches in rules:
                found = _hit(rule, searches, view, spec)
                if found and spec.invert and rule.mode == "signature":
                    # A file hits when none of its rules holds.
                    found = all(_hit(r, s, view, spec) for r, s in rules
                                if r.mode == "signature" and r.source_file == rule.source_file) and found
                if found:
                    break
            if found:
                start, stop_at, whole, detail = found
                first = base + skip if whole else low + start
                hits.append({"chunk_no": chunk_no, "rule_id": rule.rule_id, "mode": rule.mode,
                             "start_off": first, "end_off": low + stop_at, "detail": detail})
                if not self.multi:
                    return hits, 0, end, b""
                skip = low + stop_at - base
                buf, off = buf[max(low + stop_at - off, 0):], low + stop_at
                continue
            keep = low + min((_open(r, s, view, spec) for r, s in rules), default=len(view))
            if spec.depth and stop < end:
                keep = end
            if keep > off:
                buf, off = buf[keep - off:], keep
        if not self.whole_spans() and spec.offset == 0:
            skip = min(off, end)
        return hits, skip, off, buf

    def whole_spans(self) -> bool:
        return self.spec.invert or any(r.mode == "fuzzy" for r in self.spec.rules)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {d: self.compiled(d) for d in (CTS, STC)}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                parts = [(int(p["chunk_no"]), bytes(p["data"])) for p in row.parts]
                hits, skip, off, buf = self.run(
                    row.direction, rules[row.direction], int(row.base_off), parts,
                    int(row.in_skip), int(row.in_off), bytes(row.in_buf))
                out.append((row.flow_id, row.direction, row.block, hits, row.in_skip, row.in_off,
                            row.in_buf, skip, off, buf))
            yield pd.DataFrame(out, columns=[
                *KEYS, "hits", "in_skip", "in_off", "in_buf", "out_skip", "out_off", "out_buf"])


def _string_search(string):
    import regex

    if string.kind == "regex":
        return regex.compile(string.pattern.encode("utf-8"), regex.S)
    raw = bytes.fromhex(string.pattern) if string.kind == "hex" else string.pattern.encode("utf-8")
    return regex.compile(regex.escape(raw))


def _hit(rule: Rule, searches: list, view: bytes, spec: InspectSpec):
    """(start, end, whole, detail) within ``view``, or None."""
    if rule.mode == "fuzzy":
        ratio = _ratio(view, searches[0])
        if (ratio < rule.threshold) != spec.invert:
            return None
        sign = "|" if spec.invert else ">="
        return 0, len(view), True, f"(ratio: {ratio} {sign} threshold: {rule.threshold})"
    if rule.mode == "signature":
        last = [m[-1] for m in (list(s.finditer(view, overlapped=True)) for s in searches) if m]
        if (len(last) >= rule.needed_strings()) == spec.invert:
            return None
        return (0, len(view), True, None) if spec.invert else (*last[-1].span(), False, None)
    match = searches[0].search(view)
    if (match is not None) == spec.invert:
        return None
    if spec.invert:
        return 0, len(view), True, None
    if rule.mode == "bytesig":
        return match.start(), len(view), False, None
    if spec.drop_empty and match.end() == match.start():
        return None
    return match.start(), match.end(), False, None


def _open(rule: Rule, searches: list, view: bytes, spec: InspectSpec) -> int:
    """Leftmost place of ``view`` that a later hit may still need."""
    if spec.invert or rule.mode == "signature":
        return 0
    if rule.mode == "fuzzy":
        return max(len(view) - len(searches[0]), 0)
    if rule.mode == "regex" and not context_free(rule.pattern):
        return 0
    part = searches[0].search(view, partial=True)
    return part.start() if part is not None else len(view)


def _ratio(view: bytes, pattern: bytes) -> int:
    short, long_ = sorted((view, pattern), key=len)
    if not short:
        return 0
    size = len(short)
    best = size
    for i in range(len(long_) - size + 1):
        best = min(best, _edits(short, long_[i:i + size]))
    return int(100.0 * (size - best) / size + 0.5)


def _edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def settled(blocks: DataFrame, search: BlockSearch) -> DataFrame:
    """Search all blocks until each has been given what its predecessor leaves open."""
    blocks = cut(blocks)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in KEYS)
    schema = f"{head}, {STATE}"
    fresh = blocks.withColumns({
        "in_skip": F.col("base_off"), "in_off": F.col("base_off"), "in_buf": F.lit(b"")})
    state = cut(fresh.mapInPandas(search, schema))
    order = blocks.select(*KEYS, "ordinal")
    while True:
        given = state.join(order, KEYS).select(
            "flow_id", "direction", (F.col("ordinal") + 1).alias("ordinal"),
            F.col("out_skip").alias("g_skip"), F.col("out_off").alias("g_off"),
            F.col("out_buf").alias("g_buf"))
        used = state.join(order, KEYS).select(*KEYS, "ordinal", "in_skip", "in_off", "in_buf")
        differs = (F.col("in_skip") != F.col("g_skip")) | (F.col("in_off") != F.col("g_off")) | (
            F.col("in_buf") != F.col("g_buf"))
        stale = used.join(given, ["flow_id", "direction", "ordinal"]).filter(differs)
        again = cut(stale.select(*KEYS, F.col("g_skip").alias("in_skip"),
                                 F.col("g_off").alias("in_off"), F.col("g_buf").alias("in_buf")))
        if again.isEmpty():
            return state
        redone = blocks.join(again, KEYS).mapInPandas(search, schema)
        state = cut(state.join(again.select(*KEYS), KEYS, "left_anti").unionByName(redone))


def _hit_columns() -> list[Column]:
    return [F.col(f"_h.{c}").alias(c)
            for c in ("chunk_no", "rule_id", "mode", "start_off", "end_off", "detail")]


def carry_first(chunks: DataFrame, spec: InspectSpec, per_block: int) -> DataFrame:
    """First hit of each rule per flow direction, for rules without a length bound."""
    found: DataFrame | None = None
    blocks = long_blocks(chunks, per_block)
    for rule in spec.ordered:
        one = replace(spec, rules=(rule,))
        part = blocks if rule.direction == "ANY" else blocks.filter(F.col("direction") == rule.direction)
        state = settled(part, BlockSearch(one, multi=False))
        rows = state.select("flow_id", "direction", F.explode("hits").alias("_h")).select(
            "flow_id", "direction", *_hit_columns())
        best = rows.groupBy("flow_id", "direction").agg(F.min_by(F.struct(
            "chunk_no", "rule_id", "mode", "start_off", "end_off", "detail"), "chunk_no").alias("m"))
        best = best.select("flow_id", "direction", "m.*")
        found = best if found is None else found.unionByName(best)
    return found


def carry_multi(chunks: DataFrame, spec: InspectSpec, per_block: int) -> DataFrame:
    """Every hit of long flows, numbered per flow direction."""
    state = settled(long_blocks(chunks, per_block), BlockSearch(spec, multi=True))
    flow = Window.partitionBy("flow_id", "direction").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = state.select(*KEYS, "hits", F.coalesce(
        F.sum(F.size("hits")).over(flow), F.lit(0)).alias("_before"))
    return before.select("flow_id", "direction", "_before", F.posexplode("hits").alias("_pos", "_h")).select(
        "flow_id", "direction", "_h.chunk_no",
        (F.col("_before") + F.col("_pos") + 1).cast("bigint").alias("match_no"),
        *_hit_columns()[1:])
