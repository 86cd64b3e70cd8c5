"""Patterns with unbounded ``.*`` gaps, on flows longer than one block.

``X.*Y`` can span a whole stream, yet whether and where it matches follows from
the places of its fixed-length pieces: the first X, the first Y after it, and
so on. Each piece is looked for in all blocks in parallel; only positions are
brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift import dialect
from wiresift.functions.bytestr import let
from wiresift.session import cut
from wiresift.spec import InspectSpec, Rule, context_free

FLOW = ["flow_id", "direction"]


def gap_pieces(pattern: str) -> list[str] | None:
    """Pieces of a pattern between its top-level ``.*``, or None if it is not of that kind.

    Every piece must have one fixed length and not look around itself. A first
    or last piece may be empty.
    """
    if "(?" in pattern:
        return None
    pieces, start, depth, in_class, i = [], 0, 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]" or pattern[i - 1] == "["
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0 and c == "|":
            return None
        elif depth == 0 and pattern.startswith(".*", i):
            if pattern[i + 2:i + 3] in ("?", "+", "{", "*"):
                return None
            pieces.append(pattern[start:i])
            start, i = i + 2, i + 2
            continue
        i += 1
    pieces.append(pattern[start:])
    if len(pieces) == 1:
        return None
    for n, piece in enumerate(pieces):
        if not piece and n not in (0, len(pieces) - 1):
            return None
        if not context_free(piece) or _width(piece) is None:
            return None
    return pieces


def _width(piece: str) -> int | None:
    low, high = dialect.parsed(piece).getwidth()
    return int(low) if low == high else None


def takes_gaps(rule: Rule, spec: InspectSpec) -> bool:
    return (rule.mode == "regex" and "s" in rule.flags and not spec.invert and not spec.offset
            and not spec.depth and gap_pieces(rule.pattern) is not None)


def tail_bytes(rule: Rule) -> int:
    """Bytes of context before a block that the pieces of a rule need."""
    return max(max(_width(p) for p in gap_pieces(rule.pattern)) - 1, 0)


def _first_from(blocks: DataFrame, starts: DataFrame, pattern: str, width: int) -> DataFrame:
    """End of the first occurrence of a piece from ``at`` on, per flow direction."""
    text, origin = F.col("text"), F.col("origin")
    low = F.greatest(F.col("at"), origin)
    rest = F.substring(text, (low - origin + 1).cast("int"), F.length(text))
    near = blocks.join(starts, FLOW).filter(origin + F.length(text) >= F.col("at") + width)
    found = near.withColumn("_place", let(rest, lambda r: F.when(
        r.rlike(pattern), low + F.regexp_instr(r, F.lit(pattern)) - 1)))
    return found.filter(F.col("_place").isNotNull()).groupBy(*FLOW).agg(
        F.min("_place").alias("place"), F.first("first_start").alias("first_start"))


def _last_end(text: Column, origin: Column, pattern: str) -> Column:
    """End of the last occurrence of a fixed-length piece in ``text``."""
    before = F.length(F.regexp_extract(text, f"(?s)^(.*)(?:{pattern})", 1))
    size = F.length(F.regexp_substr(F.substring(text, before + 1, F.length(text)), F.lit(pattern)))
    return origin + before + size


def gap_first(blocks: DataFrame, rule: Rule) -> DataFrame:
    """First chunk, with its span, by which the whole pattern has occurred.

    ``blocks`` has the joined ``text`` with enough context, ``base_off``,
    ``tail`` and ``parts``.
    """
    pieces = gap_pieces(rule.pattern)
    blocks = cut(blocks.withColumn("origin", F.col("base_off") - F.length("tail")))
    flows = blocks.select(*FLOW).distinct()
    zero = F.lit(0).cast("bigint")
    state = flows.select(*FLOW, zero.alias("at"), F.lit(None).cast("bigint").alias("first_start"))
    if not pieces[0]:
        state = state.withColumn("first_start", zero)
    for piece in pieces:
        if piece:
            pattern, width = dialect.java(piece, rule.flags), _width(piece)
            hit = _first_from(blocks, state, pattern, width)
            state = hit.select(*FLOW, (F.col("place") + width).alias("at"),
                               F.coalesce("first_start", "place").alias("first_start"))
    # The chunk holding the last needed byte decides; a stream's first chunk
    # does if nothing is needed.
    done = state.select(*FLOW, F.greatest(F.col("at"), F.lit(1)).alias("at"), "first_start")
    own = F.length("text") - F.length("tail")
    deciding = blocks.join(done, FLOW).filter(
        (F.col("base_off") < F.col("at")) & (F.col("at") <= F.col("base_off") + own))
    start = F.struct(F.col("base_off").alias("end"), F.lit(None).cast("bigint").alias("chunk_no"))

    def step(seen: Column, part: Column) -> Column:
        end = F.when(seen["chunk_no"].isNull(), seen["end"] + F.length(part["buf"])).otherwise(seen["end"])
        return let(end, lambda e: F.struct(e.alias("end"), F.coalesce(
            seen["chunk_no"], F.when(e >= F.col("at"), part["chunk_no"].cast("bigint"))).alias("chunk_no")))

    found = deciding.withColumn("_c", F.aggregate("parts", start, step))
    prefix = F.substring("text", F.lit(1), (F.col("_c.end") - F.col("origin")).cast("int"))
    last = pieces[-1]
    end = F.col("_c.end") if not last else let(prefix, lambda p: _last_end(
        p, F.col("origin"), dialect.java(last, rule.flags)))
    return found.select(
        *FLOW, F.col("_c.chunk_no").alias("chunk_no"), F.lit(rule.rule_id).cast("int").alias("rule_id"),
        F.lit("regex").alias("mode"), F.col("first_start").alias("start_off"), end.alias("end_off"),
        F.lit(None).cast("string").alias("detail"))
