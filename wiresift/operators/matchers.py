"""Rules as column expressions over one buffer.

A buffer is text with one character per byte. Every expression gives a struct
(rule_id, mode, start, end, whole, detail) or null; ``start`` and ``end`` are
relative to the buffer, ``whole`` marks spans that cover all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiresift import dialect
from wiresift.functions.bytestr import let
from wiresift.spec import ANY, InspectSpec, Rule, SignatureString, context_free, widest_match

# Piece lengths, from coarse to fine, by which long texts are taken apart.
SEGMENTS = (1 << 17, 1 << 11, 1 << 6)
HIT = "struct<rule_id:int,mode:string,start:bigint,end:bigint,whole:boolean,detail:string>"


def no_hit() -> Column:
    return F.lit(None).cast(HIT)


def _hit(rule: Rule, start: Column, end: Column, whole: bool = False,
         detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule.rule_id).cast("int").alias("rule_id"),
        F.lit(rule.mode).alias("mode"),
        start.cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        F.lit(whole).alias("whole"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def regex_hit(buf: Column, rule: Rule, invert: bool = False, drop_empty: bool = False) -> Column:
    """Leftmost regex match, or (invert) the whole of a buffer without one."""
    pattern = dialect.java(rule.pattern, rule.flags)
    if invert:
        return F.when(~buf.rlike(pattern), _hit(rule, F.lit(0), F.length(buf), whole=True))
    start = F.regexp_instr(buf, F.lit(pattern)) - 1
    size = F.coalesce(F.length(F.regexp_substr(buf, F.lit(pattern))), F.lit(0))
    found = buf.rlike(pattern)
    if drop_empty:
        found = found & (size > 0)
    return F.when(found, _hit(rule, start, start + size))


def allowed_edits(length: int, threshold: int) -> int:
    """Most edits a window of ``length`` may need and still reach the threshold."""
    return math.floor(length * (100.5 - threshold) / 100 + 1e-9)


def _segments(buf: Column, overlap: int, keep: Callable[[Column], Column] | None = None,
              sizes: Sequence[int] = SEGMENTS) -> Column:
    """Array of short pieces covering ``buf``, each reaching ``overlap`` into the next.

    Taking text by position walks the text from its start, so positions are
    resolved in a few steps, from long pieces to short ones. At each step only
    the pieces that pass ``keep`` are taken further apart.
    """
    def cut_up(text: Column, size: int) -> Column:
        last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), last, F.lit(size)),
                             lambda i: F.substring(text, i + 1, F.lit(size + overlap)))
        return pieces if keep is None else F.filter(pieces, keep)

    def finer(pieces: Column, size: int) -> Column:
        return F.flatten(F.transform(pieces, lambda p: cut_up(p, size)))

    pieces = cut_up(buf, sizes[0])
    for size in sizes[1:]:
        pieces = finer(pieces, size)
    return pieces


def _fewest_edits(pieces: Column, pattern: str, most: int, pigeonhole: bool) -> Column:
    """Least edit distance of ``pattern`` to any part of its length in ``pieces``, or ``most`` + 1 if none is within it.

    A part is measured only if it can be better than the best so far: each of its
    characters that the pattern lacks takes an edit. With ``pigeonhole``, one of the
    pattern's pieces must also stand in it, at most ``most`` places from its own.
    """
    size, alphabet = len(pattern), "".join(sorted(set(pattern)))

    def better(best: Column, part: Column) -> Column:
        possible = F.length(F.translate(part, alphabet, "")) < best
        if pigeonhole:
            near = F.lit(False)
            for low, piece in _pieces(pattern, most):
                first = max(0, low - most)
                around = F.substring(part, first + 1, min(size, low + len(piece) + most) - first)
                near = near | around.contains(F.lit(piece))
            possible = near & possible
        found = F.call_function("levenshtein", part, F.lit(pattern), best - 1)
        return F.when(possible, let(found, lambda d: F.when(d >= 0, d).otherwise(best))).otherwise(best)

    def in_piece(best: Column, piece: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(piece) - size + 1), lambda i: F.substring(piece, i, F.lit(size)))
        return F.aggregate(parts, best, better)

    return F.aggregate(pieces, F.lit(most + 1), in_piece)


def _percent(edits: Column, length: Column) -> Column:
    return F.round(F.lit(100.0) * (length - edits) / length).cast("int")


def partial_ratio(buf: Column, pattern: str, threshold: int | None = None) -> Column:
    """Best similarity (0-100) of the shorter text to any same-length part of the longer.

    With a threshold, parts that cannot reach it are left out and the result is
    null if all are.
    """
    size = len(pattern)
    edits = size - 1 if threshold is None else min(size - 1, allowed_edits(size, threshold))
    pigeonhole = edits + 1 < size
    keep = (lambda p: _has_piece(p, pattern, edits)) if pigeonhole else None
    fewest = _fewest_edits(_segments(buf, size - 1, keep), pattern, edits, pigeonhole)
    slide = let(fewest, lambda d: F.when(d <= edits, d).otherwise(size if threshold is None or edits == size - 1 else None))
    short = F.array_min(F.transform(
        F.sequence(F.lit(1), F.lit(size + 1) - F.length(buf)),
        lambda i: F.levenshtein(F.substring(F.lit(pattern), i, F.length(buf)), buf)))
    return (F.when(F.length(buf) == 0, F.lit(0))
            .when(F.length(buf) >= size, _percent(slide, F.lit(size)))
            .otherwise(_percent(short, F.length(buf))))


def _pieces(pattern: str, edits: int) -> list[tuple[int, str]]:
    """(place, text) of ``edits`` + 1 pieces of a pattern: one of them survives so many edits."""
    cuts = [round(i * len(pattern) / (edits + 1)) for i in range(edits + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _has_piece(text: Column, pattern: str, edits: int) -> Column:
    """Whether ``text`` can hold a part within ``edits`` of ``pattern``."""
    some = F.lit(False)
    for piece in sorted({p for _, p in _pieces(pattern, edits)}):
        some = some | text.contains(F.lit(piece))
    return some


def maybe_fuzzy(buf: Column, rule: Rule) -> Column:
    """Cheap test that keeps every buffer able to reach the threshold."""
    pattern = rule.byte_pattern
    edits = allowed_edits(len(pattern), rule.threshold)
    return F.lit(True) if edits + 1 >= len(pattern) else (F.length(buf) < len(pattern)) | _has_piece(buf, pattern, edits)


def fuzzy_hit(buf: Column, rule: Rule, invert: bool = False) -> Column:
    """Whole buffer if its best partial ratio reaches (invert: misses) the threshold."""
    def judged(ratio: Column) -> Column:
        passed = ratio < rule.threshold if invert else ratio >= rule.threshold
        sign = "|" if invert else ">="
        detail = F.format_string(f"(ratio: %d {sign} threshold: {rule.threshold})", ratio)
        return F.when(passed, _hit(rule, F.lit(0), F.length(buf), whole=True, detail=detail))

    if invert:
        return let(partial_ratio(buf, rule.byte_pattern), judged)
    return F.when(maybe_fuzzy(buf, rule), let(partial_ratio(buf, rule.byte_pattern, rule.threshold), judged))


def hex_text(digits: str) -> str:
    return bytes.fromhex(digits).decode("latin-1")


def bytesig_hit(buf: Column, rule: Rule, invert: bool = False) -> Column:
    """From the first occurrence of a byte pattern to the end of the buffer."""
    needle = F.lit(hex_text(rule.pattern))
    if invert:
        return F.when(~buf.contains(needle), _hit(rule, F.lit(0), F.length(buf), whole=True))
    return F.when(buf.contains(needle), _hit(
        rule, F.locate(hex_text(rule.pattern), buf) - 1, F.length(buf)))


def _string_regex(string: SignatureString) -> str:
    return dialect.java(string.pattern, "s")


def string_found(buf: Column, string: SignatureString) -> Column:
    if string.kind == "regex":
        return buf.rlike(_string_regex(string))
    return buf.contains(F.lit(string_literal(string)))


def string_literal(string: SignatureString) -> str:
    if string.kind == "hex":
        return hex_text(string.pattern)
    return dialect.byte_pattern(string.pattern)


def string_last(buf: Column, string: SignatureString) -> Column:
    """Struct (start, end) of the last instance of a string that does occur."""
    if string.kind == "regex":
        start = F.length(F.regexp_extract(buf, f"(?s)\\A(.*)(?:{dialect.java(string.pattern, 's', 1)})", 1))
        size = F.length(F.regexp_substr(
            F.substring(buf, start + 1, F.length(buf)), F.lit(_string_regex(string))))
        return F.struct(start.cast("bigint").alias("start"),
                        (start + F.coalesce(size, F.lit(0))).cast("bigint").alias("end"))
    literal = string_literal(string)
    ahead = F.locate(literal[::-1], F.reverse(buf)) - 1
    end = F.length(buf) - ahead
    return F.struct((end - len(literal)).cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def signature_holds(buf: Column, rule: Rule) -> Column:
    """Whether enough distinct strings of the rule occur."""
    found = sum((string_found(buf, s).cast("int") for s in rule.strings), F.lit(0))
    return found >= rule.needed_strings()


def signature_hit(buf: Column, rule: Rule, invert: bool = False) -> Column:
    """Span of the last instance of the last string (in rule order) that occurs."""
    if invert:
        return F.when(~signature_holds(buf, rule), _hit(rule, F.lit(0), F.length(buf), whole=True))
    span = F.coalesce(*[
        F.when(string_found(buf, s), string_last(buf, s)) for s in reversed(rule.strings)])
    return F.when(signature_holds(buf, rule), let(
        span, lambda s: _hit(rule, s["start"], s["end"])))


def rule_hit(buf: Column, rule: Rule, spec: InspectSpec) -> Column:
    if rule.mode == "regex":
        return regex_hit(buf, rule, spec.invert, spec.drop_empty)
    one = {"fuzzy": fuzzy_hit, "bytesig": bytesig_hit, "signature": signature_hit}[rule.mode]
    return one(buf, rule, spec.invert)


def first_hit(buf: Column, rules: Sequence[Rule], spec: InspectSpec) -> Column:
    """First hit in the order regex, fuzzy, bytesig, signature, then rule order.

    Inverted signatures count per source file: a file hits when none of its
    rules holds.
    """
    tests = []
    files_done: set[str] = set()
    for rule in sorted(rules, key=lambda r: r.order):
        if spec.invert and rule.mode == "signature":
            if rule.source_file in files_done:
                continue
            files_done.add(rule.source_file)
            same = [r for r in rules if r.mode == "signature" and r.source_file == rule.source_file]
            held = F.lit(False)
            for other in same:
                held = held | signature_holds(buf, other)
            tests.append(F.when(~held, _hit(rule, F.lit(0), F.length(buf), whole=True)))
        else:
            tests.append(rule_hit(buf, rule, spec))
    return F.coalesce(*tests, no_hit())


def all_hits(buf: Column, rules: Sequence[Rule], spec: InspectSpec) -> Column:
    """Array with the hit of every rule that has one, in rule order.

    A rule bound to one direction is only tried on rows of that ``direction``.
    """
    def scoped(rule: Rule) -> Column:
        hit = rule_hit(buf, rule, spec)
        return hit if rule.direction == ANY else F.when(F.col("direction") == rule.direction, hit)

    hits = F.array(*[scoped(r) for r in sorted(rules, key=lambda r: r.order)])
    return F.filter(hits, lambda h: h.isNotNull())


def reach(rule: Rule, spec: InspectSpec) -> int | None:
    """Most bytes one hit of ``rule`` depends on, or None without such a bound.

    Inverted rules depend on the first bytes of a stream only: what is found in
    a prefix stays found.
    """
    if rule.mode == "regex":
        if spec.invert:
            return 1 if context_free(rule.pattern) else None
        return widest_match(rule.pattern)
    if rule.mode == "fuzzy":
        return len(rule.byte_pattern)
    if spec.invert:
        return 1
    if rule.mode == "signature":
        return None
    return len(bytes.fromhex(rule.pattern))


def may_hit(buf: Column, rules: Sequence[Rule], spec: InspectSpec) -> Column:
    """A test over a whole block that is true wherever some part of it may hit."""
    some = F.lit(False)
    for rule in rules:
        if spec.invert:
            return F.lit(True)
        if rule.mode == "regex" and context_free(rule.pattern):
            some = some | buf.rlike(dialect.java(rule.pattern, rule.flags))
        elif rule.mode == "bytesig":
            some = some | buf.contains(F.lit(hex_text(rule.pattern)))
        elif rule.mode == "signature" and all(
                s.kind != "regex" or context_free(s.pattern) for s in rule.strings):
            some = some | signature_holds(buf, rule)
        else:
            # Fuzzy ratios of short prefixes can exceed those of the whole.
            return F.lit(True)
    return some
