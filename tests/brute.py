"""Row-at-a-time search of streams, as plainly as possible, to compare with."""

import re

from wiresift.operators.matchers import hex_text

FLAGS = {"s": re.S, "m": re.M, "i": re.I}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def ratio(text, pattern):
    short, long_ = sorted((text, pattern), key=len)
    if not short:
        return 0
    n = len(short)
    best = min(edits(short, long_[i:i + n]) for i in range(len(long_) - n + 1))
    return int(100.0 * (n - best) / n + 0.5)


def string_spans(text, s):
    if s.kind == "regex":
        found = [re.compile(s.pattern, re.S).match(text, i) for i in range(len(text) + 1)]
        return [m.span() for m in found if m]
    lit = hex_text(s.pattern) if s.kind == "hex" else s.pattern
    return [(i, i + len(lit)) for i in range(len(text)) if text.startswith(lit, i)]


def rule_hit(text, rule, spec):
    """(start, end, whole) or None."""
    if rule.mode == "regex":
        m = re.search(rule.pattern, text, sum(FLAGS[f] for f in rule.flags))
        if spec.invert:
            return None if m else (0, len(text), True)
        return (*m.span(), False) if m else None
    if rule.mode == "fuzzy":
        return (0, len(text), True) if (ratio(text, rule.pattern) >= rule.threshold) != spec.invert else None
    if rule.mode == "bytesig":
        at = text.find(hex_text(rule.pattern))
        if spec.invert:
            return (0, len(text), True) if at < 0 else None
        return (at, len(text), False) if at >= 0 else None
    spans = [x for x in (string_spans(text, s) for s in rule.strings) if x]
    held = len(spans) >= rule.needed_strings()
    if spec.invert:
        return None if held else (0, len(text), True)
    return (*spans[-1][-1], False) if held else None


def streams(chunks, spec):
    """chunks: (flow, direction, chunk_no, bytes) -> set of result tuples."""
    flows = {}
    for flow, direction, no, data in sorted(chunks, key=lambda c: (c[0], c[2])):
        flows.setdefault(flow, []).append((direction, no, data.decode("latin-1")))
    out = set()
    for flow, parts in flows.items():
        bufs = {"CTS": "", "STC": ""}
        skips = {"CTS": 0, "STC": 0}
        for direction, no, text in parts:
            if not text:
                continue
            rules = spec.for_direction(direction)
            bufs[direction] += text
            count = len(bufs[direction])
            base = (spec.offset if 0 < spec.offset < count else 0)
            low = base + skips[direction]
            stop = min(low + spec.depth, count) if spec.depth else count
            piece = bufs[direction][low:stop]
            for rule in rules:
                hit = rule_hit(piece, rule, spec)
                if hit and spec.invert and rule.mode == "signature" and not all(
                        rule_hit(piece, r, spec) for r in rules
                        if r.mode == "signature" and r.source_file == rule.source_file):
                    hit = None
                if hit:
                    break
            else:
                continue
            out.add((flow, direction, no, rule.rule_id, low + hit[0], low + hit[1]))
            if not spec.multi_match:
                break
            skips[direction] = low + hit[1] - base
    return out
