"""Stream inspection against a row-at-a-time search, for short and long flows."""

import random

import pytest

from tests.brute import streams
from wiresift.operators.streams import inspect_streams
from wiresift.spec import InspectSpec, Rule, SignatureString

S = SignatureString
CASES = {
    "literal": (Rule(1, pattern="bca"),),
    "bounded": (Rule(1, pattern="a[bc]{1,3}d"),),
    "open": (Rule(1, pattern="ab[abc]*d"),),
    "gap": (Rule(1, pattern="add.*bb"),),
    "gaps": (Rule(1, pattern="ab.*c[cd]a.*bb"),),
    "lead": (Rule(1, pattern=".*dcd"),),
    "trail": (Rule(1, pattern="dcd.*", direction="CTS"),),
    "dotstar": (Rule(1, pattern=".*"),),
    "lazy": (Rule(1, pattern="ac+?d|dd"),),
    "two": (Rule(1, pattern="dcba", priority=1), Rule(2, pattern="cc[ab]+d", priority=2)),
    "directions": (Rule(1, pattern="abd", direction="CTS"), Rule(2, pattern="dd+a", direction="STC")),
    "bytesig": (Rule(1, "bytesig", "646463"),),
    "fuzzy": (Rule(1, "fuzzy", "abcddcba", threshold=85),),
    "any": (Rule(1, "signature", strings=(S("a", "text", "abcd"), S("b", "hex", "646164"))),),
    "all": (Rule(1, "signature", condition="all",
                 strings=(S("a", "text", "abca"), S("b", "regex", "d[ab]{2}d"), S("c", "text", "ccc"))),),
    "mixed": (Rule(1, pattern="dada[bc]+a"), Rule(2, "fuzzy", "ccddcc", threshold=90),
              Rule(3, "signature", strings=(S("a", "text", "bbbb"),))),
    "anchor": (Rule(1, pattern="^bd"),),
    "cr": (Rule(1, pattern="a$"),),
    "end": (Rule(1, pattern=r"ab\Z"),),
    "word": (Rule(1, pattern=r"\bab\b"),),
    "reference": (Rule(1, "signature", strings=(S("a", "regex", r"([a-d])\1"),)),),
    "widening": (Rule(1, "signature", strings=(S("a", "regex", "ab.*c"),)),),
    "file": (Rule(1, "signature", strings=(S("a", "text", "aa"),), source_file="f"),
             Rule(2, "signature", strings=(S("a", "text", "cd"),), source_file="f")),
}


def sample(seed, flows=6, chunks=40, letters="abcd\n\r\xe9"):
    rng = random.Random(seed)
    out = []
    for flow in range(flows):
        for no in range(rng.randint(1, chunks)):
            data = "".join(rng.choices(letters, [5, 4, 4, 4, .3, .3, .3], k=rng.choice([0, 1, 2, 5, 9])))
            out.append((flow, rng.choice(["CTS", "STC"]), no, data.encode("latin-1")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(f, d, n, bytearray(b)) for f, d, n, b in rows],
        "flow_id long, direction string, chunk_no long, payload binary")


def found(df):
    return {(r.flow_id, r.direction, r.chunk_no, r.rule_id, r.start_off, r.end_off) for r in df.collect()}


SHORT = [(name, opts) for name in CASES for opts in ({}, {"multi_match": True})]
SHORT += [(name, {"offset": 5, "depth": 9}) for name in ("literal", "open", "mixed", "all", "fuzzy", "cr")]
SHORT += [(n, {"invert": True}) for n in ("literal", "bounded", "bytesig", "fuzzy", "any", "two")]
SHORT += [(n, {"invert": True, "multi_match": True}) for n in ("literal", "bounded", "any", "two", "file", "fuzzy")]
SHORT += [("file", {"invert": True}), ("reference", {"offset": 3, "depth": 12})]
SHORT += [("dotstar", {"multi_match": True, "offset": 4}), ("bounded", {"multi_match": True, "depth": 7})]


@pytest.mark.parametrize("name,opts", SHORT)
def test_short_flows(spark, name, opts):
    spec = InspectSpec(rules=CASES[name], **opts)
    rows = sample(sum(map(ord, name)))
    assert found(inspect_streams(frame(spark, rows), spec)) == streams(rows, spec)


LONG = [(n, {}) for n in CASES] + [
    ("literal", {"multi_match": True}), ("open", {"multi_match": True}), ("dotstar", {"multi_match": True}),
    ("fuzzy", {"multi_match": True}), ("two", {"multi_match": True, "offset": 6}),
    ("bounded", {"offset": 11}), ("bounded", {"offset": 11, "depth": 9}), ("open", {"offset": 11, "depth": 9}),
    ("literal", {"invert": True}), ("fuzzy", {"invert": True}), ("any", {"invert": True, "offset": 9}),
    ("any", {"depth": 9}), ("all", {"offset": 5, "depth": 30}), ("reference", {"depth": 7}), ("widening", {"depth": 20}),
    ("file", {"invert": True}), ("file", {"invert": True, "multi_match": True}),
    ("literal", {"invert": True, "multi_match": True}), ("two", {"invert": True, "multi_match": True}),
    ("end", {"multi_match": True}), ("word", {"multi_match": True}),
]


@pytest.mark.parametrize("name,opts", LONG)
def test_flows_longer_than_a_block(spark, name, opts):
    spec = InspectSpec(rules=CASES[name], **opts)
    rows = sample(len(name), flows=4, chunks=30)
    assert found(inspect_streams(frame(spark, rows), spec, per_block=5)) == streams(rows, spec)


def test_multi_match_vector(spark):
    sizes = [1380] * 13 + [424]
    rows = [(1, "STC", i, b"x" * n) for i, n in enumerate(sizes)]
    spec = InspectSpec(rules=(Rule(1, pattern=".*", direction="STC"),), multi_match=True)
    spans = sorted((r.start_off, r.end_off) for r in inspect_streams(frame(spark, rows), spec).collect())
    assert len(spans) == 14 and spans[0] == (0, 1380) and spans[-1] == (17940, 18364)
    first = InspectSpec(rules=spec.rules)
    assert found(inspect_streams(frame(spark, rows), first)) == {(1, "STC", 0, 1, 0, 1380)}
