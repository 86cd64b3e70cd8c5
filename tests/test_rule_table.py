"""Rules as rows against the same rules as expressions, and the literals that patterns require."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wiresift.operators import rule_table as R
from wiresift.operators.datagrams import inspect_all_rules
from wiresift.spec import ANY, InspectSpec, Rule, SignatureString

PATTERNS = ["abcd", "abc", "ab(cd|dc)ab", "(?:abcd|dcba){1,9}x?", "a.*bcda", "[ab]cdab{2,}", "(?i)AbCd", "dada(?!b)cb", "^abcd", "x|abcd",
            "(?:abba){2}", "a\\x62cd\\xff", "ca(?P<g>bd)ac", "(ab)cd", "(?>abca)d?", "[^a]{3}abdd", "dd$", "caba?b?c"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_required_literals(pattern):
    """Whatever matches holds one literal of each set."""
    rng = random.Random(pattern)
    sets = R.required_literals(pattern, "sm")
    for _ in range(3000):
        data = bytes(rng.choice(b"abcdABCD\xff\n") for _ in range(rng.randint(0, 14)))
        if re.search(pattern.encode("latin-1"), data, re.S | re.M):
            assert all(any(x in data.lower() for x in s) for s in sets)


def test_literals_are_found():
    assert R.required_literals("User-Agent: [^\\r\\n]+") == [[b"user-agent: "]]
    assert R.required_literals("(?:GET|POST) /index|HEAD /admin") == [[b" /index", b"head /admin"]]
    assert R.required_literals("a{3}[0-9]+") == []


def rules():
    strings = (SignatureString("a", "text", "abcd"), SignatureString("b", "hex", b"dcba".hex()), SignatureString("c", "regex", "ba+dc"))
    out = [Rule(i, pattern=p, priority=-i, direction=(ANY, "CTS", "STC")[i % 3]) for i, p in enumerate(PATTERNS)]
    out += [Rule(100 + i, "bytesig", pattern=p.hex()) for i, p in enumerate((b"abca", b"ab", b"ddcc", b"\xffab"))]
    return out + [Rule(200 + i, "signature", condition=c, strings=strings) for i, c in enumerate(("any", "all", "2"))]


def table(spark, some):
    rows = [(r.rule_id, r.mode, r.priority, r.direction, r.pattern, r.flags, r.condition, [(s.id, s.kind, s.pattern) for s in r.strings])
            for r in some]
    return spark.createDataFrame(rows, "rule_id int, mode string, priority int, direction string, pattern string, flags string, "
                                       "condition string, strings array<struct<id:string,kind:string,pattern:string>>")


def buffers(spark, n=250):
    rng = random.Random(6)
    parts = [b"abcd", b"dcba", b"AbCd", b"baadc", b"abba", b"dadacb", b"\xffab", b"cabdac", b"a", b"b", b"\n", b"x"]
    rows = [(i, rng.choice(("CTS", "STC")), b"".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 8, 30))))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "CTS", None)], "id long, direction string, payload binary")


@pytest.mark.parametrize("opts", [{}, {"offset": 5, "depth": 20}, {"drop_empty": True}])
def test_same_hits_as_expressions(spark, monkeypatch, opts):
    df, some = buffers(spark), rules()
    want = inspect_all_rules(df, some, InspectSpec(rules=tuple(some), **opts), ["id"]).collect()
    want = sorted((r.id, r.rule_id, r.mode, r.start_off, r.end_off, r.size) for r in want)
    got = R.inspect_by_table(df, table(spark, some), ["id"], sample=0.5, **opts)
    assert got.columns == ["id", "rule_id", "mode", "start_off", "end_off", "size"]
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want
    order = {r.rule_id: r.order for r in some}
    first = {}
    for row in want:
        first[row[0]] = min(first.get(row[0], row), row, key=lambda x: order[x[1]])
    monkeypatch.setattr(R, "KEYS_A_PASS", 7)
    got = R.inspect_by_table(df, table(spark, some), ["id"], first=True, **opts).collect()
    assert sorted(map(tuple, got)) == sorted(first.values())


def test_the_plan_does_not_grow(spark):
    df = buffers(spark, 10)

    def plan(n):
        some = [Rule(i, pattern=f"word{i}[a-z]") for i in range(n)]
        out = R.inspect_by_table(df, table(spark, some).select("rule_id", "mode", "pattern"), ["id"])
        return len(re.sub(r"#?\d+", "", out._jdf.queryExecution().optimizedPlan().toString()))

    assert plan(1500) == plan(2)


def test_tables_and_rules(spark):
    some = rules()
    assert sorted(R.rules_from(table(spark, some)), key=lambda r: r.rule_id) == some
    with pytest.raises(ValueError, match="more than 5"):
        R.rules_from(table(spark, some), most=5)
    assert R.inspect_by_table(buffers(spark, 5), table(spark, some).limit(0), ["id"]).count() == 0
    assert R.inspect_by_table(buffers(spark, 5).limit(0), table(spark, some), ["id"]).count() == 0
    for bad in (Rule(1, "fuzzy", "abcd"),):
        with pytest.raises(Exception, match="fuzzy"):
            R.inspect_by_table(buffers(spark, 5), table(spark, [bad]), ["id"]).count()
    with pytest.raises(Exception, match="varying length"):
        R.inspect_by_table(buffers(spark, 5), table(spark, some).limit(1).withColumn("pattern", F.lit("(?:ab|c)*")), ["id"]).count()
