"""Translated patterns against Python's own matching on bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wiresift import dialect
from wiresift.spec import Rule, SignatureString

PATTERNS = [
    r'{"k"', r"(?P<n>ab)(?P=n)?", r"a{,2}b", r"x\Z", r"[a&&b]z", r"(?:a|b)*c", r"(ab)*c", r"^b|a$", r"\bab\b", r"\Ba",
    r"(?i:A)b", r"a(?-i:B)", r"(?i)aB", r"[^\W\d]b", r"(a)(b)\2\1", r"(?=ab)a", r"(?<!a)b", r"a*?b", r"(?>a+)b", r"a++b",
    "sión", r"[\]\-^a]", r".\n", r"\s\S", r"a$\n?", r"\.|\x00", r"(?:(a)|b){2}", r"(?!)|b", "(?s:.)b", "(?m:^)b"]


def test_same_spans(spark):
    rng = random.Random(1)
    letters = 'aabbcABxz \n.k{"&-é0_\x00'
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["sión", "ab\n", "x\n", "x", "a\n", "\n", ""]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "i int, b binary")
    df = df.withColumn("t", F.decode("b", "ISO-8859-1"))
    for flags in ("", "sm", "i"):
        found = []
        for pattern in PATTERNS:
            java = dialect.java(pattern, flags)
            found.append(F.when(F.col("t").rlike(java), F.struct(
                (F.regexp_instr("t", F.lit(java)) - 1).alias("start"), F.length(F.regexp_substr("t", F.lit(java))).alias("size"))))
        for i, spans in df.select("i", F.array(*found)).collect():
            for pattern, span in zip(PATTERNS, spans, strict=True):
                match = re.search(pattern.encode(), texts[i].encode(), sum(dialect.FLAGS[f] for f in flags))
                want = (match.start(), match.end() - match.start()) if match else None
                assert (tuple(span) if span else None) == want, (pattern, flags, texts[i])


@pytest.mark.parametrize("pattern", ["(?:a|b)*c", "(ab)*c", "(?:ab)*?c", "((?:ab){2})*c", "(a|b)*c", "[^c]*c"])
def test_loops_on_long_buffers(spark, pattern):
    long = spark.range(1).select(F.repeat(F.lit("ab"), 200_000).alias("t")).select(F.concat("t", F.lit("c")).alias("t"))
    assert long.select(F.col("t").rlike(dialect.java(pattern, "s"))).first()[0]


@pytest.mark.parametrize("pattern", ["(?:a+b)*c", "(?:aa|b)*c", "(a)?(?(1)b|c)", "(?:a?b)+"])
def test_refused(pattern):
    with pytest.raises(ValueError):
        Rule(1, pattern=pattern)
    with pytest.raises(ValueError):
        SignatureString("a", "regex", pattern)


@pytest.mark.parametrize("condition", ["0", "3", "-1"])
def test_signature_counts(condition):
    strings = (SignatureString("a", "text", "x"), SignatureString("b", "text", "y"))
    with pytest.raises(ValueError):
        Rule(1, "signature", condition=condition, strings=strings)
