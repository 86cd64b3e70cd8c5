"""SimHash classes against a comparison of all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.helpers import DOCS, awkward, clashing, docs
from wiresift.llm import components, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, shingle=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    spans = [words] if 0 < len(words) <= shingle else [words[i:i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in spans if s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, max_bits=3):
    """{fingerprint: smallest fingerprint reachable}"""
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= max_bits and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints():
    for text in ("", None, " ", "one", "one two", "One TWO three", "a b c d e f a b c", "É é x\x0by\x0cz\tq", "x " * 900):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_shingle_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2 ** 64 == xxhash.xxh64_intdigest("a b c", 42)


@pytest.mark.parametrize(("max_bits", "width", "crowded"), [(3, 2, 2081), (3, 4, 2081), (3, 2, 3), (1, 2, 2081), (2, 2, 2), (0, 2, 99)])
def test_classes(spark, max_bits, width, crowded):
    rng = random.Random(max_bits + crowded)
    prints = [0, 2 ** 64 - 1]
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(p)
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
    signed = [p - 2 ** 64 if p >> 63 else p for p in prints]
    rows = [(i, p) for i, p in enumerate(signed, 100)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.classes(
        spark.createDataFrame(rows, "doc_id long, fp long"), max_bits, width, crowded).collect()}
    label = slow_classes(sorted(set(prints)), max_bits)
    first = {}
    for i, p in sorted(rows):
        first.setdefault(label[p % 2 ** 64], i)
    assert got == {i: first[label[p % 2 ** 64]] for i, p in rows}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    edges += [(300, 301 + i) for i in range(50)] + [(1, None)]
    label = {x: x for e in edges for x in e if x is not None}
    for _ in range(100):
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for x in got}
    assert set(got) == {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward(spark):
    got = simhash.near_duplicates(clashing(awkward(spark))).collect()
    assert len(got) == 12
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {2}
    assert {r.component_id for r in got if r.doc_id in (1, 6)} == {1}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == DOCS.names
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for n, i in ids if not n] == [-5, 1, 2, 5, 7, 9223372036854775807]
    assert sum(n for n, _ in ids) == 1  # the null id with a text; the empty one is in the class of 2
    same = docs(spark, [(None, "a b c d"), (None, "a b c d"), (4, "q r s t"), (4, "q r s t"), (4, "u v w x y")])
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(same).collect()) == [
        (0, "a b c d"), (4, "q r s t"), (4, "u v w x y")]


def test_query(spark):
    rows = entry.queries()["op2_simhash"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    label = slow_classes(sorted(set(prints.values())))
    first = {}
    for i in sorted(prints):
        first.setdefault(label[prints[i]], i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{p:016x}", first[label[p]]) for i, p in prints.items()}
