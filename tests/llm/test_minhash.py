"""MinHash near-duplicates against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.helpers import DOCS, awkward, clashing, docs
from wiresift.llm import minhash, similar

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_components(texts, similar=85):
    """{index: smallest index reachable}"""
    sets = list(map(slow_set, texts))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= similar * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= similar * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(rng.randint(60, 160))]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield " ".join(copy)


def test_families(spark):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(400)]
    texts = [t for edits in (1, 2, 3, 4, 6) for _ in range(5) for t in family(rng, words, 14, edits)]
    texts += ["a b c", "A b  c", "a b c d", "", None, " \t", "x", "x y z v w", "x y z v w u"]
    rng.shuffle(texts)
    got = minhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    want = slow_components(texts)
    assert len(set(want)) < len(texts) - 100 and len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(slow_set(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_shuffled_sides(spark, monkeypatch):
    from wiresift.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rng = random.Random(9)
    texts = list(family(rng, [f"w{i}" for i in range(300)], 30, 5))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(30)] == slow_components(texts)


def chunks(places):
    return [sum(p << minhash.BITS * i for i, p in enumerate(places[at:at + minhash.PLACES]))
            for at in range(0, len(places), minhash.PLACES)]


def test_keys_meet_all_pairs_within_the_bound(spark):
    """Whatever places differ: the count is exact, and up to the bound both are filed under the first common key."""
    rng = random.Random(1)
    n, rows = minhash.CHUNKS * minhash.PLACES, []
    for _ in range(400):
        a = [rng.randrange(1 << minhash.BITS) for _ in range(n)]
        b = list(a)
        differ = rng.sample(range(n), rng.choice((0, 1, 5, 20, minhash.MAX_PLACES, minhash.MAX_PLACES, 40, n)))
        if rng.random() < 0.5:  # two errors in as many chunks as possible
            differ = [c * minhash.PLACES + i for c in range(minhash.CHUNKS) for i in (0, 5)][:len(differ)]
        for i in differ:
            b[i] ^= rng.randrange(1, 1 << minhash.BITS)
        rows.append((len(differ), chunks(a), chunks(b)))
    df = spark.createDataFrame(rows, "want int, a array<long>, b array<long>").withColumn("id", F.monotonically_increasing_id()).cache()
    met = {r.id: r.slot for r in df.select("id", F.col("a").alias("sig")).select("id", F.explode(minhash.keys()).alias("k")).join(
        df.select("id", F.col("b").alias("sig")).select("id", F.explode(minhash.keys()).alias("k")), ["id", "k"])
        .groupBy("id").agg(F.min(F.shiftright(F.col("k.key") % similar.HOME, minhash._HELD)).alias("slot")).collect()}
    found = df.select("id", "want", minhash.differing(F.col("a"), F.col("b")).alias("n"),
                      minhash.first_slot(F.col("a"), F.col("b")).alias("slot")).collect()
    assert len(found) == 400
    for r in found:
        assert r.n == r.want and r.slot == met.get(r.id) and (r.slot is not None or r.n > minhash.MAX_PLACES)


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(4)
    differ = []
    for _ in range(300):
        common, own = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (170, 30))
        a, b = (minhash.signature(np.unique(np.concatenate([common, part]))) for part in (own[:15], own[15:]))
        x = (a ^ b).view(np.uint64)[:, None] >> (np.arange(minhash.PLACES, dtype=np.uint64) * np.uint64(minhash.BITS))
        differ.append(int(((x & np.uint64((1 << minhash.BITS) - 1)) != 0).sum()))
    # 170 of 200 shingles are shared: 9.9 of 66 places differ on average, and the bound holds.
    assert abs(np.mean(differ) - 9.9) < 0.7 and 2.3 < np.std(differ) < 3.5 and max(differ) <= minhash.MAX_PLACES


def test_query(spark):
    rows = entry.queries()["op13_minhash"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    want = slow_components([texts[i] for i in ids])
    assert {r.doc_id: r.component_id for r in rows} == {i: ids[w] for i, w in zip(ids, want, strict=True)}


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    df = awkward(spark)
    rows = minhash.near_duplicates(clashing(df) if extra else df).collect()
    assert len(rows) == 12
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [r.component_id for r in rows if r.doc_id == 6] == [1, 1] and of[1].kept and not of[6].kept
    assert of[2].n_shingles == of[3].n_shingles == of[4].n_shingles == 0 and of[2].kept and of[4].component_id == 4
    assert of[5].n_shingles == 59_996 and {r.component_id for r in rows if r.doc_id is None} == {None}
    # Without an id of its own, a copy goes to the class of the one that has one.
    more = minhash.near_duplicates(docs(spark, [(None, "a b"), (None, "a b"), (3, "a b"), (3, "c d")])).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(more, key=repr)] == [(3, 3), (3, 3), (None, 3), (None, 3)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
