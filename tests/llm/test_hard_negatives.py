"""Hard negatives against plain scores, and the residues on numbers of any size."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiresift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 1500), st.sampled_from((1, 100, 10_000, 2 ** 25)), st.randoms())
def test_scores_are_exact(dims, most, rng):
    a, b = (np.array([[rng.randint(-most, most) for _ in range(dims)] for _ in range(3)], np.int64) for _ in range(2))
    bound = most * most * dims
    primes = hn.moduli(dims, bound)
    assert all(p < 1024 and all(p % d for d in range(2, p)) for p in primes) and np.prod([float(p) for p in primes]) > 2 * bound
    got = hn.scores([hn.residues(a, p) for p in primes], [hn.residues(b, p) for p in primes], primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def test_extreme_scores():
    x = np.array([[2 ** 30, 2 ** 30 - 1], [-2 ** 30, 1 - 2 ** 30], [0, 0]])
    primes = hn.moduli(2, 2 ** 62)
    parts = [hn.residues(x, p) for p in primes]
    assert hn.scores(parts, parts, primes).tolist() == [[int(np.dot(u.astype(object), v.astype(object))) for v in x] for u in x]


def slow(rows, every, positives, negatives, low, high, scale=256):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        good.append((i, [int(np.floor(scale * c)) for c in v], label))
    out = []
    for at, (i, v, label) in enumerate(good):
        if i is None or i % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, j, k)
            for n, (j, w, k) in enumerate(good) if n != at)
        for s, _, _, j, k in [x for x in scored if x[4] == label][:positives]:
            fit = [x for x in scored if x[4] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, rank, x[3], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return out


def drawn(rng, n, dims, labels):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        # Coarse values make ties.
        rows.append((i, [round(x + rng.gauss(0, 0.7), rng.choice((0, 1))) for x in c], rng.randrange(labels)))
    return rows


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("dims", "labels", "cells"), [(3, 3, (16384, 16384)), (8, 2, (7, 40)), (40, 25, (16384, 60))])
def test_against_all_pairs(spark, dims, labels, cells):
    rng = random.Random(dims)
    rows = drawn(rng, 400, dims, labels)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hn.mine(df, F.col("vec_id") % 10 == 0, 5, 10, 30, 90, 256, *cells).collect()
    want = slow(rows, 10, 5, 10, 30, 90)
    assert len(want) > 200 and in_order(map(tuple, got)) == in_order(want)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [0.5, 1.0], 2), (2, [0.5, 1.0], 2), (3, None, 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (8, [], 2), (9, [0.5], 3), (10, [-1.0, -2.0], 3),
            (None, [0.4, 1.0], 2), (None, [1.0, 1.9], 1), (20, [0.0, 0.0], 3), (30, [1e12, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "g", "h", "x", "id", "score", "asks")})
    got = hn.mine(df, F.col("vec_id") % 10 == 0).collect()
    # The row whose square fits no long takes no part; one that only just does is exact.
    assert in_order(map(tuple, got)) == in_order(slow([r for r in rows if r[0] != 30], 10, 5, 10, 30, 90))
    large = [(i, [float(2 ** 21 - i), 1.0], i % 2) for i in range(0, 60, 5)]
    got = hn.mine(spark.createDataFrame(large, SCHEMA), F.col("vec_id") % 10 == 0, low=-100, high=200).collect()
    assert got and in_order(map(tuple, got)) == in_order(slow(large, 10, 5, 10, -100, 200))
    for empty in (df.limit(0), df.where("vec_id IN (3, 4, 5)"), df.where("vec_id = 0")):
        assert hn.mine(empty, F.col("vec_id") % 10 == 0).count() == 0


def test_a_common_vector(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.25] if rng.random() < 0.7 else [rng.gauss(0, 1) for _ in range(3)], rng.randrange(3)) for i in range(500)]
    got = hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5, 10, 30, 100, 256, 4, 100).collect()
    assert in_order(map(tuple, got)) == in_order(slow(rows, 50, 5, 10, 30, 100))
