"""Wide fingerprints: distances, cells, and recall against all pairs at the bound."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, clashing, docs
from tests.llm.test_minhash import family, slow_set
from wiresift.llm import similar, wide_simhash


def slow_links(texts, least):
    sets = list(map(slow_set, texts))
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
            if a and b and 100 * len(a & b) >= least * len(a | b)]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_fingerprint():
    rng = np.random.default_rng(2)
    shingles = np.unique(rng.integers(0, 2 ** 63, 9001).astype(np.uint64))
    parts = wide_simhash.fingerprint(shingles)
    ones = np.zeros(384, int)
    for w in range(6):
        seed = similar.mixed(np.array([w + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ones[64 * w:64 * w + 64] = np.unpackbits(similar.mixed(shingles ^ seed).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    bits = 2 * ones > len(shingles)
    assert parts.tolist() == [sum(int(bits[48 * i + b]) << b for b in range(48)) for i in range(8)]


def test_cells_meet_all_within_a_step(spark):
    rng, rows = random.Random(5), []
    for _ in range(300):
        a = [rng.randrange(1 << 24) for _ in range(16)]
        b = [x ^ sum(1 << k for k in rng.sample(range(24), rng.choice((0, 1, 2, 2, 3, 3)))) for x in a]
        rows.append((*([x[i] | x[i + 1] << 24 for i in range(0, 16, 2)] for x in (a, b)), sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)), min((x ^ y).bit_count() for x, y in zip(a, b, strict=True))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, far int, near int").withColumn("id", F.monotonically_increasing_id()).cache()
    a, b = (df.select("id", F.col(x).alias("sig")).select("id", F.explode(wide_simhash.keys()).alias("k")).select(
        "id", (F.col("k.key") % similar.HOME).alias("key"), (F.col("k.key") >= similar.HOME).alias(f"home_{x}")) for x in "ab")
    met = a.join(b, ["id", "key"]).where("home_a OR home_b").join(df, "id")
    first = met.groupBy("id").agg(F.count_if(wide_simhash._first(F.col("a"), F.col("b"), F.col("key"))).alias("n"))
    for r in df.join(first, "id", "left").select("*", wide_simhash.distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == r.far and (r.near > 1 or r.n == 1)


def test_segments_are_counted(spark):
    """Segments were one bit wide, so their counts said nothing but the bits."""
    grid, rng, sigs = wide_simhash.LEVELS, np.random.default_rng(4), []
    assert len(grid.marks) == 2
    shingles = np.unique(rng.integers(0, 2 ** 63, 700).astype(np.uint64))
    for n in (4, 5, 16, 700):
        seeds = similar.mixed(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ones = np.concatenate([np.unpackbits(similar.mixed(shingles[:n] ^ x).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) for x in seeds])
        counts = [0 if x <= -n ** 0.5 / 2 else 1 if x <= n ** 0.5 / 2 else 2 for x in (2 * ones.astype(int) - n)[:420].tolist()]
        sig = wide_simhash.fingerprint(shingles[:n], grid).tolist()
        assert sig == [sum((0, 1, 3)[c] << 2 * k for k, c in enumerate(counts[at:at + 30])) for at in range(0, 420, 30)]
        sigs.append((n, sig, counts))
    rows = spark.createDataFrame([(n, sig) for n, sig, _ in sigs], "n int, sig array<long>")
    filed = {r.n: {k.key for k in r.k} for r in rows.select("n", wide_simhash.keys(grid).alias("k")).collect()}
    for n, _, counts in sigs:
        want = set()
        for i in range(28):
            mine = counts[15 * i:15 * i + 15]
            cell = sum(c << 2 * k for k, c in enumerate(mine)) + (i << 30)
            want |= {cell + similar.HOME} | {cell + (1 << 2 * k) for k, c in enumerate(mine) if c < 2}
        assert filed[n] == want


def test_counts_meet_all_within_a_step(spark):
    grid, rng, rows = wide_simhash.LEVELS, random.Random(6), []
    for _ in range(200):
        a = [[rng.randrange(3) for _ in range(15)] for _ in range(28)]
        b = [list(x) for x in a]
        for x in b:
            for k in rng.sample(range(15), rng.choice((0, 1, 2, 2, 3, 3, 3))):
                x[k] = rng.choice([c for c in range(3) if c != x[k]])
        flat = [[(0, 1, 3)[c] for x in y for c in x] for y in (a, b)]
        steps = [sum(abs(x - y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)]
        rows.append((*([sum(c << 2 * k for k, c in enumerate(f[at:at + 30])) for at in range(0, 420, 30)] for f in flat),
                     sum(steps), min(steps)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, far int, near int").withColumn("id", F.monotonically_increasing_id()).cache()
    a, b = (df.select("id", F.col(x).alias("sig")).select("id", F.explode(wide_simhash.keys(grid)).alias("k")).select(
        "id", (F.col("k.key") % similar.HOME).alias("key"), (F.col("k.key") >= similar.HOME).alias(f"home_{x}")) for x in "ab")
    met = a.join(b, ["id", "key"]).where("home_a OR home_b").join(df, "id")
    first = met.groupBy("id").agg(F.count_if(wide_simhash._first(F.col("a"), F.col("b"), F.col("key"), grid)).alias("n"))
    for r in df.join(first, "id", "left").select("*", wide_simhash.distance(F.col("a"), F.col("b"), grid).alias("d")).collect():
        assert r.d == r.far and (r.n == 1 if r.near <= 1 else not r.n)


def test_chance_meetings_are_not_fetched(spark):
    """Of three alone with a key all were fetched, however far apart, and their number grew with the cube of the texts'."""
    rng, rows, want = random.Random(9), [], {}
    for key in range(400):
        n = rng.choice((1, 2, 3, 3, 3, 4))
        subs = [rng.randrange(1 << 60) for _ in range(n)]
        if n > 1 and rng.random() < 0.4:
            i, j = rng.sample(range(n), 2)
            subs[i] = subs[j] ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 24)))
        homes = [rng.random() < 0.5 for _ in range(n)]
        rows += [(key, h, x) for h, x in zip(homes, subs, strict=True)]
        near = n > 3 or any((a ^ b).bit_count() <= 17 for k, a in enumerate(subs) for b in subs[:k])
        if n > 1 and any(homes) and near:
            want[key] = n
    rng.shuffle(rows)
    filed = spark.createDataFrame(rows, "key long, home boolean, sub long")
    assert {r.key: r.n for r in similar._shared(filed, 17).collect()} == want
    fetched = {key for key, home, _ in rows if home and sum(k == key for k, _, _ in rows) > 1}
    assert {r.key for r in similar._shared(filed, 64).collect()} == fetched and len(fetched) > len(want) + 50


def test_recall_at_the_bound(spark):
    """Of the near copies that all pairs tell, nine in ten at least go, and no other text."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    texts = [t for edits in (1, 2, 3, 4, 5, 6) for _ in range(12) for t in family(rng, words, 6, edits)]
    rng.shuffle(texts)
    links = slow_links(texts, 80)
    want = components(len(texts), links)
    left = {r.doc_id for r in wide_simhash.keep_one(docs(spark, list(enumerate(texts)))).collect()}
    copies = {i for i, w in enumerate(want) if w != i}
    assert len(copies) > 150 and len(copies - left) >= 0.95 * len(copies)
    assert {i for i, w in enumerate(want) if w == i and want.count(i) == 1} <= left
    # Nothing goes that has no near copy left or gone before it: classes are parts of the true ones.
    assert {want[i] for i in left} == set(want)


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "A b c  d e f"), (3, "A b c  d e f"), (None, "a b c d e f"), (7, "x y"), (7, "x y"), (7, "z"),
            (8, ""), (8, ""), (9, None), (None, "p q"), (None, "p q"), (None, " ")]
    left = [(r.doc_id, r.text) for r in wide_simhash.keep_one(docs(spark, rows)).collect()]
    want = [(3, "A b c  d e f"), (7, "x y"), (7, "z"), (8, ""), (8, ""), (9, None), (None, "p q"), (None, " ")]
    assert sorted(left, key=repr) == sorted(want, key=repr)
    assert wide_simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0
    df = awkward(spark)
    kept = wide_simhash.keep_one(clashing(df))
    assert kept.columns == clashing(df).columns and kept.count() == 12 - 2
