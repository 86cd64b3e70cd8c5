"""Sketches against exact sets, merging, and the order of neighbours."""

import hashlib
import random
import tracemalloc

import numpy as np
import xxhash

import __spark_entry__ as entry
from tests.llm.helpers import awkward, clashing, docs
from wiresift.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def test_words_are_hashed_without_memory():
    """Up to 150,000 words were remembered, which took longer to look up than to hash again."""
    data = " ".join(f"W{i}" for i in range(50_000)).encode()
    tracemalloc.start()
    found = fp.word_hashes(data)
    kept = tracemalloc.get_traced_memory()[0] - found.nbytes
    tracemalloc.stop()
    assert kept < 100_000
    assert found[::997].tolist() == [xxhash.xxh64_intdigest(f"w{i}".encode()) for i in range(0, 50_000, 997)]


def test_estimates():
    rng = random.Random(1)
    errors = []
    for n, shared in ((60, 0.5), (3000, 0.5), (4000, 0.9), (5000, 0.1), (2000, 0.0), (3000, 1.0)) * 5:
        a = words(rng, n)
        b = a[:int(n * shared)] + words(rng, n - int(n * shared))
        x, y = " ".join(a), " ".join(b)
        sx, sy, fx, fy = shingles(x), shingles(y), fp.sketch(x), fp.sketch(y)
        errors.append(abs(fp.resemblance(fx, fy) - len(sx & sy) / len(sx | sy)))
        assert abs(fp.containment(fx, fy) - len(sx & sy) / len(sx)) < 0.3
        assert abs(fp.distinct(fx) / len(sx) - 1) < 0.4
    assert np.mean(errors) < 0.04 and max(errors) < 0.15


def test_small_sets_are_exact():
    a, b = "a b c d e f g h", "b c d e f g h i j"
    x, y = shingles(a), shingles(b)
    assert fp.resemblance(fp.sketch(a), fp.sketch(b)) == len(x & y) / len(x | y)
    assert fp.containment(fp.sketch(a), fp.sketch(b)) == len(x & y) / len(x)
    assert fp.distinct(fp.sketch(a)) == len(x)
    assert len(fp.sketch("one two")) == 1 and len(fp.sketch("")) == len(fp.sketch(None)) == 0
    assert fp.resemblance(fp.sketch(""), fp.sketch(" ")) == 1.0 and fp.resemblance(fp.sketch(""), fp.sketch("a")) == 0.0
    assert fp.packed(fp.sketch("A b\nC")) == fp.packed(fp.sketch("a  b c"))
    many = "same five words once more " * 50_000 + " ".join(words(random.Random(0), 300))
    assert (fp.sketch(many) == np.unique(fp.shingle_hashes(fp.word_hashes(many.encode())))[:fp.K]).all()


def test_merging(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(None if i % 7 == 0 else f"s{i % 3}", t) for i, t in enumerate(texts)], "source string, text string")
    got = {r.source: r for r in fp.merge_by(fp.sketches(df.repartition(5)), "source").collect()}
    for source in (None, "s0", "s1", "s2"):
        mine = [t for i, t in enumerate(texts) if (None if i % 7 == 0 else f"s{i % 3}") == source]
        hashes = np.unique(np.concatenate([fp.shingle_hashes(fp.word_hashes(t.encode())) for t in mine]))
        assert (fp.unpacked(got[source].fingerprint) == hashes[:fp.K]).all()
        assert abs(got[source].distinct_shingles / len(hashes) - 1) < 0.4
    assert fp.merge_by(fp.sketches(df.limit(0)), "source").count() == 0


def check(rows, table):
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (i, text), (_, after) in zip(order, [*order[1:], *order[:1]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = fp.sketch(text), fp.sketch(changed), fp.sketch(after)
        want.append((i or 0, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.packed(a), fp.packed(b),
                     fp.resemblance(a, b), fp.resemblance(a, c)))
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in rows) == sorted(want)


def test_awkward(spark):
    df = awkward(spark)
    check(fp.compare_with_next(clashing(df)).collect(), [(r.doc_id, r.text) for r in df.collect()])
    for rows in ([], [(4, "only one")], [(None, None)], [(i % 3, f"t{i // 2} x y z") for i in range(40)]):
        check(fp.compare_with_next(docs(spark, rows)).collect(), rows) if rows else None
    assert fp.compare_with_next(docs(spark, [])).count() == 0


def test_query(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(entry.queries()["op9_fingerprint"](spark, SF).collect(), table)
