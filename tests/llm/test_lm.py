"""Exact base scores, and a model that does better on documents it has not seen."""

import math
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from tests.llm.helpers import awkward, clashing, docs
from wiresift.llm import lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w] + [b"\n"]


def out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def base(table):
    count = Counter(t for i, x in table if not out(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return sorted((i or 0, out(i), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n,
                   round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in table)


def brief(rows):
    return sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in rows)


def same(rows, table):
    for a, b in zip(brief(rows), base(table), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-5)


def test_levels():
    n = np.arange(1, 5000)
    level = lm.levels(n)
    assert (np.diff(level) >= 0).all() and level[0] == 1
    near = lm.typical(level)
    assert (np.abs(near / n - 1) < 0.5).all() and near[:2].tolist() == [1, 2]
    assert lm.typical(np.array([0]))[0] == 0


def test_filter():
    rng = np.random.default_rng(0)
    keys = lm.mixed(rng.integers(0, 2 ** 63, 20_000, dtype=np.uint64))
    level = rng.integers(1, 9, len(keys))
    bits = max(512, 10 * int(level.sum()) // 8 // 64 * 64)
    here = lm.Filter(np.zeros(8 * bits // 8, np.uint8), bits, 8)
    for at in range(1, 9):
        some = keys[level >= at]
        for i in range(lm.PROBES):
            byte, bit = lm._place(*lm._spread(some, np.uint64(at)), i, bits)
            np.bitwise_or.at(here.bits, lm.region_of(some, 8) * (bits // 8) + byte.astype(np.int64), (1 << bit).astype(np.uint8))
    found = here.level(keys)
    assert (found >= level).all() and (found == level).mean() > 0.97
    assert (here.level(lm.mixed(keys + np.uint64(1))) > 0).mean() < 0.03
    third = here.has(keys, 3)
    assert (np.diff(third) > 0).all() and set(np.flatnonzero(level >= 3)) <= set(third) and len(third) < 1.03 * (level >= 3).sum()


def test_remembered_levels():
    """Levels of frequent words are the filter's, the first time and later."""
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 2 ** 63, 3000, dtype=np.uint64))
    here = lm.Filter(rng.integers(0, 256, 4096, dtype=np.uint8) | np.uint8(0xB7), 4096 * 4, 2)
    for frequent in (words[::3], words[:0]):
        memo = lm.Remembered(lm.Model(here, 0, 0, frequent, np.ones(len(frequent))))
        for _ in range(3):
            some = np.sort(rng.choice(words, 700, replace=False))
            for salt in (lm._WORD, lm._AGAIN):
                assert memo(some, salt).tolist() == here.level(lm.mixed(some ^ salt)).tolist()


def test_frequent_words_are_bounded(spark):
    rows = [(i, 1 + i % 5 + (1000 if i < 30 else 0)) for i in range(1000)]
    words = spark.createDataFrame(rows, "token long, count long")
    for most in (0, 10, 40, 400, 5000):
        table, lowest = lm._frequent(words, most)
        assert table.num_rows <= most and sorted(table["count"].to_pylist()) == sorted(c for _, c in rows if c >= lowest)


def test_rare_words_are_joined(spark, monkeypatch):
    table = [(i, f"the cat{i % 3} sat on mat{i % 17} Ünique{i}") for i in range(80)]
    monkeypatch.setattr(lm, "_frequent", lambda words, most=5, f=lm._frequent: f(words, 5))
    same(lm.score(docs(spark, table)).collect(), table)


def test_small_chunks_and_segments(spark, monkeypatch):
    table = [(i, "the cat sat on the mat and " * (i % 4) + f"end{i % 5}") for i in range(60)]
    rows = lm.score(docs(spark, table)).collect()
    monkeypatch.setattr(lm, "SEGMENT", 20)
    same(lm.score(docs(spark, table)).collect(), table)
    same(rows, table)


def test_awkward(spark):
    df = awkward(spark)
    rows = lm.score(clashing(df)).collect()
    same(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert lm.score(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if out(i))
    assert [(r.base_score, r.score, r.n_known) for r in lm.score(docs(spark, [(held, "none to learn from")])).collect()] == [(0.0, 0.0, 0)]


def test_probabilities_add_up(spark):
    table = [(i, "a b a c a b d " * (1 + i % 3)) for i in range(40)]
    model, _, _ = lm.train(docs(spark, table).select("doc_id", "text"))
    ids = {w: lm.word_hashes(w.encode())[0] for w in "abcd"} | {"end": lm.END}
    for context in ids.values():
        sequence = np.array([x for w in ids.values() for x in (context, w)], np.uint64)
        scores = model.log10(lm._ngrams(sequence, np.array([0])))[1::2]
        assert 0.5 < (10 ** scores).sum() < 1.5


def test_query(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = entry.queries()["op10_lm_score"](spark, SF).collect()
    same(rows, table)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    seen = [r for r in rows if not r.held_out]
    assert sum(r.score for r in seen) > 0.95 * sum(r.base_score for r in seen)


def test_large_filters_stay_in_regions(spark, monkeypatch):
    """The bits per event do not depend on the size, nor do the scores on where the filter lies."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    monkeypatch.setattr(lm, "_SCORE_TOKENS", 5000)

    def found():
        return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)), r.score)
                      for r in lm.score(rows).collect())

    small = found()
    monkeypatch.setattr(lm, "BROADCAST_BITS", 1000)
    large = found()
    assert [a for a, _ in small] == [a for a, _ in large]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(small, large, strict=True))
    assert not lm.learn(rows).fits


def test_pairs_seen_once_count(spark):
    """All pairs below occur once: each is likelier than the same word after another context."""
    table = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60) if not out(i)]
    model, _, _ = lm.train(docs(spark, table).select("doc_id", "text"))
    _, text = table[0]
    word = lm.word_hashes(text.encode())
    seen = model.log10(lm._ngrams(word, np.array([0])))[1:]
    unseen = model.log10(lm._ngrams(np.stack([word[2:], word[:-2]], axis=1).ravel(), np.array([0])))[1::2]
    assert seen.min() > math.log10((1 - lm.DISCOUNT) / 2) and np.median(unseen) < seen.min() - 1
    held = next(i for i in range(100) if out(i))
    rows = lm.score(docs(spark, [*table, (held, text)])).collect()
    assert all(r.score > 0.6 * r.base_score for r in rows)


def test_rows_of_a_region_are_taken_together(spark, monkeypatch):
    """The filter and the scores do not depend on how many rows' keys are set or looked up at once."""
    rows = docs(spark, [(i, f"a{i % 7} b{i} a{i % 5} c") for i in range(120)]).select("doc_id", "text")
    monkeypatch.setattr(lm, "BROADCAST_BITS", 0)
    monkeypatch.setattr(lm, "_SCORE_TOKENS", 50)
    calls = spark.sparkContext.accumulator(0)
    level = lm.Filter.level

    class Counted(lm.Filter):
        def level(self, keys, first=1):
            calls.add(1)
            return level(self, keys, first)
    monkeypatch.setattr(lm, "Filter", Counted)

    def found(together):
        before = calls.value
        monkeypatch.setattr(lm, "_TOGETHER", together)
        bits = {r.seg: bytes(r.bits) for r in lm.learn(rows).built.collect()}
        scores = sorted((r.doc_id, r.score) for r in lm.score(rows).collect())
        return (bits, scores), calls.value - before

    (one, few), (other, many) = found(1 << 19), found(1)
    assert one == other and few < many / 1.5
