"""Text statistics against a slow version; rules against labels that they have not seen."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.helpers import DOCS, awkward, clashing, docs
from wiresift.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside)}


def fast(text):
    return dict(zip(quality.STATISTICS, quality.text_statistics(text), strict=True))


def test_statistics():
    rng = random.Random(3)
    texts = ["", None, "a", "a b", "a b c", "a a a a a", "x y z x y z", " \t\x0b", "é 的 𝄞\x85x \xa0 b", "l1\nl1\n \n\nl1 "]
    texts += ["".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "|", "é"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for text in texts:
        got, want = fast(text), slow(text)
        assert {k: got[k] for k in want} == want, text


def test_very_long_text():
    assert fast("a b c d " * 200_000)["n_repeat_words"] == 800_000


def test_learned_rules_are_found():
    rng = np.random.default_rng(0)
    values = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    unwanted = (values["a"] > 0.8) & (values["b"] < 0.5) | (values["c"] < 0.1)
    rules = quality.learn(values, unwanted)
    fresh = {k: rng.random(3000) for k in values}
    want = (fresh["a"] > 0.8) & (fresh["b"] < 0.5) | (fresh["c"] < 0.1)
    assert (rules.rejects(fresh) == want).mean() > 0.97
    assert all(len(r) <= 4 for r in rules.rules)


def test_one_class_or_no_rows():
    assert quality.learn({"a": np.arange(9.0)}, np.zeros(9, bool)).rules == ()
    assert quality.learn({"a": np.empty(0)}, np.empty(0, bool)).rules == ()


def test_columns_say_the_same(spark):
    rules = quality.DecisionList((
        (quality.Condition("a", True, 0.5), quality.Condition("b", False, 0.25)), (quality.Condition("b", True, 0.9),)))
    rng = np.random.default_rng(1)
    a, b = rng.random(200).round(2), rng.random(200).round(2)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    got = [r[0] for r in df.select(rules.keeps({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == (~rules.rejects({"a": a, "b": b})).tolist()


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rules = quality.learn_from(table, labels.where("doc_id % 2 = 0"), max_labelled=1500)
    judged = quality.judge(table, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    good, bad, kept_good, kept_bad = judged.agg(
        F.sum(F.col("quality")), F.sum(1 - F.col("quality")), F.sum(F.when(F.col("kept"), F.col("quality")).otherwise(0)),
        F.sum(F.when(F.col("kept"), 1 - F.col("quality")).otherwise(0))).first()
    assert kept_good >= 0.99 * good and kept_bad <= 0.05 * bad


def test_awkward(spark):
    rules = quality.learn_from(awkward(spark), spark.createDataFrame(
        [(1, 0, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int"))
    assert rules.rules == ()
    got = quality.judge(clashing(awkward(spark)), rules)
    assert got.count() == 12 and dict(got.dtypes)["kept"] == "boolean"
    assert [r.doc_id for r in got.where("kept").collect()] == [5]
    assert quality.judge(docs(spark, []), rules).columns == [*DOCS.names, "statistics", "base_failed", "kept"]


@pytest.fixture(scope="module")
def rows(spark):
    return entry.queries()["op7_quality_rules"](spark, SF).collect()


def test_query(spark, rows):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id]) if len(texts[r.doc_id]) < 20_000 else None
        if want:
            assert {k: r[k] for k in want} == want
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
