"""Packing: tokens against the library, places without gaps, few sequences."""

import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm.helpers import awkward, clashing, docs
from wiresift.llm import packing, tokens
from wiresift.llm.queries import word_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_tokens_are_the_librarys(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    encode = tokens._make(word_tokenizer())
    rng = random.Random(1)
    parts = [*"abAÉßİΣςst  \n\t.,!<|>́\x1c9é½'", "<|endoftext|>", "'s", "THE", "word"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert numbers(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_encoded_together(tokenizer, monkeypatch):
    """One by one, as before, this text took 600 calls."""
    calls = []

    class Counted:
        normalizer, to_str = tokenizer.normalizer, tokenizer.to_str

        def encode(self, text, **options):
            calls.append(text)
            return tokenizer.encode(text, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", type("", (), {"from_file": staticmethod(lambda path: Counted())}))
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdéÉßXYZ") for _ in range(rng.randint(3, 12))) for _ in range(600))
    encode = tokens._make("any")
    assert numbers(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) < 5
    assert numbers(encode(text + " new")) == tokenizer.encode(text + " new", add_special_tokens=False).ids


def test_new_words_of_many_texts_are_encoded_together(tokenizer, monkeypatch):
    """Text by text, these took 40 calls, each with normalising and splitting."""
    calls = []
    kept = tokens._plain_words(word_tokenizer(), tokenizer)
    monkeypatch.setattr(tokens, "_plain_words", lambda *_: lambda words: calls.append(len(words)) or kept(words))
    rng = random.Random(6)
    letters = "abcXYZ" + "".join(map(chr, range(0xC0, 0x100)))
    texts = ["", *(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", "!'s"])
                            for _ in range(50)) for _ in range(40)), "\n", "new"]
    encode = tokens._make(word_tokenizer())
    assert [numbers(ids) for ids in encode.many(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and calls[0] > 1000
    words = sorted({w for t in texts for w in t.lower().split() if w.isalpha()})
    data, edges = kept(words)
    assert [numbers(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)] \
        == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    monkeypatch.setattr(tokens, "MEMO", 30)
    encode = tokens._make(word_tokenizer())
    assert [numbers(ids) for ids in encode.many(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_are_large(tokenizer, monkeypatch):
    """Groups of 1,048,576 characters encoded words of these texts three times; chunks were remembered one by one."""
    calls = []
    kept = tokens._plain_words(word_tokenizer(), tokenizer)
    monkeypatch.setattr(tokens, "_plain_words", lambda *_: lambda words: calls.append(len(words)) or kept(words))
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdeÉ") for _ in range(8)) + rng.choice(["", ".", "\n", " 9é"]) for _ in range(2500)) for _ in range(100)]
    assert sum(map(len, texts)) > 2 << 20
    encode = tokens._make(word_tokenizer())
    found = list(encode.many(texts))
    assert len(calls) == 1
    for k in (0, 50, 99):
        assert numbers(found[k]) == tokenizer.encode(texts[k], add_special_tokens=False).ids
    assert list(encode.many([])) == [] and [numbers(x) for x in encode.many(["", "\n ", ""])] == [[], [], []]


HELD = """
import random, re, sys
import pyarrow as pa
from pyspark.sql import DataFrame
from wiresift.llm import packing
from wiresift.llm.queries import word_tokenizer

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Table:
    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

packing.long_id = packing.F.col = lambda _: type("C", (), {"alias": lambda *_: 0, "cast": lambda self, _: self})()
run = packing.tokenised_pieces(Table(), word_tokenizer())
rng = random.Random(3)
for _ in range(2):
    texts = (" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(4000)) for _ in range(100))
    rows = sum(b.num_rows for b in run(iter([pa.record_batch({"doc_id": list(range(100)), "text": list(texts)})])))
print(rows, held())
"""


def test_workers_give_memory_back():
    """A worker held 584 MB after these tasks, beside what other stages took of the executor."""
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 100 and float(out[1]) < 260


def slow_plan(lengths, capacity):
    """One bin after the other, as the method says."""
    left = sorted(lengths)
    bins = []
    while left:
        bin_, gap = [], capacity
        while True:
            fits = [x for x in left if x <= gap]
            if not fits:
                break
            bin_.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        room = bin_[-1] + gap
        pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1:] if bin_[-1] < a + b <= room]
        if gap and pairs:
            total = max(pairs)[0]
            a = min(x for s, x in pairs if s == total)
            old = bin_.pop()
            for x in (a, total - a):
                left.remove(x)
                bin_.append(x)
            left.append(old)
            left.sort()
        bins.append(sum(bin_))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan(lengths):
    plan = packing.plan_bins(Counter(lengths), 40)
    used = Counter(x for times, recipe in plan for x in recipe for _ in range(times))
    assert used == Counter(lengths)
    assert all(sum(recipe) <= 40 for _, recipe in plan)
    assert sorted(sum(r) for n, r in plan for _ in range(n)) == sorted(slow_plan(lengths, 40))


def test_plan_is_short():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 200_000), rng.integers(1, 60, 100_000), np.full(10_000, 7)):
        plan = packing.plan_bins(Counter(lengths.tolist()))
        assert len(plan) < 2 * 2048
        assert sum(n for n, _ in plan) <= -(-lengths.sum() // 2048) * 1.01 + 1


def check_places(rows, capacity=2048):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def want(tokenizer, texts):
    out = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at:at + 2048], "<u4")
            out.append((doc, at // 2048, at, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def test_awkward(spark, tokenizer):
    df = awkward(spark)
    rows = packing.pack(clashing(df), word_tokenizer()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want(
        tokenizer, [(r.doc_id, r.text) for r in df.collect()])
    check_places(rows)
    assert packing.pack(docs(spark, []), word_tokenizer()).count() == 0


def test_crowded_length(spark):
    rows = packing.assign(spark.range(3000).selectExpr(
        "id AS doc_id", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 500L ELSE 1 + id % 700 END AS length")).collect()
    assert len(rows) == 3000
    assert check_places(rows) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_query(spark, tokenizer):
    rows = entry.queries()["op3_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want(tokenizer, texts)
    assert check_places(rows) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
