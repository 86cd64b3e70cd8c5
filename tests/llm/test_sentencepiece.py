"""The streaming codec against the library, and its window."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from tests.llm.helpers import awkward, clashing, docs
from wiresift.llm import sentencepiece_codec as codec

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def mine():
    return codec.Codec(PATH)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def texts(n, seed):
    rng = random.Random(seed)
    parts = [*"abcdeth in  \n\tÉüß▁.,1<s>的𝄞́", "tion", "the", " and", "    ", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_are_the_librarys(library, mine):
    for text in texts(3000, 1):
        ids = mine.encode(text)
        assert numbers(ids) == library.encode(text), text
        assert mine.decode(ids) == library.decode(library.encode(text))


def test_parts_give_the_same(mine):
    rng = random.Random(2)
    for text in texts(1000, 3):
        search, out, rest = mine.stream(), [], mine.normalized(text)
        while rest:
            n = rng.randint(1, 6)
            out += search.push(rest[:n])
            rest = rest[n:]
        assert out + search.finish() == numbers(mine._ids(mine.normalized(text))) == numbers(mine.encode(text))


def test_window_stays_small(mine):
    search = mine.stream()
    for _ in range(2000):
        search.push("▁the▁cat" + "abcdefgh" * 3)
        assert len(search.text) <= 5 * mine.longest
    assert search.most_held <= 6 * mine.longest


def test_unigram_scores(library):
    """The best sum of scores, by trying all splits."""
    model = codec.Codec(PATH)
    model.merges = False
    for text in texts(300, 5):
        text = model.normalized(text)[:40]
        best = [(0.0, ())] + [None] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - model.longest), j):
                found = model.scores.get(text[i:j])
                if found is None and j == i + 1:
                    found = (model.unknown, -1)
                if found and (best[j] is None or best[i][0] + found[0] > best[j][0]):
                    best[j] = (best[i][0] + found[0], (*best[i][1], text[i:j]))
        pieces = [p for p in best[-1][1]]
        want = [x for p in pieces for x in ([model.scores[p][1]] if p in model.scores else [model.byte_ids[b] for b in p.encode()])]
        assert numbers(model._ids(text)) == want


def test_awkward(spark, library):
    df = awkward(spark)
    encoded = codec.encode_documents(clashing(df), PATH)
    rows = codec.decode_documents(encoded, PATH).collect()
    assert sorted((r.doc_id or 0, r.text, numbers(r.ids)) for r in rows) == sorted(
        (r.doc_id or 0, r.text or "", library.encode(r.text or "")) for r in df.collect())
    assert all(r.decoded == r.text for r in rows)
    assert codec.digests(codec.decode_documents(codec.encode_documents(docs(spark, []), PATH), PATH)).count() == 0


def test_query(spark, library):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op8_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(table)
    for r in rows:
        ids = np.array(library.encode(table[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.n_chars) == (len(ids), zlib.crc32(ids.tobytes()), len(table[r.doc_id]))
        assert r.same and r.decoded_sha256 == hashlib.sha256(table[r.doc_id].encode()).hexdigest()


def test_long_unbroken_texts(library, mine):
    """A million characters without a space in seconds, in a window that does not grow."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begin = time.perf_counter()
    ids = mine.encode(text)
    assert time.perf_counter() - begin < 120
    assert mine._search.most_held <= codec.SLICE + 6 * mine.longest
    assert numbers(mine.encode(text[:30_000])) == library.encode(text[:30_000])
    assert mine.decode(ids) == text
    assert mine.decode(mine.encode("a" * 50_000)) == "a" * 50_000
