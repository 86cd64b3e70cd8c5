"""Archives written, read back, and damaged."""

import gzip
import hashlib
import random
import zlib

import __spark_entry__ as entry
from wiresift.llm import warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, refers_to int"


def make(page_id, payload, refers_to=None):
    digest = hashlib.sha256(payload).hexdigest()
    return warc.member(warc.record(page_id, "http://x/ü a", payload, digest, len(payload), refers_to))


def test_records_are_gzip_members():
    data = make(1, b"one") + make(2, b"two" * 40_000) + make(3, b"one", 1)
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 3 and b"Target-URI: http://x/\xc3\xbc%20a\r\n" in plain
    for step in (1, 7, 1 << 16):
        got = list(warc.read_records(data, step))
        assert [(r.kind, r.payload, r.page("warc-refers-to")) for r in got] == [
            ("response", b"one", None), ("response", b"two" * 40_000, None), ("revisit", b"", 1)]


def test_large_records_end_in_a_zero_byte():
    big = bytes(17_000_000)
    data = make(1, big) + make(2, b"after")
    assert make(1, big)[-1] == 0
    assert [len(r.payload) for r in warc.read_records(data)] == [17_000_000, 5]


def test_damage():
    good = [make(i, b"payload %d" % i) for i in range(3)]
    cut = list(warc.read_records(good[0] + good[1][:-20]))
    assert [r.kind for r in cut] == ["response", "damaged"]
    bad = bytearray(good[1])
    bad[len(bad) // 2] ^= 0xFF
    kinds = [r.kind for r in warc.read_records(good[0] + bytes(bad) + good[2])]
    assert kinds[0] == "response" and kinds[-1] == "response" and "damaged" in kinds
    def packed(text):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(text) + c.flush()
    plain = gzip.decompress(good[1])
    for broken in (plain.replace(b"payload 1", b"payload 2"), plain[:-4], plain + b"x", plain.replace(b"Content-Length: 9", b"Content-Length: 8"),
                   b"HTTP/1.1 200 OK\r\n\r\n", plain.replace(b"WARC-Type: ", b"WARC-Type ")):
        assert [r.kind for r in warc.read_records(packed(broken) + good[2])] == ["damaged", "response"]
    assert list(warc.read_records(b"")) == []
    assert [r.kind for r in warc.read_records(b"no archive")] == ["damaged"]


def test_awkward(spark):
    long, other = "same text " * 20, "x" * 300_000
    rows = [(5, "u", long), (3, None, long), (3, None, long), (None, "u", long), (9, "a b\n", other), (2, "u", None), (1, "u", ""),
            (7, "u", "short"), (8, "u", "short"), (None, None, "twice, but without any id" * 8), (None, None, "twice, but without any id" * 8)]
    df = spark.createDataFrame([(*r, "d", 4) for r in rows], SCHEMA)
    folder = warc.archive_folder(spark)
    warc.write_archives(df, folder, records_per_file=2)
    got = warc.read_archives(spark, folder).collect()
    def key(r):
        return (r.page_id or 0, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or 0, bytes(r.payload))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and page != 3
        want.append((page or 0, "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(),
                     3 if revisit else 0, b"" if revisit else data))
    assert sorted(map(key, got)) == sorted(want)
    assert {r.problem for r in got} == {None}


def test_empty(spark):
    folder = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = {r.page_id: r for r in entry.queries()["op5_warc"](spark, SF).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        data = (p.html or "").encode()
        r = rows[p.page_id]
        same = min(q.page_id for q in pages if q.html == p.html)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", same) if len(data) >= 100 and same != p.page_id else ("response", None))


def test_files_roll_by_bytes(spark):
    """Large records have files of their own; none holds more than it may."""
    rng = random.Random(7)
    sizes = [100, 3000, 70_000, 900_000, 1_100_000, 20_000_000] * 3
    rows = [(i, "u", "".join(rng.choices("abcdefgh", k=n // 100)) * 100, "d", 0) for i, n in enumerate(sizes)]
    folder = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, file_bytes=4 << 20)
    held = []
    for r in spark.read.format("binaryFile").load(folder).select("content").collect():
        records = list(warc.read_records(bytes(r.content)))
        held.append((len(records), sum(len(x.payload) for x in records)))
    assert sum(n for n, _ in held) == len(rows)
    assert all(n == 1 or size <= 4 << 20 for n, size in held) and max(n for n, _ in held) > 1
    back = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, folder, payloads=False).collect()}
    assert back == {i: len(h) for i, _, h, _, _ in rows}
