"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles, sorted. The
sketch of a union is the k smallest of the sketches' hashes, so sketches of parts
merge. A sketch with fewer than k hashes is the whole set, and its estimates are
exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm.common import pieces

K = 128
SHINGLE = 5


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased ``data``."""
    words = data.lower().split()
    # A remembered hash takes longer to find among many than to compute.
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words; of all words if there are fewer; none without words."""
    n = min(shingle, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i])
    return out


def sketch(text: str | None, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes of a whole text, sorted; empty for a null or blank one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hashes = shingle_hashes(word_hashes(data), shingle)
    if len(hashes) > 8 * k:
        # Repeats may hide distinct hashes: look among more of the smallest until k are found.
        take = 4 * k
        while take < len(hashes):
            found = np.unique(np.partition(hashes, take)[:take])
            if len(found) > k:
                return found[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union."""
    parts = list(sketches)
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0 ** 64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of shingles of either that both have; 1 if neither has any."""
    union = merge((a, b), k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    shared = resemblance(a, b, k) * distinct(merge((a, b), k), k)
    return min(1.0, shared / distinct(a, k))


def packed(a: np.ndarray) -> str:
    """A sketch as text: its hashes, little-endian, in base 64."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode("ascii")


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (packed); other columns stay, but for one of that name."""
    docs = docs.drop("fingerprint")
    where = docs.columns.index(text_col)
    names = [*docs.columns, "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [packed(sketch(t, k, shingle)) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def merge_by(found: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint, distinct_shingles) of the union of ``fingerprint`` per ``key``.

    Each task merges what it has of a key before the shuffle, so a key with very many
    documents sends one sketch a task. Null keys are a key of their own.
    """
    name = found.schema[key].name
    pairs = found.select(F.col(key).cast("string").alias("key"), "fingerprint")

    def flush(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([packed(s) for s in held.values()], pa.string())],
            names=["key", "fingerprint"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in pieces(batches):
            for value, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = unpacked(text)
                held[value] = merge((held[value], new), k) if value in held else new
            if len(held) > 20_000:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by key: one key is held at a time.
        now, mine, out = None, None, []
        for batch in batches:
            for value, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mine is not None and value == now:
                    mine = merge((mine, unpacked(text)), k)
                    continue
                if mine is not None:
                    out.append((now, packed(mine), distinct(mine, k)))
                now, mine = value, unpacked(text)
        if mine is not None:
            out.append((now, packed(mine), distinct(mine, k)))
        if out:
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())],
                names=["key", "fingerprint", "distinct_shingles"])

    schema = "key string, fingerprint string"
    return (
        pairs.mapInArrow(fold, schema).repartition("key").sortWithinPartitions("key")
        .mapInArrow(finish, f"{schema}, distinct_shingles double").withColumnRenamed("key", name)
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) sorted so that each is followed by its next document.

    Order is by doc_id, descending, those without one last, equal ones by text; the
    next after the last is the first. Documents are dealt into ranges of ids; each
    range ends with a copy (``guest``) of the document that comes after it. Only the
    ranges' bounds and first ids, a few per shuffle partition, pass through the
    driver. Null texts are empty.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 100_000)).first()[0]
    edges = np.unique(np.array([b for b in bounds or [] if b is not None], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(edges, ids[known].to_numpy().astype(np.int64))
        return pd.Series(out)

    dealt = rows.withColumn("bucket", bucket("doc_id"))
    tops = {r[0]: r[1] for r in rows.select("doc_id").withColumn("bucket", bucket("doc_id"))
            .groupBy("bucket").agg(F.max("doc_id")).collect()}  # a row a bucket
    order = sorted(tops, reverse=True)
    # Who borrows whose first document.
    lenders = [(b, order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    schema = "borrower int, lender int, top long"
    wanted = spark.createDataFrame([(b, x, tops[x]) for b, x in lenders], schema)
    guests = (
        dealt.join(F.broadcast(wanted), (F.col("bucket") == F.col("lender")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("borrower").agg(F.min("text").alias("text"))
        .select(F.col("borrower").alias("bucket"), F.lit(1).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "text")
    )
    return (
        dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").union(guests)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document and its edited text, held against each other and the next document's.

    Repeated rows are documents of their own; a single document is its own next one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        out: list[tuple] = []
        for batch in pieces(batches, 256):
            for bucket, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = (bucket, guest, doc, text, sketch(text, k, shingle))
                if before is not None and before[0] == bucket and not before[1]:
                    changed = edited(before[3], text)
                    after = sketch(changed, k, shingle)
                    out.append((
                        before[2], len(before[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        packed(before[4]), packed(after), resemblance(before[4], after, k),
                        resemblance(before[4], here[4], k)))
                before = here
            if out:
                yield _compared(out)
                out = []

    return neighbours(docs).mapInArrow(run, COMPARED)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in COMPARED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
        names=[n for n, _ in fields])
