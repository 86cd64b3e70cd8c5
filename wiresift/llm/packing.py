"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Bins are filled greedily with the longest piece that fits. Then a bin's smallest
piece gives way to two pieces that together fill its place and the gap more
tightly. The choice depends on lengths alone, so the plan is made on the counts of
the at most ``capacity`` lengths: a bin's recipe is repeated as long as its lengths
last, which is what packing bin after bin would do. Pieces then find their place by
their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiresift.llm.common import giving_back, long_id, pieces
from wiresift.llm.tokens import word_encoder
from wiresift.session import cut

CAPACITY = 2048


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every row's whole text.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Longer ones are cut into pieces of ``capacity``, the last as long as it comes.
    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    tail = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in pieces(batches, 2048):
            out: list[tuple] = []
            found = encode.many(text.as_py() or "" for text in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += tail
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    out.append((doc, at // step, at // 4, len(part) // 4, zlib.crc32(part), part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=False), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(long_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in a bin) for so many pieces of each length.

    Every step uses up some length's stock or leaves less than the recipe takes,
    so there are at most about two steps a length, however many pieces there are.
    """
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} in sequences of {capacity}")
        stock[length] = n
    plan = []
    while stock.any():
        recipe = _fill(stock, capacity)
        lengths, uses = np.unique(recipe, return_counts=True)
        times = int((stock[lengths] // uses).min())
        stock[lengths] -= times * uses
        plan.append((times, recipe))
    return plan


def _fill(stock: np.ndarray, capacity: int) -> list[int]:
    left = stock.copy()
    bin_, gap = [], capacity
    while gap:
        fits = np.flatnonzero(left[1:gap + 1])
        if not len(fits):
            break
        length = int(fits[-1]) + 1
        bin_.append(length)
        left[length] -= 1
        gap -= length
    if gap and bin_:
        smallest = bin_[-1]
        pair = _best_two(left, smallest + gap)
        if pair and sum(pair) > smallest:
            bin_[-1:] = pair
    return bin_


def _best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two lengths in stock with the largest sum within ``room``."""
    have = left[:room] > 0
    largest = np.where(have, np.arange(room), 0)
    np.maximum.accumulate(largest, out=largest)
    first = np.flatnonzero(have)
    first = first[first <= room // 2]
    if not len(first):
        return None
    # The partner of a is the largest length up to room - a; a itself only if two are left.
    second = largest[np.minimum(room - first, room - 1)]
    alone = (second == first) & (left[first] < 2)
    second = np.where(alone, largest[first - 1], second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return [int(second[best]), int(first[best])] if total[best] else None


def _places(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from rank ``rank`` on, those of a length
    take slot ``offset`` of sequence ``sequence`` and the following ones."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, recipe in plan:
        offset = 0
        for length in recipe:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": out[:, 0], "rank": out[:, 1], "sequence": out[:, 2], "offset": out[:, 3]}


def assign(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut_pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Pieces of a length are ranked by (bucket, doc_id, piece), with buckets by hash,
    so a length that very many pieces share is ranked by many tasks. Repeated rows
    are ranked side by side, each with a place of its own. Only counts by length and
    the plan (a few places a length) pass through the driver.
    """
    cut_pieces = cut(cut_pieces)
    spark = cut_pieces.sparkSession
    by_length = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = _places(plan_bins(by_length, capacity))
    # A length that more than a task's share of rows has is ranked in so many buckets.
    share = max(1, sum(by_length.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 + max(by_length.values(), default=0) // share
    spread = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("n")).alias("before"))
    ranked = spread.withColumn("nth", F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("nth") - 1).drop("bucket", "before", "nth")
    shared = spark.sparkContext.broadcast(places)
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        # Length and rank as one sorted key: the length in the top bits, below the sign.
        unit = 1 << 62 - capacity.bit_length()
        keys = where["length"] * unit + where["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * unit + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(where["sequence"][at] + rank - where["rank"][at]), pa.array(where["offset"][at])],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Where each document's pieces lie: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``docs`` has doc_id and text; other columns are not read. Null ids stay null,
    and repeated rows are packed once each. An empty table gives an empty result.
    """
    return assign(tokenised_pieces(docs, tokenizer, capacity, end_id).drop("ids"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
