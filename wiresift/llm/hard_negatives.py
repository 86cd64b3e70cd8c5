"""Hard negatives by exact scores from a residue number system.

Scores are inner products of whole numbers. Both sides are reduced modulo a few
small primes, so that a float32 matrix product of the residues is exact, and the
products are put together by Chinese remaindering in balanced mixed radix, which
gives signed scores without a last comparison.

Anchors are asked against all rows in blocks: anchors and rows are dealt into
groups of bounded size, and each pair of groups is one cell, in which only the best
rows of each anchor stay. A group of anchors meets all groups of rows, so rows move
once per group of anchors, and the work of a cell outweighs what it was sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm.vectors import matrix, usable, whole
from wiresift.session import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors and rows of a cell, about.
ANCHORS = 16_384
ROWS = 16_384
#: Components whose products one float32 sum may hold.
BLOCK = 1024
#: Rows whose square is beyond this have scores that no long holds.
MOST = 2.0 ** 62
_LEAST = np.iinfo(np.int64).min


# Residues.

def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, isqrt(n) + 1))


def moduli(dims: int, bound: int) -> list[int]:
    """Primes for scores of up to ``bound`` in size.

    With balanced residues, a sum over ``BLOCK`` or all ``dims`` products stays below
    2**23, where float32 is exact. The primes' product is over four times the bound,
    so that residues half a step beyond balance do no harm.
    """
    half = min(511, isqrt((1 << 23) // min(max(dims, 1), BLOCK)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 4 * bound + 4 or not found:
        if _prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Residues around zero of whole float32 numbers up to 2**24."""
    return values - np.float32(p) * np.rint(values * np.float32(1 / p))


def residues(x: np.ndarray, p: int) -> np.ndarray:
    return ((x + p // 2) % p - p // 2).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` from residues."""
    out = None
    for at in range(0, a.shape[1] or 1, BLOCK):
        part = balanced(a[:, at:at + BLOCK] @ b[:, at:at + BLOCK].T, p)
        out = part if out is None else balanced(out + part, p)
    return out


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers that have these residues, as longs."""
    digits: list[np.ndarray] = []
    for p, digit in zip(primes, parts, strict=True):
        for q, lower in zip(primes, digits, strict=False):
            inverse = (pow(q, -1, p) + p // 2) % p - p // 2
            digit = balanced((digit - lower) * np.float32(inverse), p)
        digits.append(digit)
    # Beyond 2**63 the steps wrap, and the result does not.
    out = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1], strict=True):
        out = out * np.int64(p) + digit.astype(np.int64)
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of two sides, each given by its residues for each prime."""
    return reconstruct([product(x, y, p) for x, y, p in zip(a, b, primes, strict=True)], primes)


class Best:
    """The ``k`` best (score, row) of each slot; rows must come in their order, which settles ties."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        #: A row must be above its slot's floor.
        self.floor = np.full(slots, _LEAST)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
        self.more = 0

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.held.append((slot, score, row))
        self.more += len(slot)
        if self.more > 1 << 19:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, score, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.floor[slot[last]] = score[last]
        keep = rank < self.k
        self.held, self.more = [(slot[keep], score[keep], row[keep])], 0
        return self.held[0]


# Cells.

class _Side:
    """The rows of one side of a cell, in the order of their ids, those without one last."""

    def __init__(self, table: pa.Table, dims: int, primes: list[int]) -> None:
        ids = table.column("id").combine_chunks()
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        row = table.column("row").to_numpy()
        order = np.lexsort((row, known, missing))
        self.table = table.take(pa.array(order))
        self.row = row[order]
        self.label = self.table.column("label").to_numpy()
        x = matrix(self.table.column("x"), dims)
        self.parts = [residues(x, p) for p in primes]

    def __len__(self) -> int:
        return len(self.row)


def _tiles(n: int) -> Iterator[slice]:
    """Few rows first, as these raise the floors."""
    at, size = 0, 64
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(2 * size, 512)


def _positives(anchors: _Side, rows: _Side, primes: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = Best(len(anchors), k)
    for label in np.unique(anchors.label):
        ours, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for first in range(0, len(ours), 4096):
            mine = ours[first:first + 4096]
            a = [p[mine] for p in anchors.parts]
            for tile in _tiles(len(theirs)):
                other = theirs[tile]
                score = scores(a, [p[other] for p in rows.parts], primes)
                good = (score > best.floor[mine, None]) & (anchors.row[mine, None] != rows.row[None, other])
                i, j = np.nonzero(good)
                best.add(mine[i], score[i, j], other[j])
    return best.settle()


def _negatives(anchors: _Side, rows: _Side, primes: list[int], k: int,
               least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``least`` and ``most`` bound the scores for each anchor (row) and positive (column)."""
    wide = least.shape[1]
    best = Best(len(anchors) * wide, k)
    for first in range(0, len(anchors), 4096):
        mine = np.arange(first, min(len(anchors), first + 4096))
        a = [p[mine] for p in anchors.parts]
        for tile in _tiles(len(rows)):
            score = scores(a, [p[tile] for p in rows.parts], primes)
            other = anchors.label[mine, None] != rows.label[None, tile]
            for column in range(wide):
                slot = mine * wide + column
                good = other & (score > best.floor[slot, None]) & (score >= least[mine, column, None]) \
                    & (score <= most[mine, column, None])
                i, j = np.nonzero(good)
                best.add(slot[i], score[i, j], j + tile.start)
    return best.settle()


def _found(anchors: _Side, rows: _Side, at: np.ndarray, score: np.ndarray, row: np.ndarray,
           **more: np.ndarray) -> pa.Table:
    return pa.table({
        "anchor": pa.array(anchors.row[at]), "score": pa.array(score), "row": pa.array(rows.row[row]),
        "id": rows.table.column("id").take(pa.array(row)), **{c: pa.array(v) for c, v in more.items()}})


# The operator.

def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = SCALE, anchors_a_cell: int = ANCHORS, rows_a_cell: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, embedding, label).

    ``is_anchor`` is a condition on those columns. Components are multiplied by
    ``scale`` and rounded down; a row's score for an anchor is the inner product,
    exact. An anchor's positives are the ``positives`` best other rows of its label;
    for each, the ``negatives`` best rows of other labels are returned whose score
    lies within ``low`` to ``high`` hundredths of the positive's, with ranks from 1.
    Ties go to the smaller id, rows without an id come last; equal rows count each,
    in some order. A positive with no such row gives no row.

    Rows without a label or vector, or with a component that is null, NaN or infinite,
    take no part; nor do those whose vector's square is 2**62 or more, since their
    scores would not fit a long. A shorter vector counts as ending in zeros, an empty
    one scores 0. Other columns are not read.
    """
    spark = rows.sparkSession
    size = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + F.pow(F.abs(c.cast("double")) * F.lit(float(scale)) + 1, F.lit(2.0)))
    named = cut(
        rows.where(F.col("label").isNotNull() & usable("embedding", float("inf"))).where(size < MOST)
        .select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole("embedding", scale).alias("x"))
        .withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, n_anchors, dims, bound = named.agg(
        F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("x")), F.lit(0)),
        F.coalesce(F.max(square), F.lit(0.0))).first()
    primes = moduli(dims, int(bound * (1 + 1e-9)) + 1)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows = max(1, -(-n // rows_a_cell), min(spread, n // 256))
    n_groups = max(1, -(-n_anchors // anchors_a_cell))
    cells = min(n_rows * n_groups, 16_384)

    def dealt(side: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        return (
            side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
            .repartition(cells, "g", "h").groupBy("g", "h")
        )

    everything = dealt(named.select("row", "id", "label", "x"), "h", n_rows, "g", n_groups)
    # Columns of their own, as both sides of a cell come from one table.
    anchors = named.where("asks").select(*(F.col(c).alias(c) for c in ("row", "id", "label", "x")))

    def near(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = _Side(mine, dims, primes), _Side(theirs, dims, primes)
        return _found(a, b, *_positives(a, b, primes, positives))

    def first(found: DataFrame, k: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near_rows = dealt(anchors, "g", n_groups, "h", n_rows).cogroup(everything).applyInArrow(
        near, "anchor long, score long, row long, id long")
    picked = cut(first(near_rows, positives, "anchor").select(
        "anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Whole bounds of a negative's score; a positive for which they cross has none.
    wide = F.col("positive_score").cast("decimal(38,0)")
    asked = (
        picked.withColumn("least", F.ceil(wide * low / 100).cast("long"))
        .withColumn("most", F.floor(wide * high / 100).cast("long")).where("least <= most")
        .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "least", "most"))).alias("asked"))
        .withColumnRenamed("anchor", "row")
    )

    def far(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = _Side(mine, dims, primes), _Side(theirs, dims, primes)
        # Bounds that hold for no score stand where an anchor has fewer positives.
        least, most = np.ones((len(a), positives), np.int64), np.zeros((len(a), positives), np.int64)
        for i, asks in enumerate(a.table.column("asked").to_pylist()):
            for ask in asks:
                least[i, ask["rank"] - 1], most[i, ask["rank"] - 1] = ask["least"], ask["most"]
        slot, score, row = _negatives(a, b, primes, negatives, least, most)
        return _found(a, b, slot // positives, score, row, nth=(slot % positives + 1).astype(np.int32))

    far_rows = dealt(anchors.join(asked, "row"), "g", n_groups, "h", n_rows).cogroup(everything).applyInArrow(
        far, "anchor long, score long, row long, id long, nth int")
    chosen = first(far_rows, negatives, "anchor", "nth").select(
        "anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        chosen.join(picked.withColumnRenamed("rank", "nth"), ["anchor", "nth"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                "positive_score", "negative_score")
    )


def shifted_labels(rows: DataFrame) -> DataFrame:
    """``rows`` where those with a vec_id divisible by 7 carry the next of ten labels."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
