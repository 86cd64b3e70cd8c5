"""Near-duplicates at a given resemblance from wide SimHash fingerprints.

The 64 bits of ``simhash.py`` tell texts apart that are all but equal. Texts whose
shingle sets have a resemblance of 0.8 differ in 15 of 100 bits on average, and few
pairs of them are within 3 of 64. Here a fingerprint is made of 420 sums over distinct
5-word shingles, each with a segment of 2 bits: one says whether the sum is above a mark
below its middle, one whether it is above a mark as far over it. As in ``simhash.py``
the count of set bits in each segment is a place in an integer grid, and one step there
is one bit; the second mark keeps counts from losing what bits tell, which those of
unrelated bits do. The grid is dealt into 28 parts of 15 segments; a fingerprint is
filed in its own cell of each part and in the cells one step up, and pairs that agree in
some part up to one step are compared. What is within ``MAX_BITS`` is verified on the
shingle sets.

A part is within one step with a chance of 0.06 at a resemblance of 0.8, 0.11 at 0.85
and 0.21 at 0.9, so pairs are met with 0.83, 0.96 and 0.99; components, which join
copies through others, lose fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.llm import similar as near_sets
from wiresift.llm.common import long_id, small
from wiresift.llm.fingerprint import mixed
from wiresift.llm.simhash import embed
from wiresift.session import cut

SHINGLE = 5
#: Texts are linked from this resemblance on, in hundredths.
SIMILAR = 80
#: Parts in a long of a fingerprint.
HELD = 2
#: Of 60 bits, 8 are expected to differ at 0.8, with a deviation of 2.5.
SUB_BITS = 17
#: Of 840 bits, 112 are expected to differ at 0.8, with a deviation of 9.
MAX_BITS = 140
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Grid:
    """How fingerprints are cut: parts, segments of a part, and the marks of a segment's bits, from low to high.

    A bit is set if its segment's sum is above the mark, in deviations of the sum, so
    bits are set from the low one on.
    """

    parts: int
    segments: int
    marks: tuple[float, ...]

    @property
    def longs(self) -> int:
        return self.parts // HELD

    @property
    def width(self) -> int:
        return self.segments * len(self.marks)


#: Single bits, set if over half of the hashes have them: counts are the bits.
BITS = Grid(16, 24, (0.0,))
#: Segments of two bits, with counts from 0 to 2.
LEVELS = Grid(28, 15, (-0.5, 0.5))


def fingerprint(shingles: np.ndarray, grid: Grid = BITS) -> np.ndarray:
    """A set's fingerprint, two parts in a long."""
    places = grid.parts * grid.segments
    words = -(-places // 64)
    seeds = mixed(np.arange(1, words + 1, dtype=np.uint64) * _STEP)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 4096):
        spread = mixed(shingles[at:at + 4096, None] ^ seeds)
        ones += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    sums = 2 * ones[:places, None] - len(shingles)
    bits = (sums > np.sqrt(len(shingles)) * np.array(grid.marks)).reshape(grid.longs, HELD * grid.width)
    return bits @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64))


def _part(sig: Column, i: int, grid: Grid) -> Column:
    return F.shiftright(sig[i // HELD], i % HELD * grid.width).bitwiseAND(F.lit((1 << grid.width) - 1))


def _cell(bits: Column, grid: Grid) -> Column:
    """A part's counts of set bits per segment; of single bits, these are the bits."""
    return embed(bits, len(grid.marks)) if len(grid.marks) > 1 else bits


def keys(grid: Grid = BITS) -> Column:
    """The cells of ``sig``: in each part its own, and those one step up."""
    most, cells = len(grid.marks), []
    for i in range(grid.parts):
        # Half a fingerprint away from the part, where texts that only share its cell differ as any two do.
        sub = F.col("sig")[(i // HELD + grid.longs // 2) % grid.longs].alias("sub")
        cells.append(F.struct(_cell(_part(F.col("sig"), i, grid), grid).bitwiseOR(F.lit(i << grid.width)).alias("cell"), sub))

    def filed(x: Column) -> Column:
        # A cell is counted once for all of its steps, which as columns of their own would each count it again.
        cell, sub = x["cell"], x["sub"].alias("sub")
        ups = [F.when(cell.bitwiseAND(F.lit(((1 << most) - 1) << s)) < (most << s), F.struct((cell + F.lit(1 << s)).alias("key"), sub))
               for s in range(0, grid.width, most)]
        return F.array(F.struct(cell.bitwiseOR(F.lit(near_sets.HOME)).alias("key"), sub), *ups)

    return F.filter(F.flatten(F.transform(F.array(*cells), filed)), lambda x: x.isNotNull())


def distance(a: Column, b: Column, grid: Grid = BITS) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, grid.longs)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _first(a: Column, b: Column, key: Column, grid: Grid = BITS) -> Column:
    """Whether a key is the upper one's cell in the first part in which two are one step apart at most."""
    cells = []
    for i in range(grid.parts):
        x, y = _part(a, i, grid), _part(b, i, grid)
        upper = _cell(x.bitwiseOR(y), grid).bitwiseOR(F.lit(i << grid.width))
        cells.append(F.when(F.bit_count(x.bitwiseXOR(y)) <= 1, upper))
    return F.coalesce(*cells) == key


SIGNATURE = near_sets.Signature(
    lambda shingles: fingerprint(shingles, LEVELS), lambda: keys(LEVELS), lambda a, b: distance(a, b, LEVELS) <= MAX_BITS,
    lambda a, b, key: _first(a, b, key, LEVELS), SUB_BITS, few_shared=True)


def keep_one(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near-duplicates: one of each class stays.

    That is the row with the smallest doc_id, rows without an id last, and of equal ids
    the one with the smaller text hash; equal rows count once. Rows without words are
    linked with nothing and all stay.
    """
    found = cut(near_sets.classes(docs, SIGNATURE, similar, shingle).where("root IS NOT NULL").select("doc_id", "whole", "root"))
    who = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "whole")
    chosen = found.groupBy("root").agg(F.min(who).alias("first"))
    rows = found.groupBy("doc_id", "whole", "root").agg(F.count("*").alias("n")).join(chosen, "root") \
        .withColumn("stays", (F.col("whole") == F.col("first.whole")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    rows = cut(rows.where("NOT stays OR n > 1").select(F.col("doc_id").alias("__doc"), F.col("whole").alias("__whole"), "stays"))
    here = docs.withColumns({"__id": long_id("doc_id"), "__hash": F.xxhash64(F.col("text").cast("string"))})
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__whole"))
    out = here.join(small(rows.drop("stays")), same, "left_anti").select(*docs.columns)
    again = rows.where("stays").drop("stays")
    if again.isEmpty():
        return out
    once = here.join(small(again), same, "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return out.unionByName(once)
