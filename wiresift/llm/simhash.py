"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into short segments, and the count of set bits in
each is its place in an integer grid. One flipped bit moves one coordinate by one,
so the Manhattan distance of two places never exceeds the Hamming distance of the
fingerprints. The grid's coordinates are dealt into parts. Fingerprints within the
bound agree in some part up to one step, so a part's cell is a join key: each
fingerprint stays in its own cell, and visits the cells one step up. Candidates
are then verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm.common import long_id, pieces, small
from wiresift.llm.components import components
from wiresift.session import cut

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENT_BITS = 2
# Above this many fingerprints in a cell, neighbours meet at shared bit patterns
# and not in pairs. A fingerprint has 1 + 64 + 64 * 63 / 2 patterns within two
# bits, so this is where patterns become fewer than pairs.
CROWDED = 2081


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        spans = [b" ".join(words)]
    else:
        spans = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in spans), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        block = hashes[at:at + 16384].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: ``fp`` holds the fingerprint's 64 bits as a long.

    A null or empty text has fingerprint 0. Rows with equal texts have equal
    fingerprints; repeated rows give repeated rows. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return docs.select(long_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def embed(bits: Column, segment_bits: int = SEGMENT_BITS) -> Column:
    """Counts of set bits per segment, each in a field as wide as its segment.

    ``bits`` holds fewer than 63 bits, so that no sum reaches the sign.
    """
    if segment_bits not in (2, 4, 8):
        raise ValueError("segments have 2, 4 or 8 bits")
    counts, width = bits, 1
    while width < segment_bits:
        mask = F.lit(sum(((1 << width) - 1) << at for at in range(0, 62, 2 * width)))
        counts = counts.bitwiseAND(mask) + F.shiftrightunsigned(counts, width).bitwiseAND(mask)
        width *= 2
    return counts


def _parts(max_bits: int, segment_bits: int) -> list[tuple[int, int]]:
    """(first segment, segments) of so many parts that some part holds at most one step."""
    segments, n = 64 // segment_bits, max(2, max_bits // 2 + 1)
    edges = [i * segments // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cells(nodes: DataFrame, max_bits: int, segment_bits: int) -> DataFrame:
    """(part, cell, fp, step) for each fingerprint at home (0) and one step up (1)."""
    rows, field = [], (1 << segment_bits) - 1
    for part, (first, segments) in enumerate(_parts(max_bits, segment_bits)):
        bits = F.shiftrightunsigned("fp", first * segment_bits).bitwiseAND(
            F.lit((1 << segments * segment_bits) - 1))
        cell = embed(bits, segment_bits)

        def at(place: Column, step: int, part: int = part) -> Column:
            return F.struct(F.lit(part).alias("part"), place.alias("cell"), F.lit(step).alias("step"))

        rows.append(at(cell, 0))
        if max_bits:
            for s in range(0, segments * segment_bits, segment_bits):
                room = F.shiftrightunsigned(cell, s).bitwiseAND(F.lit(field)) < segment_bits
                rows.append(F.when(room, at(cell + F.lit(1 << s), 1)))
    return (
        nodes.select("fp", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c"))
        .select("c.part", "c.cell", "fp", "c.step")
    )


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS,
          crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all within ``max_bits``.

    Cells with up to ``crowded`` fingerprints give their verified pairs. In fuller
    cells, which only large groups of near copies make, every pattern within one
    bit of a fingerprint is a meeting point, and all who are at most ``max_bits``
    from each other through it are linked to one of them: the links connect the
    same fingerprints without listing the pairs.
    """
    cells = _cells(nodes, max_bits, segment_bits)
    full = cut(
        cells.groupBy("part", "cell").agg(
            F.count("*").alias("n"), F.sum(1 - F.col("step")).alias("at_home"))
        .where((F.col("n") > crowded) & (F.col("at_home") > 0)).select("part", "cell"))
    crowd = None
    if not full.isEmpty():
        crowd = cells.join(full, ["part", "cell"], "left_semi").select("fp").distinct()
        cells = cells.join(full, ["part", "cell"], "left_anti")
    home = cells.where("step = 0").select("part", "cell", F.col("fp").alias("b"))
    pairs = (
        cells.withColumnRenamed("fp", "a").join(home, ["part", "cell"])
        .where("(step = 1 OR a < b)")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    return pairs if crowd is None else pairs.union(_meeting_points(cut(crowd), max_bits))


def _meeting_points(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links through bit patterns near crowded fingerprints.

    A pattern one bit from x and ``max_bits`` - 1 from y proves them linked. All
    fingerprints within half the bound of a pattern are linked to the smallest of
    these, and those further away to the same one.
    """
    if max_bits > 3:
        raise ValueError("crowded cells are resolved for up to 3 bits")
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    one = F.array(*flips)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(
        F.slice(one, i + 2, F.lit(63) - i), lambda y: F.element_at(one, i + 1).bitwiseXOR(y))))
    rings = [F.array(F.lit(0).cast("long")), one, two]

    def shell(r: int) -> Column:
        return F.transform(rings[r], lambda x: F.struct(x.alias("flip"), F.lit(r).alias("r")))

    shells = F.concat(*(shell(r) for r in range(far + 1)))
    met = (
        crowd.select("fp", F.explode(shells).alias("s"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("s.flip")).alias("pattern"), F.col("s.r").alias("r"))
    )
    hubs = met.groupBy("pattern").agg(
        F.min(F.when(F.col("r") <= near, F.col("fp"))).alias("hub"), F.count("*").alias("n")) \
        .where("hub IS NOT NULL AND n > 1")
    return met.join(hubs, "pattern").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def classes(found: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS,
            crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id, root) from (doc_id, fp); ``root`` is the class's smallest fingerprint.

    ``component_id`` is the smallest doc_id that links of at most ``max_bits``
    differing bits reach, itself included; null only where no doc_id of the class
    is known. Equal fingerprints are one node, so copies are never paired.
    """
    found = cut(found)
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = cut(nodes)
    roots = components(links(nodes, max_bits, segment_bits, crowded))
    grown = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grown.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = grown.join(least, "root").select("fp", "component_id", "root")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of ``docs`` (doc_id, text)."""
    return classes(fingerprints(docs, shingle), max_bits)


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near-duplicates: one of each class stays.

    That is the row with the smallest doc_id; of a class without any id, the one
    with the smallest fingerprint. Of rows with equal id and fingerprint one stays.
    What goes is looked up by id. Only ids that are null or stand in several rows
    are looked up with their fingerprint.
    """
    found = cut(near_duplicates(docs, max_bits, shingle))
    ids = found.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    single = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    odd = cut(ids.where(~single).select("doc_id"))
    gone = cut(ids.where(single & (F.col("doc_id") != F.col("component_id"))).select("doc_id").union(odd))
    names = docs.columns
    here = docs.withColumn("__id", long_id("doc_id"))
    out = here.join(small(gone.withColumnRenamed("doc_id", "__gone")),
                    F.col("__id").eqNullSafe(F.col("__gone")), "left_anti").select(*names)
    if odd.isEmpty():
        return out
    rows = here.join(small(odd.withColumnRenamed("doc_id", "__odd")),
                     F.col("__id").eqNullSafe(F.col("__odd")), "left_semi")
    known = found.where("component_id = doc_id")
    unknown = found.where("component_id IS NULL").groupBy("root").agg(F.min("fp").alias("__fp")) \
        .select(F.lit(None).cast("long").alias("__key"), "__fp")
    # An id may stand in a class more than once, with linked fingerprints: the smallest stays.
    keys = known.groupBy("doc_id", "root").agg(F.min("fp").alias("__fp")) \
        .select(F.col("doc_id").alias("__key"), "__fp").union(unknown)
    mine = _with_fingerprint(rows, shingle)
    kept = mine.join(keys, [
        mine["__id"].eqNullSafe(F.col("__key")), mine["__print"] == F.col("__fp")], "left_semi")
    return out.unionByName(kept.dropDuplicates(["__id", "__print"]).select(*names))


def _with_fingerprint(rows: DataFrame, shingle: int) -> DataFrame:
    at = rows.columns.index("text")
    names = [*rows.columns, "__print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__print", T.LongType())]))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
