"""Links between texts whose shingle sets are similar, from signatures filed under keys.

What is common to joins of different signatures: texts with equal sets are one node;
nodes that share a key are compared; what passes is confirmed on the whole sets. In
each key's group all nodes are first held against the one that shares most keys with
others, the hub, which connects most of a family of near copies without listing its
pairs. Only nodes that are in different components after that are held against each
other, each pair under the first key that it shares.

Of these pairs most belong to a large family whose members lie around the bound. So
each node keeps what tells it from its hub: how many shingles it lacks and adds, and
bit maps of them. Two nodes with one hub share at most what neither lacks, plus what
both add, and the bit maps bound both numbers. Pairs that the bound rules out are not
similar, and are not listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiresift.llm.common import long_id, pieces, small
from wiresift.llm.components import components
from wiresift.llm.fingerprint import mixed, shingle_hashes, word_hashes
from wiresift.session import cut

#: Longs of a bit map.
MAP = 4
#: What a key carries where its node is at home.
HOME = 1 << 62
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Signature:
    """How sets are signed, and how signatures, arrays of longs, meet and compare."""

    sign: Callable[[np.ndarray], np.ndarray]
    #: (key, sub) of the column ``sig``: distinct longs below ``HOME``, and bits of the signature that lie elsewhere. Of
    #: two that meet one must be at home, with ``HOME`` added to its key, and of two or three alone with a key some two
    #: must not differ in more than ``sub_bits`` of ``sub``.
    keys: Callable[[], Column]
    #: Whether two signatures are near enough to be confirmed.
    near: Callable[[Column, Column], Column]
    #: Whether a key is the first that two signatures share.
    first: Callable[[Column, Column, Column], Column]
    sub_bits: int = 64
    #: Whether few keys are shared, next to all that are filed: then these are not shuffled again to find them.
    few_shared: bool = False


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, sorted."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), shingle))


def node_of(shingles: np.ndarray) -> int | None:
    """A number for a set, equal for equal sets; none for the empty one."""
    if not len(shingles):
        return None
    places = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mixed(mixed(shingles * _STEP + places).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, text): rows are known by their id and their text's hash."""
    text = F.col("text").cast("string")
    return docs.select(long_id("doc_id").alias("doc_id"), F.xxhash64(text).alias("whole"), text.alias("text"))


def signed(docs: DataFrame, how: Signature, shingle: int) -> DataFrame:
    """(doc_id, whole, n_shingles, node, sig) of every row of ``docs`` (doc_id, text).

    ``whole`` is the text's hash; without words there is no node and no signature.
    """
    sign = how.sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, nodes, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, shingle)
                n.append(len(found))
                nodes.append(node_of(found))
                sigs.append(sign(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "whole", "n_shingles", "node", "sig"])

    return _texts(docs).mapInArrow(run, "doc_id long, whole long, n_shingles long, node long, sig array<long>")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, n_shingles, sig, first_id, whole) from signed rows, with the first document of each set."""
    who = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "whole")
    return (
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.min(who).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("node", "n_shingles", "sig", F.col("first.doc_id").alias("first_id"), F.col("first.whole").alias("whole"))
    )


# Exact comparison.

def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node), from the texts of their first documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    chosen = cut(nodes.join(wanted, "node", "left_semi").select("node", F.col("first_id").alias("id"), F.col("whole").alias("hash")))
    texts = _texts(docs).join(small(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("whole") == F.col("hash")))
    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _map_of(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MAP, bool)
    bits[(hashes & np.uint64(64 * MAP - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


MEASURED = "a long, b long, n_a long, n_b long, same long, lacks array<long>, adds array<long>"


def _measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of what they share, and maps of what a lacks of b and adds to it."""
    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    sets = cut(_sets(wanted, nodes, docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for mine, theirs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = b[at] == a
                lost = np.ones(len(b), bool)
                lost[at[both]] = False
                out.append((len(a), len(b), int(both.sum()), _map_of(b[lost]), _map_of(a[~both])))
            sizes = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:3]]
            maps = [pa.array(c, pa.list_(pa.int64())) for c in list(zip(*out, strict=True))[3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *sizes, *maps], names=[f.split()[0] for f in MEASURED.split(", ")])

    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        .select("a", "b", "set_a", "set_b").mapInArrow(run, MEASURED)
    )


def _alike(same: Column, n_a: Column, n_b: Column, similar: int) -> Column:
    return same * 100 >= (n_a + n_b - same) * similar


def _most_shared() -> Column:
    """The most shingles that two nodes (columns ending in a and b) with one hub can share."""
    def bits(x: Column) -> Column:
        return sum((F.bit_count(x[i]) for i in range(1, MAP)), F.bit_count(x[0]))

    def merged(x: str, y: str, op: str) -> Column:
        a, b = F.col(x), F.col(y)
        return F.array(*(a[i].bitwiseOR(b[i]) if op == "or" else a[i].bitwiseAND(F.bitwise_not(b[i])) for i in range(MAP)))

    lacked = F.greatest(bits(merged("lacks_a", "lacks_b", "or")), "n_lacks_a", "n_lacks_b")
    added = F.least(F.col("n_adds_a") - bits(merged("adds_a", "adds_b", "not")),
                    F.col("n_adds_b") - bits(merged("adds_b", "adds_a", "not")))
    return F.col("n_hub_a") - lacked + added


# Links.

def _shared(filed: DataFrame, sub_bits: int) -> DataFrame:
    """(key, n) of the keys of ``filed`` (key, home, sub) under which some two may meet.

    One plan at all sizes: keys are as many as nodes allow. Where two or three nodes are
    alone with a key, they are told apart before any is fetched: the least, the greatest
    and all together by XOR are all that three have.
    """
    # Homes are counted above the nodes: a row is a few numbers beside its key.
    counted = F.sum(F.when(F.col("home"), (1 << 32) + 1).otherwise(1)).alias("n")
    told = sub_bits < 64
    subs = [F.bit_xor("sub").alias("differ"), F.min("sub").alias("low"), F.max("sub").alias("high")] if told else []
    found = filed.groupBy("key").agg(counted, *subs) \
        .withColumns({"n": F.col("n").bitwiseAND(F.lit((1 << 32) - 1)), "homes": F.shiftright("n", 32)}).where("n > 1 AND homes > 0")
    if told:
        # Of three, the XOR of all without one is that of the other two; of two, it is theirs.
        apart = F.when(F.col("n") == 2, F.bit_count("differ")).when(F.col("n") == 3, F.least(
            F.bit_count(F.col("low").bitwiseXOR(F.col("high"))), F.bit_count(F.col("differ").bitwiseXOR(F.col("low"))),
            F.bit_count(F.col("differ").bitwiseXOR(F.col("high"))))).otherwise(0)
        found = found.where(apart <= sub_bits)
    return found.select("key", "n")


def links(nodes: DataFrame, docs: DataFrame, how: Signature, similar: int, shingle: int) -> DataFrame:
    """Confirmed pairs (a, b) that connect all of ``nodes`` (node, n_shingles, sig, first_id, whole).

    Each pair that shares a key, is near and has the resemblance is given, or joined
    through others that are.
    """
    # A set of fewer is alike with no other: one shingle more or less is too many.
    able = nodes.where(F.col("n_shingles") * (100 - similar) >= similar)
    filed = able.select("node", F.explode(how.keys()).alias("k")).select(
        "node", F.col("k.key").bitwiseAND(F.lit(HOME - 1)).alias("key"), (F.col("k.key") >= HOME).alias("home"), "k.sub")
    shared = _shared(filed, how.sub_bits)
    filed = filed.select("node", "key")
    # The node that meets most others, in all its groups, is the hub of each. A node's rows are as few as its keys.
    weighed = cut(
        filed.join(small(cut(shared)) if how.few_shared else shared.hint("merge"), "key")
        .select("key", "node", F.sum("n").over(Window.partitionBy("node")).alias("weight")))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    tried = weighed.join(hubs, "key").where("node <> hub.node") \
        .groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.first("hub.weight").alias("weight"))

    about = cut(nodes.select("node", "n_shingles", "sig").join(small(cut(weighed.select("node").distinct())), "node", "left_semi"))
    near = how.near(F.col("sig_a"), F.col("sig_b")) \
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar)

    def named(rows: DataFrame, x: str, *extra: str) -> DataFrame:
        return rows.select(*(F.col(c) for c in extra), F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                           F.col("sig").alias(f"sig_{x}"))

    first = cut(tried.join(named(about, "a"), "a").join(named(about, "b"), "b").where(near).select("a", "b", "weight"))
    measured = cut(_measured(first.select("a", "b"), nodes, docs, shingle))
    found = measured.where(_alike(F.col("same"), F.col("n_a"), F.col("n_b"), similar)).select("a", "b")

    # Nodes that share a key and are not connected yet, with what tells them from their heaviest hub.
    roots = cut(components(found))
    apart = cut(weighed.select("key", "node").join(small(roots), "node", "left")
                .select("key", "node", F.coalesce("root", "node").alias("root")))
    split = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    told = measured.select(
        "a", "b", F.col("b").alias("hub"), F.col("n_b").alias("n_hub"), "lacks", "adds",
        (F.col("n_b") - F.col("same")).alias("n_lacks"), (F.col("n_a") - F.col("same")).alias("n_adds"))
    delta = ("hub", "n_hub", "n_lacks", "n_adds", "lacks", "adds")
    own = first.join(told, ["a", "b"]).groupBy(F.col("a").alias("node")).agg(
        F.max_by(F.struct(*delta), F.struct("weight", "b")).alias("told")).select("node", "told.*")
    none = F.array(*[F.lit(0).cast("long")] * MAP)
    # A hub that was held against no other is its own.
    alone = measured.select(F.col("b").alias("node"), F.col("n_b").alias("n_hub")).distinct() \
        .join(own.select("node"), "node", "left_anti") \
        .select("node", F.col("node").alias("hub"), "n_hub", F.lit(0).cast("long").alias("n_lacks"),
                F.lit(0).cast("long").alias("n_adds"), none.alias("lacks"), none.alias("adds"))
    # What is known of a node is put together once, not for each of its keys.
    known = about.join(small(cut(own.unionByName(alone))), "node", "left")
    left = cut(apart.join(small(cut(split.select("key"))), "key", "left_semi").join(known, "node"))

    def side(x: str) -> DataFrame:
        return left.select("key", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("n_shingles").alias(f"n_{x}"),
                           F.col("sig").alias(f"sig_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in delta))

    possible = F.when(F.col("hub_a") == F.col("hub_b"), _alike(_most_shared(), F.col("n_a"), F.col("n_b"), similar)).otherwise(True)
    here = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near & F.coalesce(possible, F.lit(True)) \
        & how.first(F.col("sig_a"), F.col("sig_b"), F.col("key"))
    second = cut(side("a").join(side("b"), "key").where(here).select("a", "b"))
    more = _measured(second, nodes, docs, shingle)
    return found.union(more.where(_alike(F.col("same"), F.col("n_a"), F.col("n_b"), similar)).select("a", "b"))


def classes(docs: DataFrame, how: Signature, similar: int, shingle: int) -> DataFrame:
    """(doc_id, whole, n_shingles, node, component_id, root) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, itself included; null only
    where no doc_id of the component is known; ``root`` tells the components apart. A
    row without words has itself alone, and neither node nor root.
    """
    rows = cut(signed(docs, how, shingle))
    # Each node gives many keys: so it is dealt into as many tasks as these need.
    nodes = cut(nodes_of(rows).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    roots = cut(components(links(nodes, docs, how, similar, shingle)))
    rooted = nodes.join(small(roots), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    of_node = rooted.join(least, "root").select("node", "least", "root")
    return (
        rows.drop("sig").join(of_node, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
        .select("doc_id", "whole", "n_shingles", "node", "component_id", "root")
    )
