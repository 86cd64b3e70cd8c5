"""Connected components of a graph whose nodes are longs, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.session import cut

#: Edges a task of a round is for, about, and the tasks of a round at least.
TASK_EDGES, TASKS = 10_000, 12


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b) can reach: (node, root).

    Alternates the large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to the smallest it knows. Both steps keep
    components together and never hold more edges than they were given. A step is
    an aggregation with map-side combine and a join of the edges with one row per
    node, so a node with very many links is split by adaptive skew handling and is
    never gathered. Each round is written to the shared checkpoint folder, and few
    edges in few tasks, whatever the shuffle's partitions: a round has half a dozen
    stages, and a task leaves files and events behind however little it does. Nodes
    without a link do not appear; null ends are ignored; an empty input gives no
    row.
    """
    links = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    )
    links = cut(links)
    mark = _mark(links)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        tasks = max(TASKS, mark[0] // TASK_EDGES)
        links = cut(_small_star(_large_star(links.coalesce(tasks), tasks), tasks))
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple[int, int, int]:
    """Stars are a fixed point of both steps; equal marks mean equal edges, which are distinct."""
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], row[1], row[2]


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
    )


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).union(least.select("u", F.col("m").alias("v")).coalesce(tasks)) \
        .where("u <> v").distinct().coalesce(tasks)
