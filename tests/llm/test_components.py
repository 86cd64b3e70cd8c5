"""Components: the smallest node reached, and rounds of few edges in few tasks."""

import random

from tests.llm.test_wide_simhash import components as slow_components
from wiresift.llm import components


def test_few_edges_take_few_tasks(spark):
    """As where partitions are not coalesced: a round used to have as many tasks a stage as the shuffle has partitions."""
    rng = random.Random(3)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame(edges, "u long, v long").selectExpr("greatest(u, v) u", "least(u, v) v").where("u <> v")
        stars = components._small_star(components._large_star(links.coalesce(3), 3), 3)
        assert stars.rdd.getNumPartitions() <= 3
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = slow_components(900, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
