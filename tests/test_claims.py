"""Greedy claims in rounds over ranges next to reading the edges one by one."""

import random

import pytest

from ledgerlint.operators import claims

EDGES = "block string, left long, right long"


def one_by_one(edges):
    claimed = {}
    for block, i, j in sorted(edges, key=lambda e: e[1:]):
        if i not in claimed and j not in claimed:
            claimed[j] = i
    return claimed


def found(spark, edges, fold_edges):
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    return {r["vid"]: r["leader"] for r in claims.resolve_claims(df, fold_edges).collect()}


def graphs():
    rng = random.Random(4)
    sparse = sorted({("b", *sorted(rng.sample(range(400), 2))) for _ in range(350)})
    dense = sorted({("b", *sorted(rng.sample(range(60), 2))) for _ in range(700)})
    ladder = [("l", i, i + k) for i in range(300) for k in (1, 2)]
    cliques = [("c", 5 * i + a, 5 * i + b) for i in range(60) for a in range(5) for b in range(a + 1, 5)] + [
        ("c", 5 * i + 4, 5 * i + 5) for i in range(59)]
    two_blocks = [("x", i, i + 2) for i in range(0, 300, 2)] + [("y", i, i + 2) for i in range(1, 200, 2)]
    star = [("s", 0, i) for i in range(1, 200)] + [("s", 200 + i, 600) for i in range(200)]
    return {"sparse": sparse, "dense": dense, "ladder": ladder, "cliques": cliques, "two blocks": two_blocks, "star": star}


@pytest.mark.parametrize("name", sorted(graphs()))
def test_claims_equal_one_by_one(spark, name):
    edges = graphs()[name]
    for fold_edges in (40, 10**6):
        assert found(spark, edges, fold_edges) == one_by_one(edges)


def test_long_chain_takes_few_jobs(spark):
    """10,000 matches in a row, shuffled in the table and folded 300 at a time."""
    order = sorted(random.Random(1).sample(range(10**6), 10_001))
    edges = [("road", a, b) for a, b in zip(order, order[1:])]
    df = spark.createDataFrame(random.Random(2).sample(edges, len(edges)), EDGES).cache()
    df.count()
    spark.sparkContext.setJobGroup("chain", "claims of a chain")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r["vid"]: r["leader"] for r in claims.resolve_claims(df, 300).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert got == one_by_one(edges) and len(got) == 5_000
    assert jobs <= 20, jobs


def test_no_edges(spark):
    assert found(spark, [], 5) == {}


def test_range_fold_needs_only_the_node_before():
    """A chain through a range comes to depend on the last node before it, every other one the other way."""
    fold = claims.RangeFold()
    for v in range(11, 20):
        leads, left = fold.clause(v, [(v - 1, False, False)])
        assert leads is None and left == [(10, v % 2 == 0)]
    assert fold.clause(30, [(11, False, False), (12, False, False)]) == (False, [])  # one of both leads
    assert fold.clause(31, [(11, False, False), (13, False, False), (10, True, False)])[1] == [(10, True)]
    assert fold.clause(32, [(None, False, False)]) == (True, [])
