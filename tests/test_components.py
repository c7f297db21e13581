"""Components and skew-proof joins against plain models."""

import random

from pyspark.sql import functions as F

from mendframe.operators import components
from mendframe.session import Scratch


def plain(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def labels(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in components.min_label_components(df, "a", "b", Scratch(spark, "t")).collect()}


def test_chains_stars_and_random_graphs(spark):
    chain = [(i, i + 1) for i in range(40)]
    random.Random(2).shuffle(chain)
    star = [(999, i) for i in range(30)]
    rng = random.Random(4)
    scattered = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)]
    for edges in (chain, star, scattered, [(5, 5)], chain + chain):
        assert labels(spark, edges) == plain(edges)


def test_nulls_and_no_edges(spark):
    assert labels(spark, []) == {}
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a long, b long")
    got = components.min_label_components(df, "a", "b", Scratch(spark, "t"))
    assert {tuple(r) for r in got.collect()} == {(3, 3), (4, 3)}


def test_hot_keys_join_as_any_other(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 997).cast("long").alias("k"), "id")
    small = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 13")
    for how in ("inner", "left"):
        want = {tuple(r) for r in big.join(small, "k", how).select("id", "k", "v").collect()}
        assert {tuple(r) for r in components.join_with_hot_keys(big, small, "k", how).select("id", "k", "v").collect()} == want


def test_balanced_pairs_are_all_pairs(spark):
    rng = random.Random(8)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), f"l{i}") for i in range(60)]
    right = [(rng.choice([1, 1, 3, 4, None]), f"r{i}") for i in range(40)]
    a, b = spark.createDataFrame(left, "k long, x string"), spark.createDataFrame(right, "k long, y string")
    want = {(k, x, y) for k, x in left for q, y in right if k is not None and k == q}
    for chunk in (1, 3, 2048):
        got = [tuple(r) for r in components.balanced_pairs(a, b, "k", "x", "y", chunk).select("k", "x", "y").collect()]
        assert set(got) == want and len(got) == len(want)
