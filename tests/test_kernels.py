"""Sequence kernels against a plain model, on edge cases and random lists."""

import random

import pytest
from pyspark.sql import functions as F

from mendframe.operators import kernels as K

LISTS = {1: [], 2: [0], 3: [1, 1], 4: [-2, 1, -2, 3], 5: [3, 2, 1], 6: [2, 2, 1, 2], 7: [0, 0, 0], 8: [1, 2, 3, 2, 4], 9: [3, 1, 3, 2]}
_rng = random.Random(5)
LISTS |= {100 + i: [_rng.randint(-4, 4) for _ in range(_rng.randint(1, 25))] for i in range(20)}


@pytest.fixture(scope="module")
def data(spark):
    rel = spark.createDataFrame([(k, p, x) for k, xs in LISTS.items() for p, x in enumerate(xs)], "list_id long, pos long, x long").cache()
    groups = spark.createDataFrame([(k,) for k in LISTS], "list_id long").cache()
    return rel, groups


def table(df, *cols):
    return {r["list_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_aggregates(data):
    rel, groups = data
    assert table(K.has_duplicate(rel, groups), "has_duplicate") == {k: len(set(x)) < len(x) for k, x in LISTS.items()}
    assert table(K.distinct_cardinality(rel, groups), "n_distinct") == {k: len(set(x)) for k, x in LISTS.items()}
    mode = {k: min(x, key=lambda v: (-x.count(v), v)) if x else None for k, x in LISTS.items()}
    assert table(K.mode_bucket(rel, groups), "mode") == mode
    assert table(K.extremes(rel, groups), "lo", "hi") == {k: (min(x), max(x)) if x else (None, None) for k, x in LISTS.items()}


def test_concatenation_of_empty_lists_is_empty_text(spark, data):
    rel = spark.createDataFrame([(1, 0, "x"), (1, 1, ""), (1, 2, "y"), (2, 0, None)], "list_id long, pos long, x string")
    groups = spark.createDataFrame([(1,), (2,), (3,)], "list_id long")
    assert table(K.concatenation(rel, groups), "joined") == {1: "xy", 2: "", 3: ""}


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_running_values_in_blocks(data, block):
    rel, _ = data
    got = {(r["list_id"], r["pos"]): (r["s"], r["m"]) for r in K.running(K.running(rel, "x", "s", "sum", block), "x", "m", "max", block).collect()}
    assert got == {(k, i): (sum(x[: i + 1]), max(x[: i + 1])) for k, x in LISTS.items() for i in range(len(x))}


@pytest.mark.parametrize("k", [-1, 0, 1, 2, 4, 99])
def test_max_window_sum(data, k):
    rel, groups = data
    want = {i: max(sum(x[j : j + k]) for j in range(len(x) - k + 1)) if 0 < k <= len(x) else None for i, x in LISTS.items()}
    assert table(K.max_window_sum(rel, groups.withColumn("k", F.lit(k).cast("long"))), "best") == want


def test_range_sums(spark, data):
    rel, _ = data
    q = [(k, 10 * lo + hi, lo, hi) for k, x in LISTS.items() for lo in range(0, len(x) + 1, 2) for hi in range(lo, len(x) + 1, 3)]
    got = {(r["list_id"], r["q_pos"]): r["total"] for r in K.range_sums(rel, spark.createDataFrame(q, "list_id long, q_pos long, l long, r long")).collect()}
    assert got == {(k, p): sum(LISTS[k][lo:hi]) for k, p, lo, hi in q}


def test_occurrence_kernels(data):
    rel, groups = data
    at = lambda df, c: {(r["list_id"], r["pos"]): r[c] for r in df.collect()}
    assert at(K.frequency_index(rel), "freq") == {(k, i): x.count(v) for k, x in LISTS.items() for i, v in enumerate(x)}
    assert at(K.stable_distinct(rel), "x") == {(k, x.index(v)): v for k, x in LISTS.items() for v in set(x)}
    assert table(K.first_unique(rel, groups), "first_unique") == {k: next((v for v in x if x.count(v) == 1), None) for k, x in LISTS.items()}


@pytest.mark.parametrize("target", [0, 2, -3])
def test_sums_to_a_target(data, target):
    rel, groups = data
    t = groups.withColumn("target", F.lit(target).cast("long"))
    runs = {k: sum(sum(x[i:j]) == target for i in range(len(x)) for j in range(i + 1, len(x) + 1)) for k, x in LISTS.items()}
    assert table(K.subarray_sum_count(rel, t), "n") == runs
    pairs = {k: any(x[i] + x[j] == target for i in range(len(x)) for j in range(i)) for k, x in LISTS.items()}
    assert table(K.pair_sum(rel, t), "found") == pairs


def test_longest_unique_span(data):
    rel, groups = data
    longest = {k: max((j - i for i in range(len(x)) for j in range(i + 1, len(x) + 1) if len(set(x[i:j])) == j - i), default=0) for k, x in LISTS.items()}
    assert table(K.longest_unique_span(rel, groups), "longest") == longest


def test_lookups(spark, data):
    rel, groups = data
    q = spark.createDataFrame([(k, i, v) for k in LISTS for i, v in enumerate([2, 3, -2, 77, 2])], "list_id long, q_pos long, q long")
    at = lambda df, c: {(r["list_id"], r["q_pos"]): r[c] for r in df.collect()}
    qs = [2, 3, -2, 77, 2]
    assert at(K.position_index(rel, q), "index") == {(k, i): x.index(v) if v in x else -1 for k, x in LISTS.items() for i, v in enumerate(qs)}
    assert at(K.count_index(rel, q), "n") == {(k, i): x.count(v) for k, x in LISTS.items() for i, v in enumerate(qs)}
    assert at(K.residue_count_index(rel, q, 3), "n") == {(k, i): sum(y % 3 == v % 3 for y in x) for k, x in LISTS.items() for i, v in enumerate(qs)}
    assert table(K.membership_count(rel, q, groups), "n") == {k: sum(v in qs for v in x) for k, x in LISTS.items()}
    got = {(r["list_id"], r["pos"]): r["x"] for r in K.ordered_intersection(rel, q).collect()}
    assert got == {(k, x.index(v)): v for k, x in LISTS.items() for v in set(x) & set(qs)}


def test_first_match_wins_and_misses_are_null(spark):
    items = spark.createDataFrame([(0, 2, 3), (1, 2, 4)], "pos long, key long, value long")
    keys = spark.createDataFrame([(0, 2), (1, 9), (2, 2)], "k_pos long, key long")
    assert sorted(map(tuple, K.first_match(items, keys).collect())) == [(0, 2, 3), (1, 9, None), (2, 2, 3)]
    assert sorted(map(tuple, K.last_match(items, keys).collect())) == [(0, 2, 4), (1, 9, None), (2, 2, 4)]


def test_nearest_rank_is_zero_based_floor(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 5), ("b", 5), ("b", None)], "arm string, ms long")
    got = {r["arm"]: (r["m"], r["p"]) for r in K.nearest_rank(rows, "arm", "ms", {"m": 0.5, "p": 0.95}).collect()}
    assert got == {"a": (10, 19), "b": (5, 5)}
