"""Corpus operators: splits, weights, audits, hashes; planted leaks and ties."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from mendframe.operators import corpus as C
from mendframe.plans import corpus_queries, registry

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_set_hash_ignores_row_order_and_nulls(spark):
    rows = [("a", f"k{i:03d}") for i in range(50)] + [("a", None), (None, "x"), ("b", "é")]
    random.Random(1).shuffle(rows)
    got = {r["g"]: (r["n"], r["digest"]) for r in C.set_hash(spark.createDataFrame(rows, "g string, v string"), "g", "v").collect()}
    keys = "\n".join(f"k{i:03d}" for i in range(50))
    assert got == {"a": (50, hashlib.sha256(keys.encode()).hexdigest()), "b": (1, hashlib.sha256("é".encode()).hexdigest())}
    joined = C.set_hash(spark.createDataFrame(rows, "g string, v string"), "g", "v", "", "sha1").where("g = 'a'").first()["digest"]
    assert joined == hashlib.sha1(keys.replace("\n", "").encode()).hexdigest()


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 9, "z"), (None, 4, "n")], "k long, o long, v string")
    assert {tuple(r) for r in C.keep_last(df, ["k"], "o").collect()} == {(1, 3, None), (2, 9, "z"), (None, 4, "n")}
    assert {tuple(r) for r in C.keep_first(df, ["k"], "o").collect()} == {(1, 1, "a"), (2, 9, "z"), (None, 4, "n")}


@pytest.mark.parametrize("n, fraction, want", [(1, 0.9, 0), (2, 0.1, 1), (10, 0.25, 2), (10, 0.35, 4), (6, 0.25, 2), (300, 0.35, 105)])
def test_stratified_split_rounds_half_to_even(spark, n, fraction, want):
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("k"))
    out = C.stratified_split(df, "s", "k", fraction, "7:").collect()
    order = sorted(range(n), key=lambda k: (hashlib.sha256(f"7:{k}".encode()).hexdigest(), k))
    assert {r["k"] for r in out if r["split"] == "eval"} == set(order[:want]) and len(out) == n


def test_group_split_never_parts_a_case(spark):
    rows = [(f"c{s}{f}{i}", f"s{s}", f"f{f}", 10 * i + j) for s in range(2) for f in range(2) for i in range(10) for j in range(2)]
    out = C.group_split(spark.createDataFrame(rows, "case_id string, src string, fam string, ordinal long"), "src", "fam", "case_id", 0.2, 7).collect()
    by = {}
    for r in out:
        by.setdefault(r["case_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and sum(v == {"eval"} for v in by.values()) == 8


@pytest.mark.parametrize("current, legacy, target", [(945, 102, 630), (493, 102, 329), (60, 10, 40), (60, 0, 0), (0, 10, 10)])
def test_replay_sizes(current, legacy, target):
    want, whole, more = C.replay_copies(current, legacy, 0.4)
    assert want == target and (not legacy or whole * legacy + more == target)


def test_replay_weighting(spark):
    cur, old = spark.range(60).selectExpr("cast(id as string) k"), spark.range(100, 110).selectExpr("cast(id as string) k")
    out = C.replay_weighting(cur, old, "k", 0.4).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in out} == {"current": 60, "legacy": 40}
    thinned = C.replay_weighting(spark.range(3).selectExpr("cast(id as string) k"), old, "k", 0.4).where("part = 'legacy'")
    assert thinned.count() == 2  # fewer than there are


def test_focus_weighting(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, f string")
    assert sorted(tuple(r) for r in C.focus_weighting(df, F.col("f") == "x", 3).select("k", "focus_copy").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert C.focus_weighting(df, F.col("f") == "x", 1).count() == 2


def test_leakage_audit_finds_planted_keys(spark):
    keys = ["id", "template_id", "ast"]
    train = spark.createDataFrame([("a", "t1", "h1"), ("b", "t2", None)], "id string, template_id string, ast string")
    evals = spark.createDataFrame([("clean", "z", "e1", None), ("leaky", "z", "t2", "h1")], "eval_set string, id string, template_id string, ast string")
    got = {(r["eval_set"], r["key"]): r["n"] for r in C.leakage_audit(train, evals, keys).collect()}
    assert got == {(s, k): int(s == "leaky" and k != "id") for s in ("clean", "leaky") for k in keys}


def _greedy(rows, cap, limit):
    used, seen, out = {}, set(), []
    for c, k, o in sorted(rows, key=lambda r: (r[2], r[1])):
        if k in seen or used.get(c, 0) >= cap:
            continue
        seen.add(k)
        used[c] = used.get(c, 0) + 1
        out.append((c, k))
        if limit and len(out) >= limit:
            break
    return set(out)


def test_greedy_caps_with_keys_of_two_categories(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), f"k{rng.randint(0, 25)}", i) for i in range(90)]
    for cap, limit in ((3, 0), (5, 7), (100, 0), (0, 0)):
        got = C.capped_by_category(spark.createDataFrame(rows, "c string, k string, o long"), "c", "k", "o", cap, limit)
        assert {(r["c"], r["k"]) for r in got.collect()} == _greedy(rows, cap, limit)


def test_set_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    r = C.overlap(a, b, "k").first()
    assert (r["n"], r["examples"]) == (1, [2])
    assert C.same_multiset(a, a, "k").first()["equal"] and not C.same_multiset(a, b, "k").first()["equal"]
    assert C.overlap(a.limit(0), b, "k").first()["n"] == 0
    assert [r[0] for r in C.pending(a, [b], "k").collect()].count(2) == 0 and C.pending(a, [b], "k").count() == 2


def test_shuffle_is_pythons(spark):
    df = spark.createDataFrame([("x", i) for i in range(9)], "g string, k long")
    want = list(range(9))
    random.Random("7:x").shuffle(want)
    assert [r["k"] for r in C.twister_shuffle(df, "g", "k", 7).orderBy("shuffled").collect()] == want


def test_shards_cover_everything(spark):
    parts = [C.shard(spark.range(20), "id", i, 3).count() for i in range(3)]
    assert parts == [7, 7, 6]
    with pytest.raises(ValueError):
        C.shard(spark.range(3), "id", 3, 3)


@with_tables
def test_carried_over_rows_are_a_query(spark):
    old, new = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (2,), (None,)], "k long")
    kept, dropped = C.carried_over(old, new, "k")
    assert {r["k"] for r in kept.collect()} == {1, None} and dropped.first()["dropped"] == 2
    rows, gone = registry.QUERIES["JN9_kept"](spark, FOLDER), registry.QUERIES["JN9"](spark, FOLDER)
    assert rows.count() + gone.first()["dropped"] == corpus_queries.read(spark, FOLDER, "customer").count() and "JN9_kept" in registry.ORACLES


@with_tables
def test_hash_order_covers_every_case(spark):
    got = [tuple(r) for r in registry.QUERIES["SRT2_all"](spark, FOLDER).collect()]
    ids = {r["case_id"] for r in corpus_queries.read(spark, FOLDER, "cases").select("case_id").collect() if r["case_id"] is not None}
    want = sorted(((k, hashlib.sha256(f"7:{k}".encode()).hexdigest()) for k in ids), key=lambda r: r[1])
    assert [r for r in got if r[0] is not None] == want and len(want) > 50 and "SRT2_all" in registry.ORACLES


@with_tables
def test_manifest_has_its_categories(spark):
    df = spark.createDataFrame([("train", "b", "y"), ("train", "a", "x"), ("train", "c", "x"), ("train", "d", None), ("test", "e", None)], "split string, k string, c string")
    got = {r["split"]: (r["n"], r["categories"]) for r in C.split_manifest(df, "split", "k", "c").collect()}
    assert got == {"train": (4, {"x": 2, "y": 1}), "test": (1, {})}
    rows = registry.QUERIES["COR15_manifest"](spark, FOLDER).collect()
    assert rows and all(0 < sum(int(x.rpartition("=")[2]) for x in r["categories"].split(",")) <= r["n"] for r in rows) and "COR15_manifest" in registry.ORACLES
