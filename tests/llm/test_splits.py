"""Splits: ties are never parted, shares are near, planted conflicts come out."""

import random
from collections import Counter

from mendframe.llm import splits
from mendframe.session import Scratch

RECORD = "id string, family string, template string, stratum string, split_name string"
TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def tied(rows):
    group = {r[0]: r[0] for r in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for col in (1, 2):
        first = {}
        for r in rows:
            if r[col] is not None:
                a, b = find(r[0]), find(first.setdefault(r[col], r[0]))
                group[max(a, b)] = min(a, b)
    return {x: find(x) for x in group}


def example(seed, n=300):
    rng = random.Random(seed)
    pick = lambda p, m: None if rng.random() < 0.1 else f"{p}{rng.randint(0, m)}"
    return [(f"p{i}", "hot" if rng.random() < 0.3 else pick("f", 90), pick("t", 200), rng.choice("xyz"), rng.choice(["train", "train", "test", None])) for i in range(n)]


def test_groups_and_conflicts(spark):
    rows = example(3)
    groups = splits.tied_groups(spark.createDataFrame(rows, RECORD), Scratch(spark, "t")).cache()
    mine, want = {r["id"]: r["group_id"] for r in groups.collect()}, tied(rows)
    assert Counter(frozenset(k for k in mine if mine[k] == g) for g in set(mine.values())) == Counter(frozenset(k for k in want if want[k] == g) for g in set(want.values()))
    hints = {}
    for r in rows:
        hints.setdefault(want[r[0]], set()).add(r[4])
    bad = {g for g, h in hints.items() if len(h - {None}) > 1}
    least = {g: min((r[1] for r in rows if want[r[0]] == g and r[1]), default=None) for g in bad}
    assert {tuple(r) for r in splits.conflicts(groups).collect()} == {(r[0], least[want[r[0]]]) for r in rows if want[r[0]] in bad}
    out = splits.assign_splits(groups, spark.createDataFrame(TARGETS, "split_name string, target_share double")).collect()
    by = {}
    for r in out:
        by.setdefault(r["group_id"], set()).add(r["assigned_split"])
    assert len(out) == len(rows) and all(len(s) == 1 and s <= {"train", "validation", "test"} for s in by.values())


def test_shares_and_strata_come_near(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", f"f{i // 4}", None, rng.choice("xxxy"), None) for i in range(2000)]
    groups = splits.tied_groups(spark.createDataFrame(rows, RECORD), Scratch(spark, "t"))
    out = splits.assign_splits(groups, spark.createDataFrame(TARGETS, "split_name string, target_share double")).collect()
    n = Counter(r["assigned_split"] for r in out)
    assert all(abs(n[s] / len(rows) - p) < 0.01 for s, p in TARGETS)
    for stratum in "xy":
        m = Counter(r["assigned_split"] for r in out if r["stratum"] == stratum)
        assert all(abs(m[s] / sum(m.values()) - p) < 0.03 for s, p in TARGETS)


def test_compared_forms_and_repeats(spark):
    problem = "id string, family_id string, template_id string, split_hint string, input_generator struct<kind:string,version:int>, split_name string, hint string"
    rows = [("a", " Two_Sum ", "T1", "TRAIN ", ("k", 1), "zz", "q"), ("b", "two-sum", " t2", "eval", ("k", 1), None, None), ("b", "two-sum", " t2", "eval", ("k", 1), None, None), ("c", " ", "", "eval", None, None, None), ("d", None, "T2 ", None, None, None, None), (None, "two-sum", None, "eval", None, None, None)]
    hints = spark.createDataFrame([("problem", "train", "train"), ("problem", "eval", "test"), ("case", "eval", "train")], "record_kind string, split_hint string, split_name string")
    recs = splits.problem_records(spark.createDataFrame(rows, problem), hints)
    groups = splits.tied_groups(recs, Scratch(spark, "t"))
    assert {tuple(r) for r in splits.conflicts(groups).collect()} == {(k, "two-sum") for k in "abd"}


def test_empty_tables(spark):
    groups = splits.tied_groups(spark.createDataFrame([], RECORD), Scratch(spark, "t"))
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    assert groups.count() == 0 and splits.conflicts(groups).count() == 0 and splits.assign_splits(groups, targets).count() == 0
