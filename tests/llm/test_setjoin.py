"""Near-duplicates and cross-split overlaps against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendframe.llm import bittrie, leakage, near_dup, setjoin, shingles as S
from mendframe.session import Scratch

WORD = re.compile(r"[A-Za-z0-9_]+")


def runs(text, k=3):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def like(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed, families=20, noise=20):
    """Families of edited copies, exact copies, boilerplate all share, short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") + str(rng.randint(0, 400))
    boiler = " ".join(f"common{i}" for i in range(12))
    texts = []
    for _ in range(families):
        base = boiler.split() + [word() for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
            texts.append(" ".join(t) if rng.random() < 0.5 else "(" + ";\n".join(t) + ")")
    texts += [boiler + " " + " ".join(word() for _ in range(25)) for _ in range(noise)]
    texts += [texts[0], texts[0], boiler, boiler, "a b", "a b", "", "", None, "é a ü b ß", "x" * 70_000 + " y z w"]
    return texts


def test_words_are_the_longest_ascii_runs():
    texts = ["a_1 b-céd", "", None, "x", "é", "q q q q"]
    offs, raw = S.buffers(pa.array(texts))
    row, h = S.word_hashes(offs, raw)
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert [i for i, _ in want] == row.tolist()
    by = {}
    for (_, w), x in zip(want, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_slices_of_arrays_and_slices_by_bytes():
    arr = pa.array(["skip me now", "a b c d", None, "a b c", "tail x y"]).slice(1, 3)
    offs, raw = S.buffers(arr)
    d = S.distinct(S.shingles(offs, raw, np.zeros(3, np.uint64)))
    assert np.bincount(d.row, minlength=3).tolist() == [2, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 700_000] * 5 + ["y" * 3_000_000])], ["text"])
    assert [r.num_rows for r, _, _ in S.slices(iter([batch]), "text")] == [1, 1, 1, 1, 1, 1]


def test_equal_sets_have_equal_ids():
    offs, raw = S.buffers(pa.array(["a b c d", "(a);\nb, c d", "b c d a b c", "a b c", None, "z"]))
    ids, n = S.set_ids(S.distinct(S.shingles(offs, raw, np.zeros(6, np.uint64))))
    assert ids[0] == ids[1] != ids[2] and n.tolist() == [2, 2, 4, 1, 0, 0] and ids[4] == ids[5]


def test_trie_finds_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, bittrie.WORDS), dtype=np.uint64)
    rows = np.concatenate([base[rng.integers(0, 6, 150)] for _ in range(2)])
    for r in rows:
        for b in rng.integers(0, 64 * bittrie.WORDS, rng.integers(0, 60)):
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows = rows[np.lexsort(rows.T[::-1])]
    size = rng.integers(60, 140, len(rows))
    lo, hi, mid = np.array([0]), np.array([len(rows)]), np.array([130])
    off = lambda i, j: int(np.bitwise_count(rows[i] ^ rows[j]).sum())
    ok = lambda i, j: off(i, j) <= 0.25 * (size[i] + size[j]) + 1e-9 and min(size[i], size[j]) >= 0.6 * max(size[i], size[j]) - 1e-9
    for leaf in (1, 64):
        bittrie.LEAF, old = leaf, bittrie.LEAF
        try:
            i, j = bittrie.join(rows, size, [(lo, hi, lo, hi)], 0.6)
            assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if ok(a, b)}
            i, j = bittrie.join(rows, size, [(lo, mid, mid, hi)], 0.6)
            assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(130) for b in range(130, len(rows)) if ok(a, b)}
        finally:
            bittrie.LEAF = old


def records(spark, texts, kinds=("case", "problem")):
    rows = [(kinds[i % 2], f"{i:04d}", t, i % 2) for i, t in enumerate(texts)]
    rows += rows[:3]  # delivered twice
    return rows, spark.createDataFrame(rows, "record_kind string, key string, text string, part int").repartition(3)


@pytest.mark.parametrize("rule", [setjoin.Rule(), setjoin.Rule(chunk=4, hot_rows=3), setjoin.Rule(chunk=2, hot_rows=10**9)])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, rule, seed):
    rows, df = records(spark, corpus(seed))
    group = {(k, key): (k, key) for k, key, _, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    degree = {x: set() for x in group}
    for k, a, s, _ in rows:
        for q, b, t, _ in rows:
            if k == q and a < b and like(s, t) >= rule.threshold:
                if runs(s) != runs(t):
                    degree[k, a].add(frozenset(runs(t)))
                    degree[k, b].add(frozenset(runs(s)))
                x, y = find((k, a)), find((k, b))
                group[max(x, y)] = min(x, y)
    want = {(k, a, b) for k, a in group for q, b in group if k == q and a < b and find((k, a)) == find((q, b))}
    members, links = near_dup.near_duplicate_classes(df, rule)
    members = members.cache()
    assert {tuple(r) for r in near_dup.group_pairs(members).collect()} == want and len(want) >= 20
    assert {(r["record_kind"], r["key"]): r["links"] for r in members.collect()} == {x: len(v) for x, v in degree.items()}


@pytest.mark.parametrize("rule", [leakage.WINNOW, setjoin.Rule(window=4, across=True, chunk=3, hot_rows=4)])
def test_overlaps_are_those_of_all_pairs(spark, rule):
    rng = random.Random(7)
    texts = corpus(5) + corpus(5)[:20]
    rows = [("case", f"{i:04d}", t, 0, rng.choice([1, 1, 2]), rng.choice([None, None, "h1", "h2", f"u{i}"])) for i, t in enumerate(texts)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "record_kind string, key string, text string, part int, side int, ast string")
    got = {(r["train_key"], r["eval_key"]): r for r in leakage.cross_split_overlaps(df, rule).collect()}
    want = {}
    for _, a, s, _, p, h in rows:
        for _, b, t, _, q, g in rows:
            if p == 1 and q == 2 and a != b and (like(s, t) >= 0.6 or h and h == g):
                want[a, b] = (like(s, t) if like(s, t) >= 0.6 else None, bool(h and h == g))
    assert set(got) == set(want) and len(want) >= 20
    for k, (sim, same) in want.items():
        assert got[k]["same_hash"] == same and (got[k]["similarity"] is None) == (sim is None) and (sim is None or abs(got[k]["similarity"] - sim) < 1e-12)
        assert sim is None or 0.2 < got[k]["coverage"] <= 1


def test_overlaps_whose_rare_shingles_lie_next_to_an_edit(spark):
    """The shared rare shingles lie in a run of three beside rarer edited ones, so every window over them has its least elsewhere."""
    rows = []
    for i in range(40):
        for side in (1, 2):
            words = [f"own{i}w{j}" for j in range(5)] + [f"edit{i}s{side}"] + [f"common{j}" for j in range(8)]
            rows.append(("case", f"{i:03d}s{side}", " ".join(words), 0, side, None))
    df = spark.createDataFrame(rows, "record_kind string, key string, text string, part int, side int, ast string")
    got = {(r["train_key"], r["eval_key"]) for r in leakage.cross_split_overlaps(df).collect()}
    want = {(a, b) for _, a, s, _, p, _ in rows for _, b, t, _, q, _ in rows if p == 1 and q == 2 and like(s, t) >= 0.6}
    assert got == want and len(want) == 40


def test_overlaps_of_shared_headers_and_frequent_edits(spark):
    """A header that all records share, then own words of which every sixth differs between the two: no run of four own shingles is shared."""
    rows = []
    for i in range(21):
        for side in (1, 2):
            body = [f"own{i}w{j}" if j % 6 else f"edit{i}s{side}j{j}" for j in range(42)]
            rows.append(("case", f"{i:03d}s{side}", " ".join([f"head{j}" for j in range(60)] + body), 0, side, None))
    df = spark.createDataFrame(rows, "record_kind string, key string, text string, part int, side int, ast string")
    got = {(r["train_key"], r["eval_key"]): r["by_chain"] for r in leakage.cross_split_overlaps(df).collect()}
    want = {(a, b) for _, a, s, _, p, _ in rows for _, b, t, _, q, _ in rows if p == 1 and q == 2 and like(s, t) >= 0.6}
    assert set(got) == want and len(want) >= 21 and all(got.values())


def test_chains_decide_where_text_keeps_its_order_and_whole_sets_elsewhere():
    a = np.arange(100, 140, dtype=np.uint64)
    moved = np.concatenate([a[30:], a[:30]])
    every = np.arange(40)
    got = leakage.aligned(a, every, 40, a[:36], every[:36], 36, 0.6)
    assert got[0] == 0.9 and got[1] == 36 and got[2:] == (0.9, 1.0, True)
    back = leakage.aligned(a, every, 40, np.concatenate([a[20:], a[:20]]), every, 40, 0.6)
    assert back[0] == 1.0 and back[2] == 0.5 and not back[4]
    assert leakage.aligned(a, every, 40, a[:20], every[:20], 20, 0.6) is None and leakage.aligned(a, every, 40, moved, every, 40, 0.6)[4]


def test_sketches_fold_and_tell_long_sets_apart():
    """Unlike sets of a thousand members stay over budget, like ones under it, also where their sketches differ in length."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (120, 200, 330, 340, 360, 690, 1000, 1365)]
    sets += [np.concatenate([x[: int(0.8 * len(x))], rng.integers(0, 2**63, int(0.1 * len(x)), dtype=np.uint64)]) for x in sets]
    size = np.array([len(x) for x in sets])
    s = S.distinct(S.Shingles(len(sets), np.repeat(np.arange(len(sets)), size), np.concatenate(sets)))
    flat, width = bittrie.sketches(s, size)
    assert set(width.tolist()) == {4, 8, 16, 32}
    one = np.zeros(len(sets), np.int64)
    i, j = bittrie.join_levels(bittrie.levels(size), (flat, np.cumsum(width) - width), size, one, one, 1, [(0, 0)], 0.6)
    got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    like_ = {(k, k + 8) for k in range(8)}
    assert like_ <= got and len(got) <= len(like_) + 2


def test_overloaded_counters_lose_nothing_and_add_little(spark, tmp_path):
    """Long texts and counters that are all far too full: links are those of all pairs, candidates stay near them."""
    rng = random.Random(12)
    texts = []
    for f in range(30):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(1000)]
        for _ in range(2):
            texts.append(" ".join(w if rng.random() > 0.03 else f"e{rng.randint(0, 10**6)}" for w in base))
    rule = setjoin.Rule()
    df = spark.createDataFrame([("case", f"{i:03d}", t, 0, 3) for i, t in enumerate(texts)], "record_kind string, key string, text string, part int, side int")
    scratch = Scratch(spark, "overloaded")
    rows = setjoin.records(df, rule, scratch)
    counts = np.full(4, 10**6)
    pairs = setjoin.candidate_pairs(rows, rule, scratch, counts)
    links = setjoin.exact_links(rows, pairs, rule, scratch).count()
    want = sum(like(a, b) >= 0.6 for i, a in enumerate(texts) for b in texts[i + 1 :])
    assert links == want == 30 and pairs.count() <= 45


def test_empty_tables(spark):
    df = spark.createDataFrame([], "record_kind string, key string, text string, part int, side int, ast string, cid long")
    members, links = near_dup.near_duplicate_classes(df)
    assert members.count() == 0 and links.count() == 0 and leakage.cross_split_overlaps(df).count() == 0


def test_winnowing_keeps_a_seed_of_every_common_run():
    rng = np.random.default_rng(9)
    for _ in range(50):
        shared = rng.integers(0, 2**63, 5, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(2))
        s = S.Shingles(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
        chosen = setjoin.winnow(s, s.hash, 5)
        assert set(s.hash[chosen & (s.row == 0)].tolist()) & set(s.hash[chosen & (s.row == 1)].tolist())
        assert chosen[: len(a)].any() and chosen[len(a) :].any()


def test_chains_rise_in_both_texts():
    assert leakage.chain([0, 1, 2, 3], [5, 0, 1, 9]) == [(1, 0), (2, 1), (3, 9)] and leakage.chain([], []) == []
    a = np.arange(20, dtype=np.int64)
    b = np.concatenate([a[:8], [99, 98], a[8:]])
    n, ca, cb = leakage.coverage(a, np.array([2, 10]), b, np.array([2, 12]))
    assert (n, ca.mean()) == (2, 1.0) and abs(cb.mean() - 20 / 22) < 1e-9


def test_report_has_a_row_for_every_source(spark, tmp_path):
    cases = spark.createDataFrame([("a", "x y z w v", "train ", "s1"), ("b", "x y z w v", "EVAL", "s1"), ("c", "q r s t u", "eval", None), ("d", None, None, "s1")], "case_id string, broken string, split_hint string, source string")
    problems = spark.createDataFrame([], "id string, reference_source string, split_hint string, family_id string, normalized_ast_sha256 string")
    hints = spark.createDataFrame([("case", "train", "train"), ("case", "eval", "test")], "record_kind string, split_hint string, split_name string")
    for n, t in (("cases", cases), ("problems", problems), ("hint_splits", hints)):
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    assert [tuple(r) for r in leakage.p5_found(spark, str(tmp_path)).collect()] == [("case", "a", "b")]
    got = {(r["source"]): (r["records"], r["overlapping"], r["mean_coverage"]) for r in leakage.p5_report(spark, str(tmp_path)).collect()}
    assert got == {"s1": (1, 1, 1.0), None: (1, 0, None)}
