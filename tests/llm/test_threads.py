"""Conversations rebuilt from rows, against the definition and by hand."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from mendframe.llm import threads

STEPS = "array<struct<attempt:long,context:string>>"
MESSAGE = "message_id long, traj_id string, attempt long, role string, content string, created_at timestamp"


def run(spark, messages, trajectories=()):
    rows = [(m[0], m[1], m[2], m[3], m[4], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=m[5] if len(m) > 5 else m[0]) if len(m) < 6 or m[5] is not None else None) for m in messages]
    t = spark.createDataFrame([(i, s) for i, s in trajectories], f"id string, steps {STEPS}")
    out = threads.conversations(spark.createDataFrame(rows, MESSAGE), t)
    return sorted((r["traj_id"], r["turn_no"], r["message_id"]) for r in out.collect())


def test_whole_conversations_in_order(spark):
    m = [(1, "a", None, "System", "s"), (9, "a", 0, "human", "q0"), (3, "a", 0, " BOT", "r0"), (4, "a", 1, "User ", "q1"), (5, "a", 1, "Assistant", "r1"), (6, "b", 0, "user", "q"), (7, "b", 0, "model", "r")]
    assert run(spark, m) == [("a", 0, 1), ("a", 1, 9), ("a", 2, 3), ("a", 3, 4), ("a", 4, 5), ("b", 0, 6), ("b", 1, 7)]


@pytest.mark.parametrize(
    "extra",
    [
        [(9, "a", 2, "user", "gap"), (10, "a", 2, "bot", "gap")], [(9, "a", 0, "user", "other")], [(9, "a", 0, "assistant", "other")], [(9, "a", 0, "assistant", None)], [(9, "a", 0, "user", "​  ")],
        [(9, "a", 1, "user", "no reply")], [(9, "a", None, "system", "one"), (10, "a", None, "developer", "two")], [(9, "a", None, "user", "attempt unknown")], [(9, "a", -1, "user", "q"), (10, "a", -1, "bot", "r")],
    ],
)
def test_broken_ones_are_left_out(spark, extra):
    assert run(spark, [(1, "a", 0, "user", "q"), (2, "a", 0, "bot", "r"), *extra]) == []


def test_what_does_not_break_one(spark):
    m = [(5, "a", 0, "user", "q"), (2, "a", 0, "USER", "q"), (3, "a", 0, "bot", "r"), (4, "a", 0, "tool", "x"), (6, "a", 3, None, "y"), (7, "a", None, "system", "s"), (8, "a", None, "System", "s"), (9, None, 0, "user", "z")]
    assert run(spark, m) == [("a", 0, 7), ("a", 1, 2), ("a", 2, 3)]


def test_lost_attempts_come_from_the_steps(spark):
    t = [("a", [(0, "q"), (1, "again")]), ("b", [(0, "again")]), ("c", None)]
    m = [(1, "a", None, "user", "q"), (2, "a", 0, "bot", "r"), (3, "a", None, "human", "again"), (4, "a", 1, "bot", "r"), (5, "c", None, "user", "q"), (6, "c", 0, "bot", "r")]
    assert run(spark, m, t) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4)]


def test_clocks_may_tie_or_run_backwards(spark):
    m = [(1, "a", 0, "user", "q", 50), (2, "a", 0, "bot", "r", 10), (3, "a", 1, "user", "q2", 10), (4, "a", 1, "bot", "r2", None)]
    assert run(spark, m) == [("a", i, i + 1) for i in range(4)]


def test_random_tables_against_the_definition(spark):
    rng = random.Random(11)
    roles = {"system": ["system", "SYSTEM "], "user": ["user", "Human"], "assistant": ["bot", "model"]}
    rows, mid = [], 0
    for c in range(120):
        for a in range(rng.randint(1, 3)):
            for who in ("user", "assistant"):
                for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 0, 2])):
                    mid += 1
                    rows.append((mid, f"t{c}", a, rng.choice(roles[who]), rng.choice([f"x{mid}"] * 12 + ["", None]), rng.randint(0, 99)))
                    if rng.random() < 0.2:
                        rows.append((rng.choice([mid, 10_000 + mid]), *rows[-1][1:]))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            mid += 1
            rows.append((mid, f"t{c}", None, rng.choice(roles["system"]), f"s{rng.randint(0, 1)}", 0))
    want = []
    for c in {r[1] for r in rows}:
        turns = {}
        for i, _, a, role, text, _ in (r for r in rows if r[1] == c):
            who = next(k for k, v in roles.items() if role in v)
            turns[a, who, text] = min(i, turns.get((a, who, text), i))
        said = [(a, w, t) for a, w, t in turns if w != "system"]
        systems = [k for k in turns if k[1] == "system"]
        n = max((a for a, _, _ in said), default=-1) + 1
        if n and len(systems) <= 1 and all(t for _, _, t in said) and sorted((a, w) for a, w, _ in said) == sorted((a, w) for a in range(n) for w in ("user", "assistant")):
            order = systems + sorted(said, key=lambda k: (k[0], k[1] != "user"))
            want += [(c, i, turns[k]) for i, k in enumerate(order)]
    assert run(spark, rows) == sorted(want) and len(want) > 60


def test_empty_tables_and_other_columns(spark):
    assert run(spark, []) == []
    m = spark.createDataFrame([(1, "a", 0, "user", "q", None, 1, 2), (2, "a", 0, "bot", "r", None, 1, 2)], MESSAGE + ", msg int, w0 int")
    t = spark.createDataFrame([], f"id string, steps {STEPS}")
    assert threads.conversations(m, t).count() == 2


def turns(rows, words=None):
    """Turns of one group from (who, attempt, msg, time) rows; ``words`` names the bits set in each sketch."""
    sketch = np.zeros((len(rows), len(threads.SKETCH)), np.uint64)
    for i, w in enumerate(words or []):
        for b in w:
            sketch[i, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    col = [np.array([threads.NONE if r[k] is None else r[k] for r in rows], np.int64) for k in range(4)]
    return threads.Turns(np.zeros(len(rows), np.int64), col[0], col[1], col[2], col[3], sketch)


def test_links_go_by_attempt_then_time_then_names():
    name = threads.WORD_BITS + 3
    t = turns([(0, 0, 1, 0), (1, 0, 2, 9 * 10**8), (0, None, 3, None), (1, None, 4, None), (1, None, 5, 10**6)], [[], [], [name], [name], []])
    assert t.parents().tolist() == [-1, 0, -1, 2, 0]
    assert t.mended(t.parents()).tolist() == [0, 0, 0, 0, 0]


def test_without_scores_the_links_are_wrong(monkeypatch):
    """The order of the rows comes from the scores: with all of them nought, replies hang on the least message."""
    rows = [(w, a, 10 * a + w + 1, 10**6 * (2 * a + w)) for a in range(3) for w in (0, 1)]
    assert turns(rows).parents().tolist() == [-1, 0, 1, 2, 3, 4]
    for k in ("AGREE", "UNKNOWN", "TIME", "NAMES", "WORDS", "ROOT"):
        monkeypatch.setattr(threads, k, 0.0)
    assert turns(rows).parents().tolist() != [-1, 0, 1, 2, 3, 4]


@pytest.mark.parametrize("bad", [None, 7])
def test_a_lost_or_wrong_attempt_is_put_right_by_time_and_words(spark, bad):
    m = [(1, "a", 0, "user", "fix the_loop"), (2, "a", bad, "bot", "the_loop is fixed"), (3, "a", 1, "user", "now name"), (4, "a", 1, "bot", "done")]
    assert run(spark, m) == []
    df = spark.createDataFrame([(i, c, a, r, t, dt.datetime(2024, 1, 1, 0, 0, i)) for i, c, a, r, t in m], MESSAGE)
    out = threads.conversations(df, spark.createDataFrame([], f"id string, steps {STEPS}"), mend=True).collect()
    assert sorted((r["turn_no"], r["message_id"], r["parent"], r["mended"]) for r in out) == [(0, 1, None, False), (1, 2, 1, True), (2, 3, 2, False), (3, 4, 3, False)]


def test_conversations_longer_than_a_block(spark):
    n = threads.BLOCK + 3
    m = [(2 * a + w + 1, "a", a, ("user", "bot")[w], f"m{a} {w}") for a in range(n) for w in (0, 1)]
    assert run(spark, m) == [("a", i, i + 1) for i in range(2 * n)]
    assert run(spark, m[:300] + m[302:]) == [] == run(spark, [*m, (9999, "a", threads.BLOCK - 1, "bot", "a second reply")])


def test_a_group_with_too_many_turns_is_given_up_and_holds_nothing(monkeypatch):
    monkeypatch.setattr(threads, "FULL", 50)
    names = ["g", "g2", "traj_id", "who", "attempt", "c1", "c2", "msg", "time", "blank", "ghost", *threads.SKETCH]
    rows = [(1, 1, "long", 0, 0, i, i, i, i) for i in range(200)] + [(2, 2, "short", w, 0, w, w, w, w) for w in (0, 1)]
    cols = [list(c) for c in zip(*rows)] + [[False] * 202] * 2 + [[0] * 202] * len(threads.SKETCH)
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
    out = [r for b in threads._link(iter([whole.slice(i, 20) for i in range(0, 202, 20)])) for r in b.to_pylist()]
    assert [(r["traj_id"], r["who"], r["full"], r["parent"]) for r in out] == [("long", 0, True, None), ("short", 0, False, None), ("short", 1, False, 0)]


def test_every_word_and_name_leaves_its_bit(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i} n_{i}" for i in range(40)) + " w1"), (2, ""), (3, None)], "message_id long, content string")
    got = {}
    for r in threads.sketched(df, "content").collect():
        ones = [bin(r[c] & (2**64 - 1)).count("1") for c in threads.SKETCH]
        got[r["message_id"]] = (sum(ones[:-1]), ones[-1])
    assert 65 < got[1][0] <= 80 and 20 < got[1][1] <= 40 and got[2] == got[3] == (0, 0)
