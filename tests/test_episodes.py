"""Episode gates, examples, evaluation summaries, loop replay, streams and sources."""

import json

import pytest
from pyspark.sql import functions as F

from mendframe import schemas
from mendframe.operators import evaluate as E, replay as R, trajectory as J
from mendframe.sources import jsonl
from mendframe.streaming import logs


def step(attempt, action="patch", applied=True, reverted=False, after=0, actor="tiny", patch="p", reason=None):
    return (attempt, actor, "E1", 1, f"context {attempt}", (action, patch, reason, 0.5), applied, False, after, reverted, 1, None)


@pytest.fixture(scope="module")
def episodes(spark):
    rows = [
        ("none", None, "c1", "m", "x", [], [], "success", 0, False, 1),
        ("one", None, "c1", "m", "x", [], [step(0)], "success", 1, False, 2),
        ("back", None, "c2", "m", "x", [], [step(1), step(0, reverted=True, after=9)], "success", 2, False, 3),
        ("no", None, "c3", "m", "x", [], [step(0, "no_fix", False, patch=None, reason="model_error: x")], "no_fix", 1, False, 4),
        ("up", None, None, "m", "x", None, [step(0, "PATCH ", False, after=None)], "odd", 0, True, None),
        ("null", None, "c9", "m", "x", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, schemas.EPISODE()).cache()


def test_accepted_steps_and_traces(episodes):
    assert {(r["id"], r["step"]["attempt"]) for r in J.accepted_steps(episodes).collect()} == {("one", 0), ("back", 1)}
    assert {r["id"] for r in J.accepted_steps(episodes, unapplied=True).collect()} == {"one", "back", "up"}
    t = J.repair_traces(episodes, "sys").collect()
    assert [(r["id"], r["n_steps"], [m["role"] for m in r["messages"]]) for r in t] == [("back", 2, ["system", "user", "assistant", "user", "assistant"])]
    assert t[0]["messages"][1]["content"] == "context 0"  # steps are put in order
    assert {r["id"]: r["messages"][2]["content"] for r in J.single_turns(episodes, "s").collect()}["one"] == '{"action":"patch","patch":"p","reason":"","confidence":0.5}'


def test_rules_of_the_loop(episodes):
    assert {(r["id"], r["defect"]) for r in J.episode_defects(episodes).collect()} == {("up", "over_budget"), ("up", "escalated_without")}
    assert {r["outcome"]: r["n"] for r in J.outcome_tally(episodes).collect()} == {"success": 3, "no_fix": 1, "other": 2}


def test_gates(spark):
    rows = spark.createDataFrame([("a/b.py",), ("/a",), ("a/../b",), ("",), (None,), ("..a/b",)], "p string")
    assert [r[0] for r in rows.select(J.relative_path(F.col("p"))).collect()] == [True, False, False, False, False, True]
    s = spark.createDataFrame([("passed", True), ("passed", None), ("no_speedup", True), ("mismatch", False), ("weird", True)], "s string, c boolean")
    assert [tuple(r) for r in s.select(J.severity(F.col("s"), F.col("c")), J.known_status(F.col("s"))).collect()] == [(0, "passed"), (3, "passed"), (1, "no_speedup"), (2, "mismatch"), (3, "bridge_error")]
    r = spark.createDataFrame([(True, True, 0.5), (True, True, 0.0), (True, None, 1.0), (True, True, float("nan")), (True, True, float("inf"))], "p boolean, c boolean, r double")
    assert [x[0] for x in r.select(J.positive_reward(F.col("p"), F.col("c"), F.col("r"))).collect()] == [True, False, False, False, False]


def test_field_guards(spark):
    df = spark.createDataFrame([(1, (2,))], "a long, b struct<secret:long>")
    assert J.project_allowed(df, ["a"]).columns == ["a"]
    for bad in (lambda: J.project_allowed(df, ["z"]), lambda: J.refuse_fields(df, ["secret"]), lambda: J.require_exact_fields(df, ["a"]), lambda: J.checked_source(df, "dev_eval", "a", "a", [])):
        with pytest.raises(ValueError):
            bad()


def test_chat_shapes(spark):
    chats = [["system", "user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["user", "assistant", "user"], ["system", "user"], ["system", "assistant", "user", "assistant"], [], None, ["system", None, "assistant"]]
    rows = spark.createDataFrame([(c,) for c in chats], "r array<string>")
    assert [r[0] for r in rows.select(J.chat_shape(F.col("r"))).collect()] == [True, True, False, False, False, False, False, False]


def test_suffix_and_marker(spark):
    rows = spark.createDataFrame([("a--M--b--M--c" + J.LEGACY_SUFFIX,), ("x" + J.SUFFIX,), ("plain",)], "c string")
    got = rows.select(J.canonical_suffix(F.col("c"), strict=False).alias("s"), J.after_marker(F.col("c"), "--M--", J.LEGACY_SUFFIX).alias("m")).collect()
    assert [r["s"] for r in got] == ["a--M--b--M--c" + J.SUFFIX, "x" + J.SUFFIX, None] and [r["m"] for r in got] == ["b--M--c", None, None]
    with pytest.raises(Exception, match="no known cue"):
        rows.select(J.canonical_suffix(F.col("c"))).collect()


def test_arm_summary(spark):
    rows = [("a", f"c{i}", "E1" if i % 2 else None, None, i < 5, 1 + i % 3, 10 * i, None) for i in range(20)]
    df = spark.createDataFrame(rows, schemas.EVAL_ROW())
    r = E.with_empty_arms(E.arm_summary(df), ["a", "empty"]).orderBy("arm").collect()
    assert (r[0]["n"], r[0]["solved"], r[0]["repair_rate"], r[0]["avg_attempts"], r[0]["median_ms"], r[0]["p95_ms"], r[0]["escalated"]) == (20, 5, 0.25, 1.95, 100, 190, 0)
    assert tuple(r[1])[1:] == (0,) * 7
    assert {(x["code"], x["solved"], x["n"], x["rate"]) for x in E.envelope(df).collect()} == {("?", 3, 10, 0.3), ("E1", 2, 10, 0.2)}
    assert E.envelope_pivot(df, ["a", "zz"]).orderBy("code").first().asDict() == {"code": "?", "a": "3/10", "zz": "-"}


def test_failure_taxonomy(spark):
    rows = [("no_fix", "model_error: x", None, None, "formatting"), ("no_fix", None, None, None, "missed_optimization"), ("escalate", None, None, None, "missed_optimization"), ("patch", None, False, None, "invalid_patch"), ("patch", None, True, "no_speedup", "correct_but_not_faster"), ("patch", None, True, "mismatch", "semantic_failure"), ("patch", "", True, "bridge_error", "missed_optimization"), ("patch", None, True, None, "missed_optimization")]
    df = spark.createDataFrame(rows, "a string, r string, p boolean, s string, want string")
    assert df.where(E.failure_category(*map(F.col, "arps")) != F.col("want")).count() == 0


def test_runs_compared(spark):
    a = spark.createDataFrame([("x", True, 1, 5), ("y", False, 2, 6), ("z", None, 1, 7)], "case_id string, success boolean, attempts long, latency_ms long")
    b = spark.createDataFrame([("y", True, 3, 60), ("x", False, 1, 50), ("w", True, 1, 9)], "case_id string, success boolean, attempts long, latency_ms long")
    assert dict(map(tuple, E.compare_runs(a, b).collect())) == {"x": "lost", "y": "gained", "z": "only_before", "w": "only_after"}
    got = {r["case_id"]: tuple(r)[1:] for r in E.escalation_composite(a, b).collect()}
    assert got == {"x": (True, 1, 5, 5, False), "y": (True, 5, 60, 66, True), "z": (None, 1, 7, 7, False)}


def test_spike_gate_rejects_nothing_without_attacks(spark):
    df = spark.createDataFrame([("p", True, 0.5, False, None)], "problem_id string, stable boolean, log_speedup double, is_attack boolean, rejected boolean")
    assert tuple(E.spike_gate(df, 1).first()) == (True, True, False, False)


def brackets(text):
    return abs(text.count("(") - text.count(")"))


def fix(a, b):
    return {"action": "patch", "patch": f"<<<<<<< SEARCH\n{a}\n=======\n{b}\n>>>>>>> REPLACE"}


def test_replayed_loop():
    run = lambda c, t, f=(), **k: R.run_episode(c, list(t), list(f), brackets, **k)
    assert run("ok", [])["outcome"] == "success" and run("ok", [])["attempts"] == 0
    assert run("f(", [fix("f(", "f()")])["outcome"] == "success"
    worse = run("f(", [fix("f(", "f(("), fix("f(", "f()")])
    assert [s["reverted"] for s in worse["steps"]] == [True, False] and worse["steps"][1]["context"] == "patch reverted: errors 1 -> 2"
    same = run("f(", [fix("f(", "g("), fix("g(", "g()")])
    assert same["content"] == "g()" and not same["steps"][0]["reverted"]  # as many errors is no reason to go back
    assert run("f(", [{"action": "patch", "error": "timeout"}, {"action": "no_fix"}])["outcome"] == "no_fix"
    up = run("f(", [{"action": "escalate"}], [fix("f(", "f()")])
    assert (up["outcome"], up["escalated"], up["attempts"], up["steps"][1]["attempt"]) == ("success", True, 2, 1)
    assert run("f(", [fix("zz", "y")] * 9, budget=3)["attempts"] == 3


def test_replay_of_tables(spark):
    cases = spark.createDataFrame([("a", "f("), ("b", "ok"), ("c", None)], "case_id string, content string")
    p = spark.createDataFrame([("a", "tiny", 0, "patch", fix("f(", "f()")["patch"], None)], "case_id string, actor string, place int, action string, patch string, error string")
    assert {r["case_id"]: (r["outcome"], r["attempts"]) for r in R.replay(cases, p, brackets).collect()} == {"a": ("success", 1), "b": ("success", 0), "c": ("success", 0)}


def test_verification_cache(spark):
    items = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k2", "y")], "key string, text string")
    cache = spark.createDataFrame([("k1", "failed", 1), ("k1", "passed", 2)], "key string, status string, ordinal int")
    out, fresh = R.verify_missing(items, cache, "key", "text", lambda t: "profile_unstable")
    assert {tuple(r) for r in out.collect()} == {("k1", "passed", True), ("k2", "profile_unstable", False)} and fresh.count() == 1


def test_log_is_ingested_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), (None, 3)], "id string, v int")
    rows.write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new but repeats of what is there
        log = logs.read_log(spark, str(tmp_path / "in"), rows.schema)
        logs.ingest(log, "id", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([("b", 2), ("c", 4)], "id string, v int").write.mode("append").json(str(tmp_path / "in"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    with open(path, "w") as f:
        f.write('{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    s = spark.createDataFrame([], "id string, n long").schema
    got = jsonl.scan_strict(spark, path, s).orderBy("ordinal").collect()
    assert [(r["id"], r["n"]) for r in got] == [("x", 1), ("y", None)]
    with open(path, "a") as f:
        f.write("{bad\n")
    with pytest.raises(Exception):
        jsonl.scan_strict(spark, path, s).collect()
    assert {r["id"] for r in jsonl.scan_lenient(spark, path, "id string").collect()} == {"x", "y"}
    jsonl.create(spark.createDataFrame(got), str(tmp_path / "new"))
    with pytest.raises(Exception):
        jsonl.create(spark.createDataFrame(got), str(tmp_path / "new"))
    with pytest.raises(Exception, match="no row"):
        jsonl.one_or_fail(spark.createDataFrame([("x",)], "id string"), "id", "q").collect()
    jsonl.manifest(spark.createDataFrame([("x", 1)], "id string, n int"), str(tmp_path / "m"))
    assert json.loads(next((tmp_path / "m").glob("part*.json")).read_text()) == {"id": "x", "n": 1}


def test_ingestion_with_a_bounded_state(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00"), (None, "2024-01-01 00:03:00"), ("c", None)]
    spark.createDataFrame(rows, "id string, at string").write.json(f"{tmp_path}/in")
    log = logs.read_log(spark, f"{tmp_path}/in", spark.createDataFrame([], "id string, at timestamp").schema)
    for _ in range(2):  # a restart adds nothing
        logs.ingest_within(log, "id", "at", "1 hour", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
