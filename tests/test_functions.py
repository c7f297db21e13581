"""Patch, JSON, program and text functions on hand-made cases."""

import hashlib
import json

import pytest

from mendframe.functions import jsontext as J, patches as P, programs as G, text as X

BLOCK = "file: a.py\n<<<<<<< SEARCH\nx = 1\n=======\nx = 2\n>>>>>>> REPLACE"


def test_blocks():
    assert P.parse_edit_blocks(BLOCK) == [P.Block("a.py", "x = 1", "x = 2")]
    assert P.parse_edit_blocks(BLOCK.replace("file: a.py\n", "") + "\r\n", "main") == [P.Block("main", "x = 1", "x = 2")]
    assert P.parse_edit_blocks("only prose", "main") == []
    diff = "--- a/m.rs\n+++ b/m.rs\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline at end of file\n"
    assert P.parse_edit_blocks(diff) == [P.Block("m.rs", "a\nb", "a\nc")]
    assert len(P.parse_edit_blocks(BLOCK + "\n" + diff)) == 1  # blocks come before diffs


@pytest.mark.parametrize("text", [BLOCK.replace("=======\n", ""), BLOCK.rsplit("\n", 1)[0], BLOCK.replace("x = 2", "<<<<<<< SEARCH"), BLOCK.replace("file: a.py\n", "")])
def test_malformed_blocks(text):
    with pytest.raises(P.PatchError) as e:
        P.parse_edit_blocks(text)
    assert e.value.kind == "malformed"


@pytest.mark.parametrize(
    "content, search, replace, want",
    [
        ("a\nb\n", "b", "c", ("a\nc\n", False)), ("a\n", "zz", "c", "not_found"), ("b b", "b", "c", "ambiguous"), ("a", "a", "a", "no_op"),
        ("if x:\n    y = 1\nz\n", "if x:\n  y  = 1", "pass", ("pass\nz\n", True)), ("a", "a\nb\nc", "d", "not_found"), ("a\n\n", "", "d", "not_found"), ("aaa", "aa", "b", "ambiguous"),
    ],
)
def test_apply(content, search, replace, want):
    block = P.Block("f", search, replace)
    if isinstance(want, str):
        with pytest.raises(P.PatchError) as e:
            P.apply_block(content, block)
        assert e.value.kind == want
    else:
        assert P.apply_block(content, block) == want


def test_too_large_comes_before_matching():
    with pytest.raises(P.PatchError) as e:
        P.apply_block("a", P.Block("f", "a\n" * 40, "b\n" * 40))
    assert e.value.kind == "too_large"


def test_canonical_form_gives_the_same_text():
    diff = "--- a/candidate.py\n+++ b/candidate.py\n@@ -1,2 +1,2 @@\n x = 1\n-y = 2\n+y = 3\n"
    assert P.apply_patch("x = 1\ny = 2\n", diff)[0] == P.apply_patch("x = 1\ny = 2\n", P.canonical_patch(diff))[0] == "x = 1\ny = 3\n"
    assert P.replay_equal("x = 1\ny = 2\n", diff) and not P.replay_equal("q", diff)


def test_objects_and_proposals():
    text = 'So: ```json\n{"action": "patch", "patch": "a { } \\" b", "confidence": 0.5}``` and {"action": "no_fix"}'
    assert json.loads(J.first_object(text))["confidence"] == 0.5
    assert J.parse_proposal(text) == {"action": "patch", "patch": 'a { } " b', "reason": None, "confidence": 0.5}
    assert J.first_object("none") is None and J.first_object('{"a": "open }') is None
    assert J.any_action("{broken} " + '{"action": "escalate"}') == "escalate" and J.any_action("{}") is None
    for bad in ("no json", '{"action": "guess"}', '{"action": 1}', '{"patch": "x"}', '{"action": "patch", "confidence": NaN}'):
        with pytest.raises(ValueError):
            J.parse_proposal(bad)


def test_strictness():
    assert not J.strict_equal(True, 1) and not J.strict_equal(1, 1.0) and J.strict_equal({"a": [1, None]}, {"a": [1, None]})
    assert J.strict_json("[1, 2.5]") and not J.strict_json("[NaN]") and not J.strict_json("1e999") and not J.strict_json("[" * 70 + "]" * 70)
    ok = '{"action": "patch", "patch": null, "reason": "r", "confidence": 0.5}'
    assert J.meets_contract(ok) and not J.meets_contract(ok.replace("0.5", "0.")) and not J.meets_contract(ok + " ")


def test_fingerprints_ignore_names_but_not_values():
    a, b, c = "def solve(x):\n    y = x + 1\n    return y", "def solve(p):\n  # note\n  q = p + 1\n  return q", "def solve(x):\n    y = x + 2\n    return y"
    assert G.fingerprint(a) == G.fingerprint(b) != G.fingerprint(c) and G.fingerprint("def (") is None


def test_policy():
    assert G.policy_violation("def solve(x):\n    return sorted(x)[:1]", "solve") is None
    for bad in ("import os", "def solve(x):\n    return x.__class__", "def solve(x):\n    return open(x)", "def solve(x, y=1):\n    return x", "def other(x):\n    return x", "def solve(x):\n    def f():\n        return 1\n    return f()", "def ("):
        assert G.policy_violation(bad, "solve")


def test_every_site_is_one_mutant():
    src = 'use std::fmt;\nfn main() {\n    let mut a: i32 = 5;\n    let b: bool = true;\n    println!("{}", a);\n    f("x");\n}\n'
    got = {(c, k): b for c, k, _, b in G.mutants(src)}
    assert 'let b: bool = 1;' in got[("E0308", "bool_as_int")] and "use std" not in got[("E0433", "missing_import")]
    assert "undeclared_var_qz" in got[("E0425", "undeclared_ident")] and "let a: i32" in got[("E0596", "missing_mut")] and "f(42)" in got[("E0308", "wrong_arg_type")]
    assert sum(k == "missing_semicolon" for _, k, _, _ in G.mutants(src)) == 2
    assert all(b != src for *_, b in G.mutants(src)) and G.mutants("") == []


def test_profile():
    assert X.profile_count("events: Dr Ir\nsummary: 3 42\n") == 42
    for bad in ("summary: 1", "events: Ir\nevents: Ir\nsummary: 1", "events: Ir Dr\nsummary: 1", "events: Ir\nsummary: 0", "events: Ir\nsummary: x"):
        with pytest.raises(ValueError):
            X.profile_count(bad)


def test_text_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a\r\nb\nc\n", " x \n y "), (2, "", ""), (3, None, None)], "id long, t string, s string")
    got = {r[0]: r[1:] for r in rows.select("id", X.lines(F.col("t")).alias("l"), X.squeezed(F.col("s")).alias("q"), X.truncated(F.col("s"), 2).alias("c"), X.numbered_window(F.col("t"), F.lit(2), F.lit(2), 0).alias("w")).collect()}
    assert got == {1: (["a", "b", "c"], "x y", " x...", "   2 | b\n"), 2: ([], "", "", ""), 3: (None, None, None, None)}


def test_compiler_stream(spark):
    e = {"reason": "compiler-message", "message": {"level": "error", "message": "m", "code": {"code": "E1"}, "rendered": None, "spans": [{"file_name": "x", "line_start": 1, "line_end": 1, "is_primary": False}, {"file_name": "y", "line_start": 2, "line_end": 3, "is_primary": True}]}}
    w = {"reason": "compiler-message", "message": {"level": "warning", "message": "w", "spans": []}}
    lines = [(1, 0, json.dumps(e)), (1, 1, json.dumps(w)), (1, 2, "Compiling"), (1, 3, "{bad"), (2, 0, json.dumps(w)), (3, 0, "")]
    got = {r["run"]: r for r in X.check_results(spark.createDataFrame(lines, "run long, n long, line string"), "run", "n", "line").collect()}
    assert got[1]["errors"][0]["file"] == "y" and got[1]["warnings"] == 1 and not got[1]["passed"]
    assert got[2]["passed"] and got[2]["warnings"] == 1 and got[3]["passed"] and got[3]["errors"] == []


def test_canonical_json_hash(spark):
    from mendframe.operators.corpus import canonical_json_sha256

    rows = spark.createDataFrame([('{"b": 1, "a": [1.5, "é"]}',), ("{bad",), (None,), ("[NaN]",)], "t string")
    want = hashlib.sha256('{"a":[1.5,"é"],"b":1}'.encode()).hexdigest()
    assert [r[0] for r in rows.select(canonical_json_sha256("t")).collect()] == [want, None, None, None]
