"""Registered queries that SQL cannot say, against plain Python written apart from the library."""

import ast
import difflib
import hashlib
import json
import os
import random
import re

import pandas as pd
import pytest

from mendframe.functions import programs as G
from mendframe.plans import registry
from mendframe.sources import seeds

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def once(name, key):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet").sort_values("ingested_at").drop_duplicates(key)


def rows_of(spark, name):
    return [r.asDict(True) for r in registry.QUERIES[name](spark, FOLDER).collect()]


def sha1(x):
    return None if x is None else hashlib.sha1(x.encode()).hexdigest()


# --- patches: the whole text is cut by one expression for blocks, one for hunks --------------------------

MARK = r"[ \t]*\r?\n"
BLOCKS = re.compile(rf"(?:^([^\n]*)\n)?^<<<<<<< SEARCH{MARK}(.*?)^={{7}}{MARK}(.*?)^>>>>>>> REPLACE[ \t]*\r?$", re.S | re.M)


def blocks(patch, default):
    """[(file, search, replace)] or the word malformed."""
    text = patch.replace("\r\n", "\n")
    kinds = [m[0].rstrip() for m in re.finditer(r"^(?:<{7} SEARCH|={7}|>{7} REPLACE)[ \t]*$", text, re.M)]
    opened = "".join({"<": "s", "=": "d", ">": "r"}[k[0]] for k in kinds)
    if "s" in opened:
        if not re.fullmatch(r"[dr]*(?:sdr[dr]*)*", opened):
            return "malformed"
        out = []
        for before, search, replace in BLOCKS.findall(text):
            named = before.strip()
            out.append((named[5:].strip() if named.startswith("file:") and named[5:].strip() else default, search[:-1] if search else "", replace[:-1] if replace else ""))
        return out
    out, file = [], default
    for part in re.split(r"^(?=@@|\+\+\+ |--- |diff )", text, flags=re.M):
        first, _, rest = part.partition("\n")
        if first.startswith("+++ ") and first[4:].strip() not in ("", "/dev/null"):
            file = first[4:].strip().removeprefix("b/")
        if first.startswith("@@"):
            body = []
            for x in rest.removesuffix("\n").split("\n") if rest else []:
                if x and x[0] not in " +-\\":
                    break
                body.append(x or " ")
            out.append((file, "\n".join(x[1:] for x in body if x[0] in " -"), "\n".join(x[1:] for x in body if x[0] in " +")))
    return out


def count_lines(x):
    return len(x.split("\n")) - (1 if x.endswith("\n") or not x else 0)


def apply(text, patch, default):
    """(text, loose, number of blocks, error)."""
    todo, loose = blocks(patch or "", default), False
    if todo == "malformed":
        return None, None, None, "malformed"
    for _, search, replace in todo:
        if search == replace:
            return None, None, None, "no_op"
        if count_lines(search) + count_lines(replace) > 60:
            return None, None, None, "too_large"
        hits = sum(text.startswith(search, i) for i in range(len(text))) if search else 0
        if hits > 1:
            return None, None, None, "ambiguous"
        if hits == 1:
            text = text.replace(search, replace, 1)
            continue
        have = text.splitlines(keepends=True)
        want = [x.split() for x in search.split("\n")][: count_lines(search)]
        at = [i for i in range(len(have) - len(want) + 1) if want and [x.split() for x in have[i : i + len(want)]] == want]
        if len(at) != 1:
            return None, None, None, "not_found"
        end = at[0] + len(want)
        more = "\n" if have[end - 1].endswith("\n") and not replace.endswith("\n") else ""
        text, loose = "".join(have[: at[0]]) + replace + more + "".join(have[end:]), True
    return text, loose, len(todo), None


def patches():
    for _, t in once("trajectories", "id").iterrows():
        for place, s in enumerate(t["steps"] if t["steps"] is not None else []):
            if (s["proposal"]["action"] or "").strip(" ").lower() == "patch":
                source = None
                for marker, file in (("--- src/main.rs ---\n", "src/main.rs"), ("--- slow reference ---\n", "candidate.py")):
                    if source is None and s["context"] and marker in s["context"]:
                        source = s["context"].split(marker)
                yield t["id"], place, s["proposal"]["patch"], s["context"]


def by_step(rows, *columns):
    return {(r["id"], r["place"]): tuple(r[c] for c in columns) for r in rows}


def test_blocks_of_every_patch(spark):
    want = {}
    for i, k, patch, context in patches():
        got = blocks(patch or "", "f")
        want[i, k] = (0, got) if got == "malformed" else (len(got), None)
    assert by_step(rows_of(spark, "TXT1"), "blocks", "error") == want and len(want) > 40
    got = sorted((r["id"], r["place"], r["file"], r["search_sha1"], r["replace_sha1"]) for r in rows_of(spark, "TXT2"))
    diffs = []
    for i, k, patch, context in patches():
        if "@@" in (patch or "") and "<<<<<<<" not in patch:
            file = "src/main.rs" if "--- src/main.rs ---\n" in (context or "") else "candidate.py"
            diffs += [(i, k, f, sha1(a), sha1(b)) for f, a, b in blocks(patch, file)]
    assert got == sorted(diffs) and diffs


def sources(spark):
    """The program of each patch as the library cuts it out, checked to be part of the step's context."""
    from mendframe.plans import function_queries as Q

    out = {}
    contexts = {(i, k): c for i, k, _, c in patches()}
    for r in Q._patches(spark, FOLDER).collect():
        assert r["source"] is None or r["source"] in contexts[r["id"], r["place"]]
        out[r["id"], r["place"]] = (r["source"], r["patch"], r["file"])
    return out


def test_applied_patches(spark):
    src = sources(spark)
    plain = {k: apply(s, p, f) if s is not None else (None,) * 4 for k, (s, p, f) in src.items()}
    assert by_step(rows_of(spark, "TXT3"), "content_sha1", "error") == {k: (sha1(v[0]), v[3]) for k, v in plain.items()}
    tabs = {k: apply(s.replace("    ", "\t"), p, f) if s is not None else (None,) * 4 for k, (s, p, f) in src.items()}
    assert by_step(rows_of(spark, "TXT5"), "loose", "error") == {k: (v[1], v[3]) for k, v in tabs.items()}
    assert by_step(rows_of(spark, "TXT7"), "blocks") == {k: (v[2],) for k, v in plain.items() if v[2] and v[2] > 1}
    form = {}
    for k, (_, p, f) in src.items():
        b = blocks(p or "", f)
        form[k] = None if not b or b == "malformed" else "\n".join(f"file: {x}\n<<<<<<< SEARCH\n{y}\n=======\n{z}\n>>>>>>> REPLACE" for x, y, z in b)
    assert by_step(rows_of(spark, "TXT8"), "canonical_sha1") == {k: (sha1(v),) for k, v in form.items()}
    proven = {k: (bool(s is not None and form[k] and plain[k][0] is not None and plain[k][0] == apply(s, form[k], f)[0]),) for k, (s, p, f) in src.items()}
    assert by_step(rows_of(spark, "TRJ7"), "proven") == proven and any(v for v, in proven.values())


# --- programs -----------------------------------------------------------------------------------------------


def renamed(source):
    """The dump of a tree whose names were replaced token by token before parsing."""
    import io
    import tokenize

    tree = ast.parse(source)
    at = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) or isinstance(n, ast.arg):
            at[n.lineno, n.col_offset] = n.id if isinstance(n, ast.Name) else n.arg
    order, out = {}, []

    def walk(n):
        name = n.id if isinstance(n, ast.Name) else n.arg if isinstance(n, ast.arg) else None
        if name and name not in G.KEPT_NAMES:
            order.setdefault(name, f"v{len(order)}")
        for x in ast.iter_child_nodes(n):
            walk(x)

    walk(tree)
    for t in tokenize.tokenize(io.BytesIO(source.encode()).readline):
        byte = len(t.line[: t.start[1]].encode())
        out.append((t.type, order.get(t.string, t.string) if t.type == tokenize.NAME and (t.start[0], byte) in at else t.string))
    return ast.dump(ast.parse(tokenize.untokenize(out)))


def test_fingerprints(spark):
    p = once("problems", "id").set_index("id")["reference_source"]
    want = {i: hashlib.sha256(renamed(x).encode()).hexdigest() for i, x in p.items()}
    assert {r["id"]: r["fingerprint"] for r in rows_of(spark, "COR6")} == want


def test_policy_of_every_problem(spark):
    """Two functions in one text break the policy; one that only calls what is allowed doesn't."""
    p = once("problems", "id").set_index("id")
    for r in rows_of(spark, "UDF_policy"):
        many = len(re.findall(r"^(?:def|class|import|from)\b", p.loc[r["id"], "reference_source"], re.M)) != 1
        assert not many or r["violation"] == "not exactly one function of that name"


def sites(text, rule):
    """Texts that differ from ``text`` at one site of a rule, found by position."""
    out, at = [], 0
    pattern = re.compile(rule.pattern)
    while m := pattern.search(text, at):
        new = text[: m.start()] + m.expand(rule.new) + text[m.end() :]
        if new.strip() and new != text:
            out.append(new)
        at = m.end() if m.end() > m.start() else m.end() + 1
    return out if not rule.if_has or any(x in text for x in rule.if_has) else []


def test_mutants(spark):
    c = once("cases", "case_id").dropna(subset=["original"])
    per = {r.case_id: [(m, x) for m in G.MUTATIONS for x in sites(r.original, m)] for r in c.itertuples()}
    assert {r["case_id"]: r["sites"] for r in rows_of(spark, "COR18")} == {k: len(v) for k, v in per.items()}
    tally = pd.Series([(m.category, m.code) for v in per.values() for m, _ in v]).value_counts().to_dict()
    assert {(r["category"], r["intended_code"]): r["n"] for r in rows_of(spark, "COR19")} == tally
    for v in per.values():
        for m, x in v[:5]:
            assert any(op != "equal" for op, *_ in difflib.SequenceMatcher(None, x[:200], "").get_opcodes())


def test_every_mutation_fires_on_the_seed_programs(spark):
    made = rows_of(spark, "SRC6")
    assert [r["seed_index"] for r in sorted(made, key=lambda r: r["seed_index"])] == list(range(49)) and len({r["source"] for r in made}) == 49
    got = rows_of(spark, "COR20")
    assert {r["category"] for r in got} == {m.category for m in G.MUTATIONS}
    want = {(r["seed_index"], m.category, k): hashlib.sha1(x.encode()).hexdigest()[:12] for r in made for m in G.MUTATIONS for k, x in enumerate(sites(r["source"], m))}
    assert {(r["seed_index"], r["category"], r["site"]): r["case_id"] for r in got} == want


def test_batteries(spark):
    got = rows_of(spark, "COR23")
    for d in seeds.DOMAINS:
        mine = sorted((r for r in got if r["domain"] == d), key=lambda r: r["place"])
        edges = [json.loads(r["input"]) for r in mine if r["kind"] == "edge"]
        assert edges == seeds.edge_inputs(d) and sum(r["kind"] == "random" for r in mine) == 64 and [r["kind"] for r in mine[-5:]] == [f"b{i}" for i in range(5)]
        assert any(x in ([], [[], []]) or x and x[0] == [] for x in edges)  # nothing at all is always an edge
        assert all(r["id"] == f"{d}:{hashlib.sha256(r['input'].encode()).hexdigest()}" for r in mine)


# --- shuffles, replay ----------------------------------------------------------------------------------------


def test_seeded_shuffle(spark):
    s = pd.read_parquet(f"{FOLDER}/supplier.parquet")
    want = {}
    for nation, keys in s.groupby("s_nationkey")["s_suppkey"]:
        order = sorted(keys)
        random.Random(f"7:{nation}").shuffle(order)
        want |= {k: i for i, k in enumerate(order)}
    assert {r["s_suppkey"]: r["shuffled"] for r in rows_of(spark, "SRT3")} == want


def errors(text):
    return sum(abs(text.count(a) - text.count(b)) for a, b in ("()", "[]", "{}"))


def replayed(text, proposals):
    """Outcome, attempts, whether the second actor spoke, what was taken back and what was applied."""
    spoke, n, back, applied, outcome = False, 0, 0, 0, None
    for actor, budget in (("tiny", 4), ("frontier", 2)):
        mine = [p for a, p in proposals if a == actor]
        if actor == "frontier":
            if outcome not in (None, "escalate") or not mine:
                break
            spoke, outcome = True, None
        for p in mine[:budget]:
            if errors(text) == 0:
                break
            n += 1
            action = (p["action"] or "").strip().lower()
            if action in ("escalate", "no_fix"):
                outcome = action
                break
            new, _, _, bad = apply(text, p["patch"], "main")
            if bad:
                continue
            applied += 1
            if errors(new) > errors(text):
                back += 1
            else:
                text = new
        if outcome is None and errors(text) == 0:
            outcome = "success"
    return outcome or "escalate", n, spoke, back, applied


def test_replay_of_every_episode(spark):
    about = dict(zip(once("cases", "case_id")["case_id"], once("cases", "case_id")["broken"])) | dict(zip(once("problems", "id")["id"], once("problems", "id")["reference_source"]))
    want = {}
    for t in once("trajectories", "id").itertuples():
        if t.case_id not in about:
            continue
        steps = sorted(enumerate(t.steps if t.steps is not None else []), key=lambda s: (s[1]["attempt"], s[0]))
        want[t.id] = replayed((about[t.case_id] or "") + "\n(" if about[t.case_id] is not None else "", [(s["actor"] or "tiny", s["proposal"]) for _, s in steps])
    got = {r["case_id"]: (r["outcome"], r["attempts"], r["escalated"]) for r in rows_of(spark, "LOOP1")}
    assert got == {k: v[:3] for k, v in want.items()} and len(got) > 30
    assert {r["case_id"]: (r["attempts"], r["steps"]) for r in rows_of(spark, "LOOP2")} == {k: (v[1], v[1]) for k, v in want.items() if v[2]}
    assert {r["case_id"]: (r["reverted"], r["applied"]) for r in rows_of(spark, "LOOP3")} == {k: v[3:] for k, v in want.items()}


def test_contract_of_every_reply(spark):
    m = once("messages", "message_id").set_index("message_id")["content"]
    for r in rows_of(spark, "UDF_contract"):
        try:
            p = json.loads(m[r["message_id"]])
            ok = list(p) == ["action", "patch", "reason", "confidence"] and p["action"] in ("patch", "no_fix", "escalate") and isinstance(p["reason"], str) and 0 <= p["confidence"] <= 1
        except (ValueError, TypeError):
            ok = False
        assert r["ok"] == ok


def test_place_and_budget_are_counted_per_actor(spark):
    """Frontier proposals after many tiny ones, and steps out of order, keep their budgets."""
    from mendframe.operators import replay as R

    cases = spark.createDataFrame([("c", "((")], "case_id string, content string")
    fix = lambda a, b: f"<<<<<<< SEARCH\n{a}\n=======\n{b}\n>>>>>>> REPLACE"
    rows = [("c", "frontier", 9, "patch", fix("(", "()"), None), ("c", "frontier", 7, "patch", fix("((", "("), None), ("c", "tiny", 3, "escalate", None, None), ("c", "tiny", 2, "patch", fix("zz", "y"), None), ("c", "tiny", 0, "patch", "prose", None)]
    out = R.replay(cases, spark.createDataFrame(rows, "case_id string, actor string, place long, action string, patch string, error string"), errors).collect()[0]
    assert (out["outcome"], out["attempts"], out["escalated"], out["content"]) == ("success", 5, True, "()")
    assert [s["actor"] for s in out["steps"]] == ["tiny"] * 3 + ["frontier"] * 2
