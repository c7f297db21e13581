"""Defects of replies: forms of edits, votes, the label model, whole tables."""

import numpy as np
import pytest

from mendframe.llm import label_model as L, languages, patch_defects as P

CONTEXT = "error[E0425]: cannot find value in this scope\n --> src/main.rs:9:3\n--- src/main.rs ---\n" + "\n".join(f"fn name_{i}(first_{i}: u32) -> u32 {{ first_{i} + {i} }}" for i in range(12))
BLOCK = "file: a.rs\n<<<<<<< SEARCH\nlet x = 1;\n=======\nlet x = 2;\n>>>>>>> REPLACE"
DIFF = "--- a/src/main.rs\n+++ b/src/main.rs\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d"


@pytest.mark.parametrize(
    "text, form",
    [
        (BLOCK, "whole"), (f"```\n{BLOCK}\n```", "whole"), (f"I'm sorry, I can't.\n{BLOCK}", "whole"), (BLOCK + "\n" + BLOCK.replace("x", "y"), "whole"), (DIFF, "whole"), (DIFF + "\n", "whole"), (f"```diff\n{DIFF}\n```\nDone.", "whole"),
        ("@@ -1 +1 @@\n-a\n+b", "whole"), (BLOCK.replace("let x = 2;\n", ""), "whole"), (BLOCK + "\nlet y = '<<<<<<< SEARCH';", "whole"),
        (BLOCK[:-3], "begun"), (BLOCK.rsplit("\n", 1)[0], "begun"), (BLOCK.split("\n=====")[0], "begun"), (BLOCK + "\n" + BLOCK[:40], "begun"), (DIFF[:-2], "begun"), (DIFF.split("\n+c")[0], "begun"), ("--- a/x.rs\n+++ b/x.rs", "begun"), ("--- a/x.rs", "begun"), ("file: a.rs\n<<<<<<< SEA", "begun"), ("file: a.rs", "begun"),
        ("", "none"), ("```\n```", "none"), ("No edit here.", "none"), (CONTEXT, "none"), ("a = '<<<<<<< SEARCH'", "none"),
    ],
)
def test_forms(text, form):
    assert P.edit_form(text)[0] == form


CASES = [
    (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​", "empty"), ("```rust\n\n```", "empty"), ("```diff\n```", "empty"),
    (BLOCK[:-4], "truncated"), (DIFF[:-2], "truncated"), (BLOCK + "\n" + BLOCK[:45], "truncated"),
    ("I'm sorry, but I can't modify src/main.rs for you.", "refusal"), ("Unfortunately, I am unable to assist with changing name_3; please rephrase the task.", "refusal"), ("// As an assistant, I must decline.", "refusal"), ("I won’t do this. It goes against my guidelines.", "refusal"), ("This request is something I have to turn down.", "refusal"),
    (CONTEXT, "copied"), (CONTEXT.upper(), "copied"), (CONTEXT.split("---\n")[1], "copied"), ("\n".join("> " + x for x in CONTEXT.split("\n")), "copied"), ("\n".join(f"{i}: {x}" for i, x in enumerate(CONTEXT.split("\n"))), "copied"), ("Task:\n" + CONTEXT.replace("name_4", "nom_4"), "copied"),
    ("Ich habe die Schleife durch eine laufende Summe ersetzt. Die Funktion name_3 muss einen anderen Typ zurückgeben.", "other_language"), ("J'ai remplacé la boucle par une somme cumulée.", "other_language"), ("Нужно передать ссылку на name_3 и запустить проверку ещё раз.", "other_language"), ("应当先传入 name_3 的引用，然后重新检查。", "other_language"),
    ("```\nHay que pasar una referencia de name_3 y volver a comprobar.\n```", "other_language"), ("Ik heb de lus vervangen door een lopende som.", "other_language"), ("Bisogna passare un riferimento a name_3 e ripetere la verifica.", "other_language"), ("Döngüyü birikimli toplamla değiştirdim.", "other_language"), ("먼저 name_3 의 참조를 넘긴 뒤 다시 확인하세요.", "other_language"),
    (BLOCK, None), (DIFF, None), (f"Ich habe alles ersetzt.\n{BLOCK}", None), (f"I cannot keep the old one, so:\n```\n{BLOCK}\n```", None), (BLOCK.replace("let x = 2;", "// Ich habe die Schleife ersetzt, weil sie langsam war."), None),
]


def test_tables(spark):
    step = "struct<attempt:long,context:string,proposal:struct<action:string,patch:string>>"
    rows = [(f"t{i}", [(0, CONTEXT, ("Patch ", p)), (1, CONTEXT, ("no_fix", None)), (2, CONTEXT, (None, "")), (3, CONTEXT, ("patch", BLOCK))]) for i, (p, _) in enumerate(CASES)]
    rows += [rows[0], ("none", []), ("null", None)] + [(f"s{i}", [(0, CONTEXT, ("patch", BLOCK.replace("1", str(i))))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id string, steps array<{step}>")
    got = {(r["traj_id"], r["attempt"]): r["defect"] for r in P.one_defect(P.defects(df)).collect()}
    want = {(f"t{i}", 0): d for i, (_, d) in enumerate(CASES) if d}
    assert got == want
    assert P.defects(df.limit(0)).count() == 0


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.1
    votes = np.stack([np.where(rng.random(6000) < 0.2, 0, np.where(rng.random(6000) < acc, 1, -1) * np.where(truth, 1, -1)) for acc in (0.95, 0.9, 0.85)], 1)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    prior, like = L.fit([tuple(p) for p in pats.tolist()], n.tolist())
    assert abs(prior - 0.1) < 0.02 and abs(like[1, 0, 2] - 0.95) < 0.05 and abs(like[0, 2, 0] - 0.85) < 0.05
    post = L.posterior(votes, prior, like)
    assert ((post > 0.5) == truth).mean() > 0.96
    assert L.posterior(np.zeros((1, 3), int), prior, like)[0] == pytest.approx(prior)


def test_cutoffs_go_by_functions_left_out_of_the_fit():
    """Two functions that agree with each other but not with a third, sound one: its votes push the cutoff up past their patterns."""
    good = ([(1, 1, 1), (-1, -1, -1), (1, 1, 0)], [60, 900, 10])
    assert L.cutoff(*good) == 0.5 and L.cutoff([], []) == 0.5
    bad = ([(1, 1, 1), (-1, -1, -1), (1, 1, -1), (1, 0, -1)], [20, 900, 60, 40])
    cut = L.cutoff(*bad)
    assert cut > 0.5 and cut > min(q for q, _, ok in L.held_out(*bad) if ok)


def test_a_reply_can_keep_two_labels(spark):
    """The context given back and then an edit that is begun: both labels stay, and the one defect is the begun edit."""
    step = "struct<attempt:long,context:string,proposal:struct<action:string,patch:string>>"
    rows = [(f"t{i}", [(0, CONTEXT, ("patch", p))]) for i, (p, _) in enumerate(CASES)] + [("two", [(0, CONTEXT, ("patch", CONTEXT + "\n" + BLOCK[:-4]))])]
    rows += [(f"s{i}", [(0, CONTEXT, ("patch", BLOCK.replace("1", str(i))))]) for i in range(60)]
    found = P.defects(spark.createDataFrame(rows, f"id string, steps array<{step}>")).cache()
    assert {r["defect"] for r in found.where("traj_id = 'two'").collect()} == {"truncated", "copied"}
    assert [r["defect"] for r in P.one_defect(found).where("traj_id = 'two'").collect()] == ["truncated"]


def test_profiles_tell_languages_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = languages.fit(docs)
    assert "en" in known.names and len(known.names) > 3
    assert known.foreign("The loop was replaced by a running sum, so the function must return another type.") < 0
    for t in ("Die Schleife wurde durch eine laufende Summe ersetzt, deshalb gibt die Funktion einen anderen Typ zurück.", "El modelo propuso otro tipo, aunque la función no coincide con el error."):
        assert known.foreign(t) > P.OTHER
    assert known.foreign("no") is None and P.UNKNOWN.foreign("Die Schleife wurde ersetzt") is None
    assert languages.fit(docs.limit(0)).names == []

