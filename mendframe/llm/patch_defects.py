"""Prompt and reply pairs whose reply is no usable edit, with the defect."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.llm import label_model, languages
from mendframe.llm.languages import Profiles
from mendframe.llm.records import table
from mendframe.session import Scratch

#: Profiles of no language.
UNKNOWN = Profiles({})
DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
FUNCTIONS = {
    "empty": ("no_text", "no_letters", "no_edit_short"),
    "truncated": ("form_unfinished", "markers_uneven", "ends_open"),
    "refusal": ("declines", "apologises", "plain_english", "no_edit"),
    "copied": ("words_shared", "runs_shared", "not_prose"),
    "other_language": ("foreign_script", "foreign_profile", "few_english_words", "foreign_marks", "own_words"),
}

FENCE = re.compile(r"^\s*(```+|~~~+)[\w+.-]*\s*$")
OPEN = re.compile(r"^\s*<{5,9} ?SEARCH\s*$")
DIVIDE = re.compile(r"^\s*={5,9}\s*$")
CLOSE = re.compile(r"^\s*>{5,9} ?REPLACE\s*$")
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
OLD, NEW = re.compile(r"^--- \S+(\t.*)?$"), re.compile(r"^\+\+\+ \S+(\t.*)?$")
FILE = re.compile(r"^\s*(?:file|path)\s*:\s*\S+\s*$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NAME = re.compile(r"\b\w*[_\d]\w*\b|\b\w+\.(?:rs|py|toml|md|c|h|js|ts|go|java)\b")

# The commonest English function words.
ENGLISH = frozenset(
    "a an the this that these those it its is are was were be been being am do does did have has had having not no nor and or but if then than so as at by for from in into of on onto to with without "
    "i i'm i've i'd i'll me my we our you your he she they them their there here what which who whom when where why how all any both each few more most other some such only own same too very can cannot can't could "
    "couldn't should shouldn't would wouldn't will won't may might must about after again against before below between during over under until up down out off once just don't doesn't didn't isn't aren't wasn't "
    "please sorry unable able because while through because let let's us also however instead".split()
)
#: Those that are words of other languages too say nothing about the language.
STRONG = ENGLISH - frozenset("a i in on so no do me am an as at he we was is it or of to all have had has are once just but does".split())
#: What quoting and numbering put before a line.
LINE_PREFIX = re.compile(r"^[ \t]*(?:(?:>+|\d+[ \t]*[:.|)]|[|#*]+|//+)[ \t]?)+", re.M)
# Ways to decline in English.
DECLINE = re.compile(
    r"\b(?:can(?:no|')?t|can not|could(?: not|n't)|will not|won't|would(?: not|n't)|shall not|do(?: not|n't)|(?:am|are|is|i'm|be) (?:un|not )able|unable|not going|not allowed|not permitted|not willing|not comfortable|"
    r"must (?:decline|refuse)|have to (?:decline|refuse|turn)|declin(?:e|ed|ing)|refus(?:e|ed|al|ing)|turn(?:ing)? (?:\w+ )?down|outside (?:of )?what|beyond what|lack(?:s|ing)? the|no (?:edit|patch|change|fix)s? (?:will|can|is|are)|"
    r"not (?:be )?(?:appropriate|possible|something)|against my|my (?:guidelines|policy|policies)|don't feel|not feel|rather not|reluctant|not in a position|impossible for me|nothing i can)\b"
)
APOLOGY = re.compile(r"\b(?:sorry|apolog(?:y|ies|i[sz]e)|unfortunately|regret|afraid|as an? (?:ai|assistant|language model)|thanks for asking|please (?:rephrase|ask|consult)|i must|i am unable|i won't|i can't|i cannot|my guidelines|anything else)\b")
#: By how much (natural log, a trigram) another language must be likelier than English, and English than all others.
OTHER, ENGLISH_CLEAR = 0.15, 0.5
#: Letters with marks, and marks of punctuation, that English prose does not use.
MARKED = re.compile(r"[À-ÖØ-öø-ÿĀ-žƀ-ɏḀ-ỿ¿¡«»]")


def visible(text: str) -> str:
    """What can be seen of a text, code fences aside."""
    lines = [x for x in text.splitlines() if not FENCE.match(x)]
    kept = "".join(c for c in "\n".join(lines) if not (c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp") or c in "⠀ㅤﾠᅟᅠ͏"))
    return kept


def edit_form(text: str) -> tuple[str, bool, bool]:
    """('whole', 'begun' or 'none', whether markers are uneven, whether the end lies inside an edit).

    Blocks have an opening, a dividing and a closing line in this order; a diff has file lines and
    hunks of as many lines as their headers say. One begun and not ended edit makes the text ``begun``,
    even after whole ones. Fences and prose between edits are no part of their form.
    """
    lines = text.splitlines()
    state, whole, broken, opened, divided, closed = "out", 0, False, 0, 0, 0
    old = new = 0
    header = 0  # 1 after '---', 2 after '+++'
    for k, x in enumerate(lines):
        if state == "hunk":
            if old > 0 or new > 0:
                if x.startswith("-") and old > 0:
                    old -= 1
                    continue
                if x.startswith("+") and new > 0:
                    new -= 1
                    continue
                if x.startswith("\\"):
                    continue
                if (x.startswith(" ") or x == "" or x.startswith("\t")) and old > 0 and new > 0:
                    old, new = old - 1, new - 1
                    continue
                broken, state = True, "out"
            else:
                state = "out"
                whole += 1
        if state == "out":
            if OPEN.match(x):
                state, opened = "search", opened + 1
            elif m := HUNK.match(x):
                old, new = (int(m[i]) if m[i] is not None else 1 for i in (2, 4))
                state, header = "hunk", 0
            elif OLD.match(x) and (k + 1 == len(lines) or NEW.match(lines[k + 1]) or all(FENCE.match(y) or not y.strip() for y in lines[k + 1 :])):
                header = 1
            elif header == 1 and NEW.match(x):
                header = 2
        elif state == "search":
            if DIVIDE.match(x):
                state, divided = "replace", divided + 1
            elif OPEN.match(x):
                broken, opened = True, opened + 1
        elif state == "replace":
            if CLOSE.match(x):
                state, closed, whole = "out", closed + 1, whole + 1
            elif OPEN.match(x):
                broken, state, opened = True, "search", opened + 1
    if state == "hunk" and old <= 0 and new <= 0:
        state = "out"
        whole += 1
    tail = [x for x in lines if x.strip() and not FENCE.match(x)]
    last = tail[-1].strip() if tail else ""
    stub = state == "out" and (3 <= len(last) < 14 and "<<<<<<< SEARCH".startswith(last) or last.startswith("@@ -") and not HUNK.match(last) or header > 0 or bool(not whole and FILE.match(last)))
    ends_open = state != "out" or stub
    form = "begun" if broken or ends_open else "whole" if whole else "none"
    return form, not (opened == divided == closed), ends_open


def _shared(context: str, reply: str) -> tuple[float, float]:
    """Shares of the reply's distinct words, and runs of three of them, that the context holds too, case aside."""
    a, b = (re.findall(r"[a-z_][a-z0-9_]*|[0-9]+", x.lower()) for x in (context, LINE_PREFIX.sub("", reply)))
    if not b:
        return 0.0, 0.0
    runs = lambda w: set(zip(w, w[1:], w[2:]))
    ra, rb = runs(a), runs(b)
    return len(set(a) & set(b)) / len(set(b)), len(ra & rb) / len(rb) if rb else 0.0


def _outside(text: str) -> str:
    """What stands before the first edit of a text."""
    lines = text.splitlines()
    first = next((k for k, x in enumerate(lines) if OPEN.match(x) or HUNK.match(x) or OLD.match(x)), len(lines))
    if first and first < len(lines) and FILE.match(lines[first - 1]):
        first -= 1
    return "\n".join(lines[:first])


def votes(context: str | None, patch: str | None, languages: Profiles = UNKNOWN) -> list[int]:
    """The votes of all functions of ``FUNCTIONS``, in order. A null text is an empty one. ``languages`` tells English from others."""
    text, context = patch or "", context or ""
    seen = visible(text)
    form, uneven, ends_open = edit_form(text)
    body = "\n".join(x for x in text.splitlines() if not FENCE.match(x))
    low = body.lower().replace("’", "'")
    prose = NAME.sub(" ", body)
    letters = [c for c in prose if c.isalpha()]
    foreign = sum(not unicodedata.name(c, "LATIN").startswith("LATIN") for c in letters) / max(len(letters), 1)
    code = sum(c in "{}()[];=<>+*/&|#" for c in body) / max(len(body), 1)
    # Of a begun edit what stands before it may be copied too.
    before = low if form == "none" else _outside(low) if form == "begun" else ""
    own = len(seen) if form == "none" else len(visible(before))
    word_share, run_share = _shared(context, before)
    language = languages.foreign(prose) if form == "none" and seen else None
    other, english = language is not None and language > OTHER, language is not None and language < -ENGLISH_CLEAR
    words = [w.lower().replace("’", "'") for w in WORD.findall(prose)]
    common = sum(w in ENGLISH for w in words) / max(len(words), 1)
    strong = sum(w in STRONG for w in words) / max(len(words), 1)
    whole, none = form == "whole", form == "none"
    some = own >= min(40, max(len(context) // 2, 1))
    return [
        # empty
        1 if not seen else -1,
        1 if not any(unicodedata.category(c)[0] in "LNSP" for c in seen) else -1,
        1 if none and len(seen) < 3 else -1,
        # truncated
        1 if form == "begun" else -1,
        -1 if whole else 1 if uneven else 0 if form == "begun" else -1,
        1 if ends_open else -1 if whole or none else 0,
        # refusal
        1 if none and run_share < 0.35 and DECLINE.search(low) else -1,
        -1 if not none else 1 if APOLOGY.search(low) else 0,
        1 if none and (common >= 0.25 and len(words) >= 4 or english) and code < 0.03 else -1 if not none or other or common < 0.12 else 0,
        -1 if not none or not seen or run_share > 0.6 else 0,
        # copied
        1 if own and word_share >= 0.6 and some else -1,
        1 if own and run_share >= 0.35 else -1,
        (0 if code > 0.01 or len(seen) >= 200 else -1) if own else -1,
        # other_language
        (1 if foreign > 0.3 else 0) if none and seen else -1,
        1 if other or foreign > 0.3 and none and seen else -1 if not none or not seen or english else 0,
        (1 if words and strong < 0.12 and code < 0.03 or foreign > 0.3 else -1) if none and seen else -1,
        (1 if MARKED.search(body) else 0) if none and seen else -1,
        (0 if run_share < 0.35 and code < 0.03 else -1) if none and seen else -1,
    ]


_SPAN: dict[str, tuple[int, int]] = {}
for _d, _f in FUNCTIONS.items():
    _at = max((b for _, b in _SPAN.values()), default=0)
    _SPAN[_d] = (_at, _at + len(_f))
ALL_VOTES = sum(map(len, FUNCTIONS.values()))


def reply_votes(trajectories: DataFrame, languages: Profiles = UNKNOWN) -> DataFrame:
    """(traj_id, attempt, votes): one row per step whose action, trimmed and in any case, is ``patch``."""
    is_patch = lambda s: F.lower(F.regexp_replace(s["proposal"]["action"], r"^\s+|\s+$", "")) == "patch"
    s = F.explode(F.filter("steps", lambda s: F.coalesce(is_patch(s), F.lit(False)))).alias("s")
    steps = trajectories.select(F.col("id").alias("traj_id"), s).select("traj_id", F.col("s.attempt").alias("attempt"), F.col("s.context").alias("context"), F.col("s.proposal.patch").alias("patch"))
    shared = trajectories.sparkSession.sparkContext.broadcast(languages)  # 64 KB a language that one fitted row in a hundred names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cast = ["".join("-0+"[v + 1] for v in votes(c, p, shared.value)) for c, p in zip(b["context"], b["patch"])]
            yield b.assign(votes=cast).drop(columns=["context", "patch"])

    return steps.mapInPandas(run, "traj_id string, attempt long, votes string")


def defects(trajectories: DataFrame, labelled: DataFrame | None = None, name: str = "patch_defects") -> DataFrame:
    """traj_id, attempt, defect, posterior: every defect whose posterior passes its cutoff.

    Labelling functions vote on each reply, a label model per defect is fitted on the counts of
    vote patterns of all rows, and its cutoff validated by the votes of functions left out of the fit. A
    reply may pass for several defects and then has a row for each. ``labelled`` has texts with their ``lang``, of which at most
    ``languages.FIT_ROWS`` teach the profiles that tell English from other languages; without it those functions abstain. Steps of other actions are left out; a null or
    unseen patch is empty; rows without id or attempt keep nulls there; an empty table gives none.
    """
    spark = trajectories.sparkSession
    scratch = Scratch(spark, name)
    rows = scratch.write(reply_votes(trajectories, UNKNOWN if labelled is None else languages.fit(labelled)).distinct(), "votes")
    # One row for each pattern of one defect's votes: at most 3 ** 5 for each.
    cuts = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.substring("votes", a + 1, b - a).alias("pattern")) for d, (a, b) in _SPAN.items()))).alias("p")
    tally = rows.select(cuts).groupBy("p.defect", "p.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    passed = []
    for d in DEFECTS:
        mine = sorted((r["pattern"], r["n"]) for r in tally if r["defect"] == d)
        if not mine:
            continue
        pats, n = [tuple("-0+".index(c) - 1 for c in p) for p, _ in mine], [k for _, k in mine]
        prior, like = label_model.fit(pats, n)
        post = label_model.posterior(np.array(pats), prior, like)
        cut = label_model.cutoff(pats, n)
        passed += [(d, p, float(q)) for (p, _), q in zip(mine, post) if q >= cut]
    model = spark.createDataFrame(passed, "defect string, pattern string, posterior double")
    long = rows.select("traj_id", "attempt", cuts).select("traj_id", "attempt", "p.defect", "p.pattern")
    return long.join(F.broadcast(model), ["defect", "pattern"]).select("traj_id", "attempt", "defect", "posterior")  # at most 5 * 243 rows


def one_defect(found: DataFrame) -> DataFrame:
    """One defect of each step: an edit that was begun is truncated whatever else holds, else the likeliest; ties go to the first in the order of ``DEFECTS``."""
    place = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return found.groupBy("traj_id", "attempt").agg(F.max_by("defect", F.struct(F.col("defect") == "truncated", "posterior", -place)).alias("defect"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return one_defect(defects(table(spark, folder, "trajectories"), table(spark, folder, "documents"))).select("traj_id", "attempt", "defect")


def p2_labels(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "trajectories"), table(spark, folder, "documents"), "patch_labels").select("traj_id", "attempt", "defect", F.round("posterior", 6).alias("posterior"))


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels}
ORACLES: dict[str, str] = {}
