"""JSON inside model text: first objects, proposals, strict values and equality."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from mendframe.functions import arrow_udf

_TOKEN = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|[{}]', re.S)
ACTIONS = ("patch", "no_fix", "escalate")


def first_object(text: str) -> str | None:
    """The first balanced ``{...}``; braces inside strings don't count, an open string swallows the rest."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in _TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return text[start : m.end()]
    return None


def _reject(name: str):
    raise ValueError(name)


def parse_proposal(text: str) -> dict:
    """The proposal in a model's text; raises ValueError for no object, a wrong type or an unknown action."""
    raw = first_object(text)
    if raw is None:
        raise ValueError("no object")
    p = json.loads(raw, parse_constant=_reject)
    for key, kinds, need in (("action", str, True), ("patch", (str, type(None)), False), ("reason", (str, type(None)), False), ("confidence", (int, float), False)):
        if need and key not in p or key in p and (not isinstance(p[key], kinds) or isinstance(p[key], bool)):
            raise ValueError(f"field {key}")
    if p["action"] not in ACTIONS:
        raise ValueError("unknown action")
    return {"action": p["action"], "patch": p.get("patch"), "reason": p.get("reason"), "confidence": float(p.get("confidence", 0.0))}


def any_action(text: str) -> str | None:
    """The action of the first object that parses, tried at each brace; null if it has no text there."""
    decoder = json.JSONDecoder()
    for m in re.finditer("{", text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        action = value.get("action")
        return action if isinstance(action, str) else None
    return None


def strict_equal(a, b) -> bool:
    """Equality that tells true from 1 and 1 from 1.0, at every depth."""
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(strict_equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(strict_equal(v, b[k]) for k, v in a.items())
    return a == b


def strict_value(value, depth: int = 64) -> bool:
    """No float that is infinite or no number, and no more than ``depth`` levels."""
    if depth < 0:
        return False
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, list):
        return all(strict_value(x, depth - 1) for x in value)
    if isinstance(value, dict):
        return all(isinstance(k, str) and strict_value(x, depth - 1) for k, x in value.items())
    return value is None or isinstance(value, (str, bool, int))


def strict_json(text: str) -> bool:
    try:
        return strict_value(json.loads(text, parse_constant=_reject))
    except (ValueError, RecursionError):
        return False


# The numbers that the output grammar admits for a confidence.
CONFIDENCE = re.compile(r"0|0\.[0-9]+|1|1\.0")
_STRING = r'"(?:[^"\\]|\\.)*"'
CONTRACT = re.compile(
    r"\{\s*\"action\"\s*:\s*\"(?:patch|no_fix|escalate)\"\s*,\s*\"patch\"\s*:\s*(?:" + _STRING + r"|null)\s*,\s*\"reason\"\s*:\s*" + _STRING + r"\s*,\s*\"confidence\"\s*:\s*(?:1\.0|0\.[0-9]+|0|1)\s*\}", re.S
)


def meets_contract(text: str) -> bool:
    """Whether a whole text is one proposal as the output grammar writes it."""
    return CONTRACT.fullmatch(text) is not None


@arrow_udf("string")
def first_object_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else first_object(t) for t in text], dtype=object)


@arrow_udf("action string, patch string, reason string, confidence double, error string")
def proposal_udf(text: pd.Series) -> pd.DataFrame:
    """The proposal or the error; null text is an error."""

    def one(t):
        try:
            return (*parse_proposal(t or "").values(), None)
        except ValueError as e:
            return None, None, None, None, str(e).split(":")[0][:40]

    return pd.DataFrame([one(t) for t in text], columns=["action", "patch", "reason", "confidence", "error"], dtype=object)


@arrow_udf("string")
def any_action_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else any_action(t) for t in text], dtype=object)


@arrow_udf("boolean")
def strict_json_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else strict_json(t) for t in text], dtype=object)


@arrow_udf("boolean")
def strict_equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Strict equality of two JSON texts; null where either is null or no JSON."""

    def one(x, y):
        try:
            return None if x is None or y is None else strict_equal(json.loads(x), json.loads(y))
        except ValueError:
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


@arrow_udf("boolean")
def contract_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else meets_contract(t) for t in text], dtype=object)
