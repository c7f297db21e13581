"""Program texts: structure fingerprints, policy checks, mutations. Code is parsed, never run."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendframe.functions import arrow_udf

# Names that a fingerprint keeps.
KEPT_NAMES = {"solve", "len", "set", "range", "sum", "max", "min", "sorted", "enumerate", "list", "str", "dict", "any", "all"}


#: In the dump of a tree: a string literal, which stays, or a name that is bound or read.
_NAMED = re.compile(r"""Constant\(value=(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<role>Name\(id|\barg\(arg)='(?P<name>[^']*)'""")


def fingerprint(source: str) -> str | None:
    """SHA-256 of the dumped syntax tree with local names numbered in order of appearance; null if it doesn't parse.

    Literals, attributes, keywords and operations stay. The text of a tree depends on the Python version, so
    fingerprints are only comparable within one.
    """
    try:
        dumped = ast.dump(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        return None
    numbers: dict[str, int] = {}

    def numbered(m: re.Match) -> str:
        if m["role"] is None or m["name"] in KEPT_NAMES:
            return m[0]
        return f"{m['role']}='v{numbers.setdefault(m['name'], len(numbers))}'"

    return hashlib.sha256(_NAMED.sub(numbered, dumped).encode()).hexdigest()


@arrow_udf("string")
def fingerprint_udf(source: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else fingerprint(s) for s in source], dtype=object)


# The syntax, functions and methods a candidate may use.
ALLOWED_SYNTAX = """
Module FunctionDef arguments arg Return Assign AugAssign Expr For While If IfExp Break Continue Pass Name Load Store Constant
List Tuple Set Dict Subscript Slice BinOp UnaryOp BoolOp Compare Call Attribute keyword ListComp SetComp DictComp GeneratorExp
comprehension Add Sub Mult Div FloorDiv Mod Pow UAdd USub Not Invert And Or BitAnd BitOr BitXor LShift RShift Eq NotEq Lt LtE Gt GtE Is IsNot In NotIn
""".split()
ALLOWED_FUNCTIONS = """
len set range abs sorted sum min max all any enumerate zip reversed list tuple dict frozenset int float bool str round divmod pow ord chr
""".split()
ALLOWED_METHODS = """
append extend insert pop remove clear copy count index reverse sort get keys values items update setdefault add discard union
intersection difference issubset issuperset join split strip lower upper replace startswith endswith find isdigit isalpha
""".split()


#: What is refused of a kind of node, besides kinds that are not allowed at all: (rule, test of node and own function's name).
_REFUSED: dict[type, list[tuple[str, Callable[[ast.AST, str], bool]]]] = {
    ast.Name: [("private name", lambda n, _: n.id[:1] == "_")],
    ast.arg: [("private name", lambda n, _: n.arg[:1] == "_")],
    ast.Attribute: [("attribute", lambda n, _: n.attr not in ALLOWED_METHODS)],
    ast.Call: [
        ("call", lambda n, own: isinstance(n.func, ast.Name) and n.func.id not in (*ALLOWED_FUNCTIONS, own)),
        ("call", lambda n, _: not isinstance(n.func, (ast.Name, ast.Attribute))),
    ],
    ast.FunctionDef: [
        ("nested function", lambda n, own: n.col_offset > 0 or n.name != own),
        ("private name", lambda n, _: n.name[:1] == "_"),
        ("decorators or defaults", lambda n, _: bool(n.decorator_list or n.args.defaults or any(n.args.kw_defaults))),
    ],
}


def policy_breaches(source: str, function: str) -> list[tuple[int, str]]:
    """(line, rule) of everything a candidate does that it may not, in order of lines. The text is only parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [(0, "syntax error")]
    found = set()
    if [getattr(x, "name", None) for x in tree.body if isinstance(x, ast.FunctionDef)] != [function] or len(tree.body) > 1:
        found.add((0, "not exactly one function of that name"))
    at = [(tree, 0)]
    while at:
        node, line = at.pop()
        line = getattr(node, "lineno", line)
        if type(node).__name__ not in ALLOWED_SYNTAX:
            found.add((line, f"syntax {type(node).__name__}"))
        found |= {(line, rule) for rule, broken in _REFUSED.get(type(node), ()) if broken(node, function)}
        at += [(x, line) for x in ast.iter_child_nodes(node)]
    return sorted(found)


def policy_violation(source: str, function: str) -> str | None:
    """The first breach of the policy, or null."""
    return next((rule for _, rule in policy_breaches(source, function)), None)


@arrow_udf("string")
def policy_udf(source: pd.Series, function: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else policy_violation(s, f) for s, f in zip(source, function)], dtype=object)


class Mutation(NamedTuple):
    """``pattern`` finds the sites; each site alone is rewritten to ``new`` (a match template); ``if_has`` must occur."""

    code: str
    category: str
    pattern: str
    new: str
    if_has: tuple[str, ...] = ()


# What each mutation looks for, what it puts there, and the code it should cause.
MUTATIONS = (
    Mutation("E0308", "type_mismatch", r"(let \w+: (?:i8|i16|i32|i64|u8|u16|u32|u64|usize) = )(\d+)(?=;)", r'\1"\2"'),
    Mutation("E0308", "bool_as_int", r"(let \w+: bool = )(?:true|false)(?=;)", r"\g<1>1"),
    Mutation("E0433", "missing_import", r"use std::[\w:]+;\n", ""),
    Mutation("E0599", "unknown_method", r"\.(?:iter|first|len|push|insert|copied|sum|map|collect|clone|to_string|to_uppercase|parse)\(", ".nonexistent_method_qz("),
    Mutation("E0425", "undeclared_ident", r'(println!\("\{[^}]*\}",\s*)\w+(?=\))', r"\1undeclared_var_qz"),
    Mutation("E0277", "missing_derive", r"#\[derive\([^)]*\bDebug\b[^)]*\)\]\n", "", ("{:?}", "{:#?}")),
    Mutation("E0308", "wrong_arg_type", r'\b(?!(?:println|print|format|vec|eprintln)\()(\w+)\("[^"]*"\)', r"\1(42)"),
    Mutation("E0596", "missing_mut", r"let mut (\w+)", r"let \1"),
    Mutation("E0282", "missing_type_annotation", r"let (\w+): Vec<\w+> = ([^;]*collect\(\))", r"let \1 = \2"),
    Mutation("E0560", "wrong_field_name", r"([A-Z]\w+ \{ )\w+(?=:)", r"\1nonexistent_field"),
    Mutation("E0308", "return_type_mismatch", r"(\w+)\.to_string\(\)", r"\1"),
    Mutation("SYNTAX", "missing_semicolon", r"(?m)^(?=.*let )(.*);[^\S\n]*$", r"\1"),
)


def mutants(source: str) -> list[tuple[str, str, int, str]]:
    """(code, category, site, broken) of every site of every mutation that changes the text."""
    out = []
    for m in MUTATIONS:
        if m.if_has and not any(x in source for x in m.if_has):
            continue
        for site, hit in enumerate(re.finditer(m.pattern, source)):
            broken = source[: hit.start()] + hit.expand(m.new) + source[hit.end() :]
            if broken != source and broken.strip():
                out.append((m.code, m.category, site, broken))
    return out


@arrow_udf("array<struct<code:string,category:string,site:int,broken:string>>")
def mutants_udf(source: pd.Series) -> pd.Series:
    return pd.Series([[] if s is None else [dict(zip(("code", "category", "site", "broken"), x)) for x in mutants(s)] for s in source], dtype=object)


def all_mutants(seeds: DataFrame, key: str, source: str) -> DataFrame:
    """Every seed crossed with every mutation and site: key, intended_code, category, site, broken, case_id."""
    m = seeds.select(key, F.explode(mutants_udf(source)).alias("m"))
    return m.select(key, F.col("m.code").alias("intended_code"), "m.category", "m.site", "m.broken", F.substring(F.sha1("m.broken"), 1, 12).alias("case_id"))
