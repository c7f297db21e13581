"""Generated fixtures: program texts by rule and inputs by domain; the same for the same seed."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession, functions as F

_TYPES = ("i32", "i64", "u32", "u64")
_NAMES = ("alpha", "beta", "gamma", "delta", "omega", "sigma")


def _function(rng: random.Random, n: int) -> tuple[str, str]:
    """A small function and a statement of main that uses it."""
    name, kind, k = f"{rng.choice(_NAMES)}_{n}", rng.choice(_TYPES), rng.randint(2, 99)
    shape = n % 5
    if shape == 0:
        return f"fn {name}(items: &[{kind}]) -> {kind} {{\n    let start: {kind} = {k};\n    let mut total: {kind} = start;\n    for item in items.iter() {{\n        total += *item;\n    }}\n    total\n}}\n", f'    println!("{{}}", {name}(&[{k}, {k + 1}]));\n'
    if shape == 1:
        return f"#[derive(Debug, Clone)]\nstruct {name.title().replace('_', '')} {{\n    size: {kind},\n}}\n", f'    let shown = {name.title().replace("_", "")} {{ size: {k} }};\n    println!("{{:?}}", shown);\n'
    if shape == 2:
        return f"use std::collections::HashMap;\n\nfn {name}(words: &[&str]) -> HashMap<String, usize> {{\n    let mut counts = HashMap::new();\n    for word in words.iter() {{\n        *counts.entry(word.to_string()).or_insert(0) += {k};\n    }}\n    counts\n}}\n", f'    let counted = {name}(&["a", "b"]);\n    println!("{{}}", counted.len());\n'
    if shape == 3:
        return f"fn {name}(label: &str) -> String {{\n    let upper: bool = true;\n    if upper {{\n        return label.to_uppercase();\n    }}\n    label.to_string()\n}}\n", f'    println!("{{}}", {name}("x"));\n'
    return f"fn {name}(limit: {kind}) -> Vec<{kind}> {{\n    let kept: Vec<{kind}> = (0..limit).filter(|x| x % {k} == 0).collect();\n    kept\n}}\n", f"    let kept = {name}({k});\n    println!(\"{{}}\", kept.len());\n"


def seed_program(index: int, seed: int = 7) -> str:
    """The program of an index: one to three functions and a main that calls them."""
    rng = random.Random(f"{seed}:{index}")
    parts = [_function(rng, index + i) for i in range(rng.randint(1, 3))]
    return "\n".join(p for p, _ in parts) + "\nfn main() {\n" + "".join(m for _, m in parts) + "}\n"


def seed_programs(spark: SparkSession, n: int = 49, seed: int = 7) -> DataFrame:
    """(seed_index, source) of ``n`` generated programs."""
    return spark.createDataFrame([(i, seed_program(i, seed)) for i in range(n)], "seed_index int, source string")


# The names of the input domains.
DOMAINS = ("int_list", "two_int_lists", "target", "ranges", "window", "strings", "lookup")


def _shapes(n: int = 4) -> list[list[int]]:
    """Number lists at the edges of their domain: none, one, all equal, falling, all negative, with a repeat."""
    return [[], [n], [n] * n, list(range(n, 0, -1)), list(range(-n, 0)), [*range(n), 0]]


def edge_inputs(domain: str) -> list:
    """The inputs at the edges of a domain, by rule: empty and single lists, ties, and arguments at and past every bound."""
    lists = _shapes()
    if domain == "int_list":
        return lists
    if domain == "two_int_lists":
        return [[a, b] for a in lists for b in ([], a, a[::-1], [x + 1 for x in a])]
    if domain == "target":  # sums of none, of an element with itself, of two neighbours, and out of reach
        return [[a, t] for a in lists for t in sorted({0, *(2 * x for x in a[:1]), *map(sum, zip(a, a[1:])), 1000})]
    if domain == "ranges":  # the empty range, the whole, first and last element
        return [[a, [[0, 0], [0, len(a)], [0, min(1, len(a))], [max(len(a) - 1, 0), len(a)]]] for a in lists]
    if domain == "window":  # below, at and above every width a list has
        return [[a, k] for a in lists for k in sorted({-1, 0, 1, len(a), len(a) + 1})]
    if domain == "strings":
        return [[], [""], ["ab"], ["", "ab", ""], ["ab"] * 3]
    if domain == "lookup":  # no key, a missing one, one that occurs twice
        return [[[[x, i] for i, x in enumerate(a)], q] for a in lists for q in ([], a[:1], [99], [*a, 99])]
    raise ValueError(f"unknown domain {domain}")


def random_input(domain: str, rng: random.Random):
    """One random input of a domain."""
    ints = lambda: [rng.randint(-100, 100) for _ in range(rng.randint(0, 12))]
    x = ints()
    if domain == "int_list":
        return x
    if domain == "two_int_lists":
        return [x, ints()]
    if domain == "target":
        return [x, rng.randint(-100, 100)]
    if domain == "ranges":
        return [x, [sorted((rng.randint(0, len(x)), rng.randint(0, len(x)))) for _ in range(3)]]
    if domain == "window":
        return [x, rng.randint(-1, len(x) + 1)]
    if domain == "strings":
        return ["".join(rng.choice("abxy") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 6))]
    if domain == "lookup":
        return [[[rng.randint(0, 9), v] for v in x], [rng.randint(0, 9) for _ in range(3)]]
    raise ValueError(f"unknown domain {domain}")


def battery(domain: str, n: int = 64, variants: int = 5, seed: int = 7) -> list[tuple[str, object]]:
    """(kind, input): all edge cases, ``n`` seeded ones and ``variants`` larger benchmark inputs; never empty."""
    rng = random.Random(f"{seed}:{domain}")
    cases = [("edge", e) for e in edge_inputs(domain)] + [("random", random_input(domain, rng)) for _ in range(n)]
    return cases + [(f"b{i}", random_input(domain, random.Random(f"{seed}:{domain}:{i}"))) for i in range(variants)]


def batteries(spark: SparkSession, n: int = 64, seed: int = 7) -> DataFrame:
    """(domain, place, kind, input as JSON) of every domain."""
    rows = [(d, i, k, json.dumps(v)) for d in DOMAINS for i, (k, v) in enumerate(battery(d, n, seed=seed))]
    return spark.createDataFrame(rows, "domain string, place int, kind string, input string").withColumn("id", F.concat("domain", F.lit(":"), F.sha2("input", 256)))
