"""The training-data queries with their SQL."""

from __future__ import annotations

from mendframe.llm import encode, leakage, mixing, mojibake, near_dup, patch_defects, splits, threads, sql

_MODULES = [near_dup, patch_defects, threads, splits, leakage, encode, mixing, mojibake]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()} | {"p1_found": sql.P1_FOUND, "p5_found": sql.P5_FOUND}
